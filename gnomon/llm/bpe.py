"""Byte-pair encoding of whole texts with a public vocabulary.

A pre-token's merges are chosen by a rank queue: a three-level bitmap of 64-bit words marks
the merge ranks that wait, the lowest set bit names the next one, and each rank's bucket holds
positions in the linked list of parts.  Entries whose parts have changed meanwhile are skipped.
The cost is near linear in the pre-token's length, so a text without any white space is no
special case.  Short pre-tokens repeat, so each task keeps the ids of the latest ones.

Defined results: a null or empty text gives an empty list; strings that look like special
tokens are ordinary text; repeated rows give repeated rows; a null id stays null; an empty
table gives an empty result; other columns are ignored.  Lone surrogates cannot occur in Spark
strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gnomon.session import spread

VOCABULARY_DIR = "/opt/tokenizers"
#: The vocabulary's split pattern.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 200_000  # pre-tokens whose ids a task keeps
KEPT_LENGTH = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, one `base64 rank` a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Positions by rank; the lowest waiting rank is found in three word operations."""

    def __init__(self) -> None:
        self.words: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        w, m = rank >> 6, rank >> 12
        self.words[w] = self.words.get(w, 0) | 1 << (rank & 63)
        self.mid[m] = self.mid.get(m, 0) | 1 << (w & 63)
        self.top |= 1 << m

    def first(self) -> int:
        if not self.top:
            return -1
        m = (self.top & -self.top).bit_length() - 1
        x = self.mid[m]
        w = m << 6 | (x & -x).bit_length() - 1
        y = self.words[w]
        return w << 6 | (y & -y).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        w, m = rank >> 6, rank >> 12
        self.words[w] &= ~(1 << (rank & 63))
        if not self.words[w]:
            self.mid[m] &= ~(1 << (w & 63))
            if not self.mid[m]:
                self.top &= ~(1 << m)
        return self.buckets.pop(rank)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here, 0 once it is merged away
    before = list(range(-1, n - 1))
    queue = RankQueue()
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            queue.push(r, i)
    while (rank := queue.first()) >= 0:
        waiting = sorted(queue.take(rank))
        for k, i in enumerate(waiting):
            j = end[i]
            if not j or j >= n:
                continue
            e = end[j]
            if ranks.get(piece[i:e]) != rank:
                continue  # stale: a part of this pair has grown
            end[i], end[j] = e, 0
            if e < n:
                before[e] = i
                r = ranks.get(piece[i : end[e]])
                if r is not None:
                    queue.push(r, i)
            b = before[i]
            if b >= 0:
                r = ranks.get(piece[b:e])
                if r is not None:
                    queue.push(r, b)
            # a pair with the new part was learned after it, so in a trained vocabulary no lower rank comes up here
            if 0 <= queue.first() < rank:  # a lower rank came up: it goes first
                for later in waiting[k + 1 :]:
                    queue.push(rank, later)
                break
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Texts to ids; one per task."""

    def __init__(self, ranks: dict[bytes, int], split: str = SPLIT) -> None:
        self.ranks, self.cut, self.kept = ranks, regex.compile(split).findall, {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        kept = self.kept
        for piece in self.cut(text):
            ids = kept.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8"), self.ranks)
                if len(piece) <= KEPT_LENGTH:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{VOCABULARY_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, ids) for every row.  The vocabulary file, of fixed size, is sent to the executors."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            lists = [encoder.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            values = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
