"""Evaluation items leaking into documents.

Three-word seeds that few items share join documents to items; a document is a candidate for an
item where two seeds lie near one diagonal.  A Smith-Waterman alignment of words then scores the
candidate, so that edited words, typing errors, changed case, punctuation, quoting or white
space do not hide a copy.  Words that many items share (instructions) count for nothing.

How many items share a seed is counted over groups of items: those of one text (word for word)
are one item with several ids, and those whose five-word shingles agree by 0.8 or more count once.
So variants of one item do not hide each other, and every id of a text that leaked is reported.

The size of the items is measured first.  Up to `in_task_chars` characters they go to the
executors and no document is shuffled; beyond that nothing of them is collected: documents and
items meet by a shuffle on the rare seeds, of which a Bloom filter of bounded size lets a
document's through, and texts are joined to the pairs that do.  Both ways give the same rows.
An alignment keeps some rows of its matrix and fills in the rest while it is traced
back, so its memory grows with the square root of the item's length.

Defined results: null, empty and blank texts and rows with a null id match nothing; items with fewer than `least_words`
own words match nothing; of several texts with one item id the last in order counts; repeated documents give one row per
(document id, item id); ties between alignments take the first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.folding import plain
from gnomon.operators.hierarchy import forest
from gnomon.session import cut, spread

_WORD = regex.compile(r"\w+")
SEED = 3
SHINGLE, ALIKE = 5, 0.8  # near-equal items: words of a shingle, least share of common ones
MATCH, MISMATCH, GAP = 3.0, -1.5, -1.5
SLACK = 16  # edited words beyond the outer seeds of a passage
WINDOW_DRIFT = 12  # how far two seeds of one passage may stray from a diagonal


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def seeds(ws: list[str]) -> Iterator[tuple[int, int]]:
    """(hash, position) of each run of SEED words."""
    for k in range(len(ws) - SEED + 1):
        yield xxhash.xxh3_64_intdigest("\x00".join(ws[k : k + SEED])) >> 1, k


class Items:
    """The held-out texts: words, which of them are their own, and rare seeds."""

    def __init__(self, rows: Iterable[tuple[int, str, str]], rare: int = 2) -> None:
        """`rows` has (id, text, group); a seed is rare where at most `rare` groups have it."""
        self.words: dict[int, list[str]] = {}
        groups: dict[int, str] = {}
        for key, text, group in rows:
            self.words[key], groups[key] = words(text), group
        owners: dict[int, set[str]] = defaultdict(set)
        for key, ws in self.words.items():
            for h, _ in seeds(ws):
                owners[h].add(groups[key])
        self.own: dict[int, np.ndarray] = {}
        rare_seeds = {h for h, x in owners.items() if len(x) <= rare}
        # seeds by word numbers: a document's words without a number cannot be in one
        names = sorted({w for ws in self.words.values() for w in ws})
        self.number = {w: k + 1 for k, w in enumerate(names)}
        by_code: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for key, ws in self.words.items():
            codes = _codes(np.array([self.number[w] for w in ws], dtype=np.uint64))
            own = np.zeros(len(ws), dtype=bool)
            for (h, k), code in zip(seeds(ws), codes.tolist(), strict=False):
                if h in rare_seeds:
                    own[k : k + SEED] = True
                    by_code[code].append((key, k))
            self.own[key] = own
        self.codes = np.array(sorted(by_code), dtype=np.uint64)
        self.places = [by_code[c] for c in self.codes.tolist()]

    def hits(self, ws: list[str]) -> Iterator[tuple[list[tuple[int, int]], int]]:
        """(places in items, position in the document) of each seed a document holds."""
        if len(ws) < SEED or not len(self.codes):
            return
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in ws), dtype=np.uint64, count=len(ws))
        known = ids > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        if not len(at):
            return
        codes = _codes(ids)[at]
        found = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        same = self.codes[found] == codes
        for f, k in zip(found[same].tolist(), at[same].tolist(), strict=True):
            yield self.places[f], k


def _codes(ids: np.ndarray) -> np.ndarray:
    """A number for each run of three word numbers (an accidental clash is settled by the alignment)."""
    p, q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    return (ids[:-2] * p + ids[1:-1]) * q + ids[2:] if len(ids) >= SEED else ids[:0]


def candidates(ws: list[str], items: Items) -> dict[int, list[tuple[int, int]]]:
    """By item the (item position, document position) of the seeds, where two lie near one diagonal."""
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for places, k in items.hits(ws):
        for key, i in places:
            hits[key].append((i, k))
    return {key: found for key, found in hits.items() if near(found)}


def near(found: list[tuple[int, int]]) -> bool:
    if len(found) < 2:
        return False
    order = sorted((d - i, d) for i, d in found)
    return any(b[0] - a[0] <= WINDOW_DRIFT and a[1] != b[1] for a, b in zip(order, order[1:], strict=False))


def align(item: list[str], doc: list[str], step: int | None = None) -> list[tuple[int, int]]:
    """The matched (item, document) positions of the best local alignment.

    The matrix is filled in block by block of `step` rows, of which the first row is kept; the way
    back fills the blocks it comes through again (not the one that was filled last).
    """
    n, m = len(item), len(doc)
    step = step or max(256, math.isqrt(n) + 1)
    kind = np.float32 if m < 2_000_000 else np.float64  # both exact for multiples of a half
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in item])
    b = np.array([ids.get(w, -1) for w in doc])
    hit, miss, gap, slope = kind(MATCH), kind(MISMATCH), kind(GAP), (GAP * np.arange(m + 1)).astype(kind)

    def block(first: np.ndarray, base: int) -> np.ndarray:
        """The rows base..base + step, of which the first is given."""
        h = np.zeros((min(step, n - base) + 1, m + 1), dtype=kind)
        h[0] = first
        for k in range(1, len(h)):
            row = np.where(b == a[base + k - 1], hit, miss)
            row += h[k - 1, :-1]
            np.maximum(row, h[k - 1, 1:] + gap, out=row)
            np.maximum(row, 0, out=h[k, 1:])
            h[k] -= slope
            np.maximum.accumulate(h[k], out=h[k])  # gaps along the row
            h[k] += slope
        return h

    first, kept, best = np.zeros(m + 1, dtype=kind), [], (0.0, 0, 0)
    h, at = first[None, :], 0
    for base in range(0, n, step):
        kept.append(first)
        h, at = block(first, base), base
        first = h[-1].copy() if base + step < n else h[-1]
        k, j = np.unravel_index(int(np.argmax(h[1:])), (len(h) - 1, m + 1))
        if h[k + 1, j] > best[0]:
            best = (float(h[k + 1, j]), base + int(k) + 1, int(j))
    _, i, j = best
    out = []
    while i > 0 and j > 0:
        base = (i - 1) // step * step
        if base != at:
            h, at = block(kept[base // step], base), base
        while i > base and j > 0 and h[i - base, j] > 0:
            here, same = h[i - base, j], b[j - 1] == a[i - 1]
            if abs(here - h[i - base - 1, j - 1] - (MATCH if same else MISMATCH)) < 1e-3:
                if same:
                    out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif abs(here - h[i - base - 1, j] - GAP) < 1e-3:
                i -= 1
            else:
                j -= 1
        if i > base:
            break  # the alignment begins here
    return out[::-1]


def stretches(at: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """(first, last) seed of each stretch of a document to align: seeds far from each other lie apart, long runs are cut with overlap.

    No passage is longer than `reach`, so each lies whole in one of the stretches.
    """
    start = 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] - at[k - 1] > reach:
            low, high = at[start], at[k - 1]
            while high - low > 2 * reach:
                yield low, low + 2 * reach
                low += reach
            yield low, high
            start = k


def score(item: list[str], own: np.ndarray, doc: list[str], found: list[tuple[int, int]], least: float) -> tuple[float, int, float, int, int]:
    """Of the best passage: share of the item it spans, own words that match, their density, first and last word in the document."""
    reach = len(item) + len(item) // 4
    best = (0.0, 0, 0.0, 0, 0)
    found = sorted(found, key=lambda x: x[1])
    at = [d for _, d in found]
    for low, high in stretches(at, reach):
        lo = max(0, low - reach)
        near_here = [i for i, _ in found[bisect_left(at, low) : bisect_right(at, high)]]
        if not near_here or max(near_here) - min(near_here) + SEED + SLACK < least * len(item):
            continue  # even with edited words around the outer seeds the passage stays too short
        pairs = align(item, doc[lo : high + SEED + reach])
        kept = [(i, d) for i, d in pairs if own[i]]
        if kept:
            span = int(own[kept[0][0] : kept[-1][0] + 1].sum())
            best = max(best, (span / len(item), len(kept), len(kept) / span, lo + kept[0][1], lo + kept[-1][1]))
    return best


def _judged(ws: list[str], item: list[str], own: np.ndarray, found: list[tuple[int, int]], least: float, least_words: int, dense: float) -> tuple | None:
    got = score(item, own, ws, found, least)
    return got if got[0] >= least and got[1] >= least_words and got[2] >= dense else None


def _texts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tid, item, grp) per distinct text, and (tid, item_id) of all items; tid is the least id of a text, grp its group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["item_id"], pdf["item"], strict=True):
                ws = words(text)
                if ws:
                    said = [xxhash.xxh3_64_intdigest("\x00".join(ws[k : k + SHINGLE])) >> 1 for k in range(max(1, len(ws) - SHINGLE + 1))]
                    rows.append((key, text, xxhash.xxh3_128_hexdigest("\x00".join(ws)), sorted(set(said))))
            yield pd.DataFrame(rows, columns=["item_id", "item", "same", "said"])

    one = items.groupBy("item_id").agg(F.max("item").alias("item"))
    read = cut(one.mapInPandas(run, "item_id long, item string, same string, said array<long>"))
    texts = cut(read.groupBy("same").agg(F.min(F.struct("item_id", "item", "said")).alias("x")).select("same", F.col("x.item_id").alias("tid"), F.col("x.item").alias("item"), F.col("x.said").alias("said")))
    members = read.join(texts.select("same", "tid"), "same").select("tid", "item_id")
    # near-equal texts: each is held against the first text of every shingle it has
    shingles = texts.select("tid", F.explode("said").alias("s"))
    first = shingles.groupBy("s").agg(F.min("tid").alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = shingles.join(first, "s").where("tid <> first").select("tid", "first").distinct()
    both = pairs.join(texts.select("tid", F.col("said").alias("x")), "tid").join(texts.select(F.col("tid").alias("first"), F.col("said").alias("y")), "first")
    common = F.size(F.array_intersect("x", "y"))
    near = cut(both.where(common >= ALIKE * (F.size("x") + F.size("y") - common)).select("tid", "first"))
    own = F.col("tid").cast("string").alias("grp")
    if near.isEmpty():
        return texts.select("tid", "item", own), members
    ends = near.select(F.encode(F.col("tid").cast("string"), "utf-8").alias("a"), F.encode(F.col("first").cast("string"), "utf-8").alias("b"), F.lit(0).cast("long").alias("w"))
    sets = forest(ends).select(F.decode("v", "utf-8").alias("v"), F.decode("root", "utf-8").alias("root"))
    grouped = texts.join(sets, F.col("tid").cast("string") == F.col("v"), "left")
    return cut(grouped.select("tid", "item", F.coalesce("root", F.col("tid").cast("string")).alias("grp"))), members


def _filter(hashes: DataFrame, bits: int = 1 << 26) -> np.ndarray:
    """A Bloom filter with one function over a column of hashes: at most a million words of 64 bits come to the driver, however many hashes there are."""
    slot = F.col("h") % bits
    words_ = hashes.groupBy(F.shiftright(slot, 6).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h % {bits}) & 63 as int))")).alias("w"))
    out = np.zeros(bits >> 6, dtype=np.int64)
    for r in words_.toLocalIterator():
        out[r["k"]] = r["w"]
    return out


def _seeded(df: DataFrame, key: str, text: str, at: str, known: Any = None) -> DataFrame:
    """(key, h, at) of every seed of every text; of those the filter `known` lets through, if there is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = known.value if known is not None else None
        for pdf in batches:
            for k, t in zip(pdf[key], pdf[text], strict=True):
                got = list(seeds(words(t)))
                if not got:
                    continue
                h, i = (np.fromiter((x[c] for x in got), dtype=np.int64, count=len(got)) for c in (0, 1))
                if bits is not None:
                    slot = h % (len(bits) << 6)
                    ok = (bits[slot >> 6] >> (slot & 63)) & 1 == 1
                    h, i = h[ok], i[ok]
                yield pd.DataFrame({key: np.full(len(h), k, dtype=np.int64), "h": h, at: i})

    return df.select(key, text).mapInPandas(run, f"{key} long, h long, {at} int")


def _by_shuffle(docs: DataFrame, texts: DataFrame, rare: int, least: float, least_words: int, dense: float, schema: str, columns: list[str]) -> DataFrame:
    """Documents and texts of items meet on the seeds that at most `rare` groups share."""
    of_items = cut(_seeded(texts, "tid", "item", "i").join(texts.select("tid", "grp"), "tid"))
    exact = of_items.groupBy("h").agg(F.countDistinct("grp").alias("n")).where(F.col("n") <= rare).select("h")
    rare_seeds = cut(of_items.join(exact, "h").select("tid", "h", "i"))
    known = docs.sparkSession.sparkContext.broadcast(_filter(rare_seeds))
    hits = _seeded(docs, "doc_id", "text", "d", known).join(rare_seeds, "h")
    pairs = hits.groupBy("doc_id", "tid").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    own = rare_seeds.groupBy("tid").agg(F.collect_list("i").alias("own"))  # no longer than the item
    joined = docs.join(pairs, "doc_id").join(texts, "tid").join(own, "tid")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, tid, text, item, own_at in zip(pdf["doc_id"], pdf["tid"], pdf["text"], pdf["item"], pdf["own"], strict=True):
                ws, iw = words(text), words(item)
                mask, places, rare_at = np.zeros(len(iw), dtype=bool), defaultdict(list), set(own_at)
                for h, i in seeds(iw):
                    if i in rare_at:
                        mask[i : i + SEED] = True
                        places[h].append(i)
                at = [(i, d) for h, d in seeds(ws) for i in places.get(h, ())]
                if near(at) and (got := _judged(ws, iw, mask, at, least, least_words, dense)):
                    rows.append((key, tid, *got))
            yield pd.DataFrame(rows, columns=columns)

    return joined.select("doc_id", "tid", "text", "item", "own").mapInPandas(judge, schema)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = 0.2,
    least_words: int = 12,
    dense: float = 0.7,
    rare: int = 2,
    in_task_chars: int = 20_000_000,
) -> DataFrame:
    """(doc_id, item_id, share, matched, density, within) of the documents that hold a passage of an item.

    The passage spans at least the share `least` of the item in its own words (a third of a text whose
    phrases are partly shared keeps about a quarter), with at least `least_words` of the
    item's own words and a share `dense` of those within the span.  Where more than half of it lies in
    a passage of an item of another group with more words matched, `within` names that item's least
    id (items are built from like phrases); else it is null.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0))
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item")).where(F.col("item_id").isNotNull() & (F.length(F.trim("item")) > 0))
    texts, members = _texts(items)
    schema = "doc_id long, tid long, share double, matched int, density double, low int, high int"
    columns = ["doc_id", "tid", "share", "matched", "density", "low", "high"]
    size = texts.agg(F.sum(F.length("item"))).first()[0] or 0
    if size <= in_task_chars:
        sent = spark.sparkContext.broadcast(Items(((r["tid"], r["item"], r["grp"]) for r in texts.orderBy("tid").toLocalIterator()), rare))

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = sent.value
            for pdf in batches:
                rows = []
                for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    ws = words(text)
                    for item, found in candidates(ws, known).items():
                        if got := _judged(ws, known.words[item], known.own[item], found, least, least_words, dense):
                            rows.append((key, item, *got))
                yield pd.DataFrame(rows, columns=columns)

        out = spread(docs).mapInPandas(whole, schema)
    else:
        out = _by_shuffle(docs, texts, rare, least, least_words, dense, schema, columns)
    best = cut(out.groupBy("doc_id", "tid").agg(F.max(F.struct("share", "matched", "density", "low", "high")).alias("x")).select("doc_id", "tid", "x.*").join(texts.select("tid", "grp"), "tid"))
    other = best.select("doc_id", F.col("tid").alias("t2"), F.col("grp").alias("g2"), F.col("matched").alias("m2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    common = F.least("high", "h2") - F.greatest("low", "l2") + 1
    inner = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("m2") > F.col("matched")) & (F.col("g2") != F.col("grp")) & (common * 2 > F.col("high") - F.col("low") + 1)
    longer = best.alias("a").join(other.alias("b"), inner, "left").groupBy("a.doc_id", "tid").agg(F.first("share").alias("share"), F.first("matched").alias("matched"), F.first("density").alias("density"), F.min("t2").alias("within"))
    return longer.join(members, "tid").select("doc_id", "item_id", "share", "matched", "density", "within")


def found(leaked: DataFrame, whole: float = 0.5) -> DataFrame:
    """(doc_id, item_id): the leaks that are not a part of another item's passage, and those that are but span the share `whole` of their item."""
    return leaked.where(F.col("within").isNull() | (F.col("share") >= whole)).select("doc_id", "item_id")
