"""Vectors: distances, a hashing embedder, and exact nearest neighbours of a stated query set."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

TOKEN = "[A-Za-z]+|[0-9]+"
_TOKEN = re.compile(TOKEN)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def truncated(text: Column, most: int = 4096) -> Column:
    """A text's first `most` tokens, for models that take no more; shorter texts are left as they are."""
    found = tokens(text)
    return F.when(F.size(found) > most, F.array_join(F.slice(found, 1, most), " ")).otherwise(text)


def hashed(text: str | None, dim: int, places: dict[str, tuple[int, float]]) -> list[float]:
    """A unit vector of hashed words; all zero for a text without words.  `places` keeps what words hash to."""
    v = np.zeros(dim)
    for w in _TOKEN.findall(text or ""):
        at = places.get(w)
        if at is None:
            h = int(hashlib.md5(w.lower().encode()).hexdigest()[:8], 16)
            if len(places) > 500_000:
                places.clear()
            at = places[w] = (h % dim, 1.0 if h & 0x80000000 else -1.0)
        v[at[0]] += at[1]
    v = np.sign(v) * np.log1p(np.abs(v))
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def embed(text: Column, dim: int = 256) -> Column:
    """The default embedder; a model is another function from a text column to a vector column."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        places: dict[str, tuple[int, float]] = {}
        return texts.map(lambda t: hashed(t, dim, places))

    return run.asNondeterministic()(text)  # so that it is not evaluated in a filter and again after it


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 8, row_id: str = "id", query_id: str = "query_id", vector: str = "embedding", within: str | None = None, row_block: int = 16_384, query_block: int = 4096
) -> DataFrame:
    """(query_id, row_id, distance, rank): each query's k nearest rows by cosine distance, ties by row id.

    `queries` is a stated set; every row is compared with every query of its `within` group (all
    rows without one).  Groups are cut into blocks of rows and of queries by the size they have, and
    each block of rows meets each block of queries in one task, which keeps the k best per query;
    neither passes through the driver.  Rows and queries whose vector is null, empty, without length
    or of another dimension than the other's match nothing; null groups match nothing.
    """

    def side(df: DataFrame, key: str, size: int, mine: str) -> tuple[DataFrame, DataFrame]:
        group = F.col(within) if within else F.lit("")
        blocks = df.groupBy(group.alias("w")).agg(F.ceil(F.count("*") / size).cast("int").alias(f"{mine}s"))
        src = df.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), group.alias("w"), F.col(vector).cast("array<double>").alias("v"))
        return src, blocks

    r, r_blocks = side(rows, row_id, row_block, "r")
    q, q_blocks = side(queries, query_id, query_block, "q")
    blocks = r_blocks.join(q_blocks, "w")  # a row per group
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = r.join(blocks, "w").select("id", "w", "v", F.size("v").alias("dim"), place("rs").alias("rb"), every("qs").alias("qb"))
    q = q.join(blocks, "w").select("id", "w", "v", F.size("v").alias("dim"), place("qs").alias("qb"), every("rs").alias("rb"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        (qi, qv), (ri, rv) = _matrix(left), _matrix(right)
        if not len(qi) or not len(ri):
            return pa.table({"q": pa.array([], pa.int64()), "r": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        d = 1.0 - qv @ rv.T
        if len(ri) > 4 * k:  # those that may be among the k best
            limit = np.partition(d, k - 1, axis=1)[:, k - 1]
            at, col = np.nonzero(np.round(d, 12) <= np.round(limit, 12)[:, None])
        else:
            at, col = (x.ravel() for x in np.indices(d.shape))
        distance = d[at, col]
        order = np.lexsort((ri[col], np.round(distance, 12), at))
        at, col, distance = at[order], col[order], distance[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < k
        return pa.table({"q": qi[at[keep]], "r": ri[col[keep]], "distance": distance[keep]})

    keys = ("w", "dim", "rb", "qb")
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(best, "q long, r long, distance double")
    w = Window.partitionBy("q").orderBy(F.round("distance", 12), "r")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "distance", "rank")


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors, without those that have no length."""
    v = t.column("v").combine_chunks()
    m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    ok = n[:, 0] > 0
    return t.column("id").to_numpy()[ok], m[ok] / n[ok]
