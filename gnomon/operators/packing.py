"""Length-ordered batches under a token budget, without passing the rows through one task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.session import cut


def positions(df: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """`df` with `position`: its place, from 0, in the order of `keys`, by a range shuffle and per-task counts."""
    spark = df.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).orderBy("_p").collect()  # one number per task
    before, total = {}, 0
    for r in counts:
        before[r["_p"]] = total
        total += r["n"]
    if not before:
        return placed.withColumn("position", F.lit(0).cast("long")).drop("_m")
    starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    return placed.withColumn("position", starts[part] + at).drop("_m")


def _runs(pdf: pd.DataFrame, group: str, most: int, budget: int) -> pd.DataFrame:
    """The batches of one group from its histogram of lengths, as runs of equal ones: (group, batch, first row, rows per batch, batches).

    There are at most three runs per length, however many rows have it.
    """
    rows, batch, start, size = [], 0, 0, 0
    for length, count in sorted(zip(pdf["length"], pdf["n"], strict=True)):
        left, room = int(count), most if not length else max(1, min(most, int(budget // length)))  # a row longer than the budget is a batch of its own
        if size and (take := min(room - size, left)) > 0:  # what the open batch still takes
            size, left = size + take, left - take
        if not left:
            continue
        if size:
            rows.append((batch, start, size, 1))
            batch, start, size = batch + 1, start + size, 0
        full, size = divmod(left, room)
        if full and not size:  # the last one stays open for rows that follow
            full, size = full - 1, room
        if full:
            rows.append((batch, start, room, full))
            batch, start = batch + full, start + full * room
    if size:
        rows.append((batch, start, size, 1))
    out = pd.DataFrame(rows, columns=["batch", "first", "size", "batches"])
    out.insert(0, group, pdf[group].iloc[0])
    return out


def pack(df: DataFrame, group: str, row_id: str, length: str, most: int = 32, budget: int = 8192) -> DataFrame:
    """(group, row_id, length, batch): a new batch begins where one more row would exceed `most` rows or rows x longest > `budget`.

    Rows go in the order of length, then id.  Only the histogram of lengths (bounded by the longest
    length) is folded in one task per group; rows find their batch by their rank.  A null group is
    a group; rows with a null length or id are left out; repeated ids are packed once per row.
    """
    src = df.where(F.col(length).isNotNull() & F.col(row_id).isNotNull()).select(F.col(group).alias("g"), F.col(row_id).alias("r"), F.col(length).cast("long").alias("length"))
    ranked = positions(src, ["g", "length", "r"])
    lows = ranked.groupBy("g").agg(F.min("position").alias("low"))
    hist = ranked.groupBy("g", "length").agg(F.count("*").alias("n"))
    kind = src.schema["g"].dataType.simpleString()
    runs = hist.groupBy("g").applyInPandas(lambda pdf: _runs(pdf, "g", most, budget), f"g {kind}, batch long, first long, size long, batches long")
    places = runs.select(F.col("g").alias("g2"), "batch", "first", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") * F.col("size") - 1)).alias("k"))
    places = places.select("g2", (F.col("batch") + F.floor(F.col("k") / F.col("size"))).alias("batch"), (F.col("first") + F.col("k")).alias("place"))
    rows = ranked.join(lows.withColumnRenamed("g", "g3"), F.col("g").eqNullSafe(F.col("g3"))).withColumn("_place", F.col("position") - F.col("low"))
    out = rows.join(places, F.col("g").eqNullSafe(F.col("g2")) & (F.col("_place") == F.col("place")))
    return out.select(F.col("g").alias(group), F.col("r").alias(row_id), "length", "batch")
