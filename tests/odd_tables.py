"""Folders of tables for the tests: empty ones, and ones with null rows, repeated rows and extra columns."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = ("source_files", "symbols", "chunks", "import_edges", "call_edges", "inherits_edges", "repo_metadata", "documents", "doc_labels", "eval_items", "embeddings")
EXTRA = ("g", "v", "c", "p", "root", "name", "reason", "hash", "ids", "score", "share", "item", "text_", "record_id", "line_no", "_m", "position", "batch")


def build(spark, folder):
    """(empty, odd)."""
    empty, odd = f"{folder}/empty", f"{folder}/odd"
    for name in NAMES:
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
        nulls = spark.range(2).select(*[F.lit(None).cast(t).alias(n) for n, t in df.dtypes])
        key = df.columns[0]
        holes = df.limit(3).select(key, *[F.lit(None).cast(t).alias(n) for n, t in df.dtypes[1:]]).withColumn(key, F.col(key) + 1_000_000)
        both = df.unionByName(df.limit(5)).unionByName(nulls).unionByName(holes)
        for n in EXTRA:
            if n not in both.columns:
                both = both.withColumn(n, F.lit("extra"))
        both.repartition(3).write.parquet(f"{odd}/{name}.parquet")
    return empty, odd
