"""The tables the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The column that is unique once repeated rows are dropped.
KEYS = {
    "source_files": "file_id", "symbols": "sym_ord", "chunks": "chunk_ord", "import_edges": "edge_ord", "call_edges": "edge_ord", "inherits_edges": "edge_ord",
    "repo_metadata": "ingest_id", "documents": "doc_id", "eval_items": "item_id", "embeddings": "vec_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table's key and `columns` without repeated rows."""
    df = table(spark, sf_dir, name)
    key = KEYS[name]
    return (df.select(key, *(c for c in columns if c != key)) if columns else df).dropDuplicates([key])
