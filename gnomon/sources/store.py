"""Tables of ingested repositories, one folder per table, partitioned by repository."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions import text as T

SCHEMA_VERSION = 1
TABLES = {
    "files": "path string, absolute_path string, content string, line_count int, file_id long",
    "symbols": "file_path string, qualified_name string, kind string, start_line int, end_line int, signature string, docstring string, decorators array<string>, sym_ord long",
    "sources": "qualified_name string, source string",
    "import_edges": "edge_ord long, importer_file string, imported_module string, resolved_file string",
    "call_edges": "edge_ord long, caller_qualified_name string, callee_name string, callee_qualified_name string, file_path string, line int",
    "inherits_edges": "edge_ord long, class_qualified_name string, base_name string, base_qualified_name string",
    "chunks": "id string, file_path string, chunk_type string, qualified_name string, start_line int, end_line int, content string, docstring string, chunk_ord long",
    "repo_metadata": "source string, ingested_at string, files array<string>, symbol_count int, schema_version int, summary string",
}


class GnomonError(Exception):
    """Base of what the service and the command line raise on purpose."""


class NotIngested(GnomonError):
    """No run has stored this repository."""


class SchemaMismatch(GnomonError):
    """A repository was stored by another version."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces the repositories that `df` holds and leaves the others as they are."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(f"{self.root}/{name}")

    def read(self, name: str, repo: str | None = None) -> DataFrame | None:
        """A table, or None where nothing was ever written."""
        try:
            df = self.spark.read.schema(f"{TABLES[name]}, repo string").parquet(f"{self.root}/{name}")
        except AnalysisException:
            return None
        if name == "chunks":  # an empty text is none
            df = df.withColumn("docstring", F.nullif("docstring", F.lit("")))
        return df if repo is None else df.where(F.col("repo") == repo)

    def repos(self) -> list[str]:
        df = self.read("repo_metadata")
        return [] if df is None else [r[0] for r in df.select("repo").distinct().orderBy("repo").collect()]

    def collections(self) -> list[str]:
        """The slugs of the repositories that have chunks."""
        df = self.read("chunks")
        return [] if df is None else [r[0] for r in df.select(T.slug(F.col("repo")).alias("slug")).distinct().orderBy("slug").collect()]

    def has(self, repo: str) -> bool:
        """Whether a repository has chunks."""
        df = self.read("chunks", repo)
        return df is not None and not df.isEmpty()

    def check(self, repo: str) -> None:
        df = self.read("repo_metadata", repo)
        row = None if df is None else df.select("schema_version").first()
        if row is None:
            raise NotIngested(repo)
        if row[0] != SCHEMA_VERSION:
            raise SchemaMismatch(f"{repo}: schema version {row[0]}, expected {SCHEMA_VERSION}")
