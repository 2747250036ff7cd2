"""One repository's tables as a knowledge base: lookups that give frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.functions import text as T
from gnomon.functions import vectors
from gnomon.operators import retrieval
from gnomon.sources.store import Store


class KnowledgeBase:
    """Lookups by name, file and text; unknown names give empty frames."""

    def __init__(self, tables: retrieval.Tables, metadata: DataFrame | None = None, store: Store | None = None) -> None:
        self.t, self.metadata, self.store = tables, metadata, store

    # symbols
    def symbol(self, name: str) -> DataFrame:
        """The last definition of a qualified name."""
        return self.t.symbols.where(F.col("qualified_name") == name).orderBy(F.desc("sym_ord")).limit(1)

    def symbols_named(self, short: str) -> DataFrame:
        return self.t.symbols.where(T.short_name(F.col("qualified_name")) == short).orderBy("sym_ord")

    def symbols_in(self, path: str) -> DataFrame:
        return self.t.symbols.where(F.col("file_path") == path).orderBy("sym_ord")

    def all_symbols(self) -> DataFrame:
        return self.t.symbols

    def names(self) -> DataFrame:
        """Distinct qualified names; an overloaded name counts once."""
        return self.t.symbols.select("qualified_name").distinct()

    def module(self, name: str) -> DataFrame:
        """(path): the first file of a module name."""
        f = self.t.files.where(T.module_name(F.col("path")) == name)
        return f.orderBy("file_id").limit(1).select("path")

    # edges
    def callers_of(self, name: str) -> DataFrame:
        return self.t.calls.where(F.col("callee_qualified_name") == name).orderBy("edge_ord")

    def callees_of(self, name: str) -> DataFrame:
        return self.t.calls.where(F.col("caller_qualified_name") == name).orderBy("edge_ord")

    def imports_of(self, path: str) -> DataFrame:
        return self.t.imports.where(F.col("importer_file") == path).orderBy("edge_ord")

    def importers_of(self, path: str) -> DataFrame:
        return self.t.imports.where(F.col("resolved_file") == path).orderBy("edge_ord")

    def bases_of(self, name: str) -> DataFrame:
        return self.t.inherits.where(F.col("class_qualified_name") == name).orderBy("edge_ord")

    def subclasses_of(self, name: str) -> DataFrame:
        return self.t.inherits.where(F.col("base_qualified_name") == name).orderBy("edge_ord")

    def all_imports(self) -> DataFrame:
        return self.t.imports

    def all_calls(self) -> DataFrame:
        return self.t.calls

    def all_inherits(self) -> DataFrame:
        return self.t.inherits

    # texts
    def source(self, name: str) -> DataFrame:
        return self.t.sources.where(F.col("qualified_name") == name).select("source")

    def file_source(self, path: str) -> DataFrame:
        return self.t.files.where(F.col("path") == path).select("content")

    def files(self) -> DataFrame:
        return self.t.files.select("path").distinct().orderBy("path")

    def search(self, query: str, k: int = 8) -> DataFrame:
        """The chunks nearest to a text, with their distance."""
        spark = self.t.chunks.sparkSession
        q = spark.createDataFrame([(0, query)], "query_id long, text string").select("query_id", self.t.embed(F.col("text")).alias("embedding"))
        hits = vectors.nearest(self.t.chunks.select(F.col("chunk_ord").alias("id"), self.t.embed(F.col("content")).alias("embedding")), q, k)
        return hits.join(self.t.chunks.withColumnRenamed("id", "chunk_id").withColumnRenamed("chunk_ord", "id"), "id").orderBy("rank")

    def exact(self, name: str, limit: int = 8) -> DataFrame:
        return retrieval.exact(self.t.chunks, name, limit)

    def lexical(self, needle: str, limit: int = 8) -> DataFrame:
        return retrieval.lexical(self.t.chunks, needle, limit)

    # metadata
    def set_summary(self, summary: str) -> None:
        """Replaces the summary, here and in the store."""
        self.metadata = self.metadata.withColumn("summary", F.lit(summary))
        if self.store is not None:
            rows = self.metadata.collect()  # one row a repository
            frame = self.metadata.sparkSession.createDataFrame(rows, self.metadata.schema)
            self.store.write("repo_metadata", frame)
            self.metadata = frame


class Registry:
    """Knowledge bases by repository, kept until they are invalidated."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self._kept: dict[str, KnowledgeBase] = {}

    def get(self, repo: str) -> KnowledgeBase:
        if repo not in self._kept:
            from gnomon.service import tables

            self._kept[repo] = KnowledgeBase(tables(self.store, repo), self.store.read("repo_metadata", repo), self.store)
        return self._kept[repo]

    def invalidate(self, repo: str) -> None:
        self._kept.pop(repo, None)
