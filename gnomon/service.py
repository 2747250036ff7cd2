"""Ingest, ask and analyze: the operators put together for a store of repositories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.operators import answers, insights, parse, planning, resolve, retrieval
from gnomon.sources.scan import NothingTracked, scan, tracked
from gnomon.sources.store import SCHEMA_VERSION, GnomonError, Store
from gnomon.session import cut


class IngestionFailed(GnomonError):
    """Nothing usable could be read."""


class UnknownCategory(GnomonError, ValueError):
    """There is no such analyzer."""


CATEGORIES = ("dead_code", "circular_dependency", "complexity", "todo", "architecture")


def ingest(spark: SparkSession, root: str, repo: str, store: Store, files: DataFrame | None = None) -> None:
    """Parses a repository once and replaces its tables; of a git repository on this machine only what git tracks."""
    if files is not None:
        found = files
    else:
        try:
            found = scan(spark, root, repo, tracked=None if "://" in root else tracked(spark, root))
        except NothingTracked as e:
            raise IngestionFailed(f"git tracks no file below {root}") from e
    found = cut(found.withColumn("file_id", F.xxhash64("repo", "path")))
    if found.isEmpty():
        raise IngestionFailed(f"no readable source files below {root}")
    parsed = cut(parse.parse(found))
    order = F.xxhash64("repo", "file_path").bitwiseAND((1 << 40) - 1) * 1_000_000 + F.col("ord")
    sym = parse.symbols(parsed).withColumn("sym_ord", order).drop("ord")
    calls = parse.calls(parsed).withColumn("edge_ord", order).drop("ord")
    bases = parse.bases(parsed).withColumn("edge_ord", order).drop("ord")
    modules = resolve.module_map(found, "file_id")
    imports = resolve.resolve_imports(parse.imports(parsed), modules)
    imports = imports.withColumn("edge_ord", F.xxhash64("repo", "importer_file").bitwiseAND((1 << 40) - 1) * 1_000_000 + F.col("ord"))
    calls = resolve.resolve_names(calls, sym, "callee_name", "callee_qualified_name", F.col("enclosing_class"), F.col("file_path"))
    bases = resolve.resolve_names(bases, sym, "base_name", "base_qualified_name", None, F.col("file_path"))
    chunks = parse.chunks(parsed).withColumn("chunk_ord", order).drop("ord")
    meta = found.groupBy("repo").agg(F.sort_array(F.collect_list("path")).alias("files"))
    meta = meta.join(sym.groupBy("repo").agg(F.count("*").cast("int").alias("symbol_count")), "repo", "left").na.fill(0, ["symbol_count"])
    meta = meta.select("repo", F.lit(root).alias("source"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ingested_at"), "files", "symbol_count", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(None).cast("string").alias("summary"))
    for name, df in (
        ("files", found), ("symbols", sym), ("sources", resolve.symbol_sources(sym, found)),
        ("import_edges", imports.select("repo", "edge_ord", "importer_file", "imported_module", "resolved_file")),
        ("call_edges", calls.select("repo", "edge_ord", "caller_qualified_name", "callee_name", "callee_qualified_name", "file_path", "line")),
        ("inherits_edges", bases.select("repo", "edge_ord", "class_qualified_name", "base_name", "base_qualified_name")),
        ("chunks", chunks), ("repo_metadata", meta),
    ):
        store.write(name, df)


def tables(store: Store, repo: str) -> retrieval.Tables:
    store.check(repo)
    names = ("files", "symbols", "sources", "import_edges", "call_edges", "inherits_edges", "chunks")
    return retrieval.Tables(*(store.read(n, repo) for n in names))


def analyze(t: retrieval.Tables, category: str | None = None) -> tuple[DataFrame | None, list[str], list[tuple[str, str]]]:
    """Findings, the analyzers that ran and warnings; one category's only, if it is named."""
    if category is not None and category not in CATEGORIES:
        raise UnknownCategory(f"unknown category {category}")
    every = {
        "dead_code": lambda: insights.dead_code(t.symbols, t.calls),
        "circular_dependency": lambda: insights.circular_dependencies(t.imports),
        "complexity": lambda: insights.complexity(t.symbols, t.sources),
        "todo": lambda: insights.todos(t.files),
        "architecture": lambda: insights.architecture(t.files, t.symbols, t.imports),
    }
    return insights.report({k: f for k, f in every.items() if category in (None, k)})


def ask(spark: SparkSession, t: retrieval.Tables, repo: str, question: str, planner: Callable[[str], str] | None = None, reasoner: Callable[[str, str], str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answer, citations, issues) of one question.

    `planner` gives the plan's JSON (rules plan where there is none); `reasoner` gets question and evidence and gives the answer's
    JSON, tried twice; without one, or if it fails twice, the answer is made of extracts or empty.
    """
    asked = spark.createDataFrame([(0, repo, question, planner(question) if planner else None)], "qid long, repo string, question string, arguments string")
    plans = retrieval.parse_plans(asked) if planner else planning.plan(asked.drop("arguments"))
    evidence, _ = retrieval.execute(t, plans)
    evidence = cut(evidence)
    if reasoner is None:
        out = answers.extracts(evidence)
    else:
        row = answers.prompts(evidence).first()
        text, said = row["evidence_text"] if row else "(no evidence retrieved)", None
        for _ in range(2):
            try:
                said = reasoner(question, text)
                break
            except Exception:  # noqa: BLE001
                continue
        out = spark.createDataFrame([(0, said)], "qid long, output string")
    parsed = answers.parse(out)
    return parsed, answers.citations(parsed, evidence), answers.issues(parsed, evidence)
