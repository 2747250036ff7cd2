"""Evidence for questions: plans are tables of steps, and every strategy answers all steps at once.

`plans` has qid, repo, question, max_results and steps (array of strategy, target, query,
direction).  Evidence rows of all strategies have the columns of EVIDENCE; `ord` orders a
question's items as its steps name them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gnomon.functions import text as T
from gnomon.functions import vectors
from gnomon.session import cut

EVIDENCE = ["qid", "repo", "ord", "source", "qualified_name", "file_path", "start_line", "end_line", "content", "explanation", "confidence"]
STRATEGIES = ("symbol_lookup", "semantic_search", "call_graph", "import_graph", "hierarchy")
DIRECTIONS = ("callers", "callees", "imports", "importers", "bases", "subclasses", "both")
RESOLVED, AMBIGUOUS, UNRESOLVED = 1.0, 0.6, 0.3
EDGES_PER_TARGET = 20
STEP = "strategy: string, target: string, query: string, direction: string"
PLAN = "struct<steps: array<struct<strategy: string, target: string, query: string, direction: string>>, intent: string, priority: string, max_results: int>"


@dataclass
class Tables:
    """What the strategies read: one repository's tables or those of many."""

    files: DataFrame
    symbols: DataFrame
    sources: DataFrame
    imports: DataFrame
    calls: DataFrame
    inherits: DataFrame
    chunks: DataFrame
    embed: Callable[[Column], Column] = vectors.embed  # of texts; a model is another one


# ---- plans ---------------------------------------------------------------------


def parse_plans(arguments: DataFrame, column: str = "arguments") -> DataFrame:
    """Tool arguments (JSON text) to plans: unknown strategies go, odd directions and caps become null.

    What holds no usable step becomes the fallback plan: one semantic step over the question.
    """
    p = F.from_json(column, PLAN)
    steps = F.filter(F.coalesce(p["steps"], F.from_json(F.lit("[]"), f"array<struct<{STEP}>>")), lambda s: s["strategy"].isin(*STRATEGIES))
    steps = F.transform(
        steps,
        lambda s: F.struct(s["strategy"].alias("strategy"), s["target"].alias("target"), s["query"].alias("query"), F.when(s["direction"].isin(*DIRECTIONS), s["direction"]).alias("direction")),
    )
    fallback = F.array(F.struct(F.lit("semantic_search").alias("strategy"), F.lit(None).cast("string").alias("target"), F.col("question").alias("query"), F.lit(None).cast("string").alias("direction")))
    out = arguments.withColumn("_s", steps).withColumn("_p", p)
    usable = F.size("_s") > 0
    return out.select(
        "qid", "repo", "question", F.when(usable, F.col("_s")).otherwise(fallback).alias("steps"), F.when(usable, F.coalesce(F.col("_p.intent"), F.lit("unknown"))).otherwise(F.lit("fallback")).alias("intent"),
        F.when(usable & (F.col("_p.max_results") > 0), F.col("_p.max_results")).alias("max_results"),
    )


def steps_of(plans: DataFrame) -> DataFrame:
    return plans.select("qid", "repo", "question", F.posexplode("steps").alias("step", "s")).select("qid", "repo", "question", "step", "s.*")


# ---- targets -------------------------------------------------------------------


def candidates(symbols: DataFrame, steps: DataFrame) -> DataFrame:
    """Symbols that each step's target may mean: (qid, repo, step, target, direction, found, confidence, symbol columns).

    An exact name means one symbol (the last of its definitions); else all of that short name; else,
    for dotted targets, all names that end in it.  Only targets without an exact symbol go on to the
    ends of names, of which the short name is the shortest; ends are a column to join on, not a scan.
    """
    cols = ["sym_ord", "qualified_name", "kind", "file_path", "start_line", "end_line", "signature"]
    s = symbols.where(F.col("qualified_name").isNotNull()).select("repo", *cols)
    t = steps.where(F.col("target").isNotNull()).select("qid", "step", "repo", "target", "direction")
    last = s.groupBy("repo", F.col("qualified_name").alias("target")).agg(F.max_by(F.struct(*cols), "sym_ord").alias("s"))
    # what has an exact symbol gets a key that meets nothing
    onward = F.when(F.col("s").isNull(), F.col("target")).otherwise(F.concat(F.lit("\x00"), F.xxhash64("qid", "step").cast("string")))
    first = t.join(last, ["repo", "target"], "left").withColumn("key", onward)
    parts = F.split("qualified_name", r"\.")
    ends = F.transform(F.sequence(F.least(F.lit(2), F.size(parts)), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    by_end = s.select("repo", F.explode(ends).alias("key"), F.struct(*cols).alias("s2"))
    both = first.join(by_end, ["repo", "key"], "left").withColumn("s", F.coalesce("s", "s2")).where(F.col("s").isNotNull())
    both = both.withColumn("found", F.count("*").over(Window.partitionBy("qid", "step")))
    confidence = F.when(F.col("found") == 1, F.lit(RESOLVED)).otherwise(F.lit(AMBIGUOUS))
    return both.select("qid", "repo", "step", "target", "direction", "found", confidence.alias("confidence"), "s.*")


def file_targets(files: DataFrame, steps: DataFrame, order: str = "file_id") -> DataFrame:
    """(qid, step, repo, direction, path): exact path, else module name (its first file), else a base name that only one file has."""
    t = steps.where(F.col("target").isNotNull()).select("qid", "step", "repo", "target", "direction")
    f = files.select("repo", "path", F.col(order).alias("_o"))
    exact = f.select("repo", F.col("path").alias("target"), F.col("path").alias("p1")).distinct()
    module = f.groupBy("repo", T.module_name(F.col("path")).alias("target")).agg(F.min_by("path", "_o").alias("p2"))
    base = f.groupBy("repo", T.base_name(F.col("path")).alias("target")).agg(F.countDistinct("path").alias("n"), F.min("path").alias("p3")).where("n = 1").drop("n")
    j = t.join(exact, ["repo", "target"], "left").join(module, ["repo", "target"], "left").join(base, ["repo", "target"], "left")
    path = F.coalesce("p1", "p2", F.when(F.instr("target", "/") == 0, F.col("p3")))
    return j.withColumn("path", path).where(F.col("path").isNotNull()).select("qid", "step", "repo", "target", "direction", "path")


# ---- strategies ----------------------------------------------------------------


def _evidence(df: DataFrame, source: str, order: list[Column], name: Column, path: Column, first: Column, last: Column, content: Column, explanation: Column, confidence: Column) -> DataFrame:
    ordinal = F.array(*[x.cast("long") for x in (F.col("step"), *order)])
    return df.select(
        "qid", "repo", ordinal.alias("ord"), F.lit(source).alias("source"), name.alias("qualified_name"), path.alias("file_path"), first.cast("int").alias("start_line"), last.cast("int").alias("end_line"),
        content.alias("content"), explanation.alias("explanation"), confidence.cast("double").alias("confidence"),
    )


def _with_source(df: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    s = sources.select(F.col("repo").alias("_r"), F.col("qualified_name").alias("_q"), F.col("source").alias("_source"))
    return df.join(s, (F.col("repo") == F.col("_r")) & (F.col(name) == F.col("_q")), "left").drop("_r", "_q")


def symbol_evidence(t: Tables, steps: DataFrame) -> DataFrame:
    c = _with_source(candidates(t.symbols, steps), t.sources, "qualified_name")
    text = F.when(F.col("confidence") == RESOLVED, F.concat(F.lit("Exact match for '"), F.col("target"), F.lit("'"))).otherwise(
        F.concat(F.lit("Possible match for '"), F.col("target"), F.lit("' (ambiguous short name, "), F.col("found").cast("string"), F.lit(" candidates)"))
    )
    return _evidence(c, "symbol", [F.col("sym_ord")], F.col("qualified_name"), F.col("file_path"), F.col("start_line"), F.col("end_line"), T.source_or(F.col("_source"), F.col("signature")), text, F.col("confidence"))


def _wanted(c: DataFrame, kind: str, other: str) -> DataFrame:
    """Rows whose direction is `kind`; one that is neither of the two means both."""
    return c.where(~F.coalesce(F.col("direction") == other, F.lit(False)))


def _ends(edges: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Every edge once for each of its ends: `node` is the end and `side` which of the two names it has."""
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(n).alias("node")) for k, n in enumerate(names)])
    return edges.select("*", F.explode(sides).alias("x")).select(*edges.columns, "x.*").where(F.col("node").isNotNull())


def _facing(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of the side (0 or 1) that the direction asks for; a direction that names neither means both."""
    other = F.when(F.col("side") == 0, F.lit(second)).otherwise(F.lit(first))
    return df.where(~F.coalesce(F.col("direction") == other, F.lit(False)))


def call_evidence(t: Tables, steps: DataFrame) -> DataFrame:
    """Callers and callees, the first twenty edges per target and direction."""
    c = candidates(t.symbols, steps).select("qid", "repo", "step", "direction", "sym_ord", "confidence", F.col("qualified_name").alias("node"))
    e = t.calls.select("repo", "edge_ord", "caller_qualified_name", "callee_name", "callee_qualified_name", F.col("file_path").alias("at"), "line")
    x = _facing(c.join(_ends(e, ("callee_qualified_name", "caller_qualified_name")), ["repo", "node"]), "callers", "callees")
    w = Window.partitionBy("qid", "step", "node", "sym_ord", "side").orderBy("edge_ord")
    x = x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= EDGES_PER_TARGET)
    is_caller, resolved = F.col("side") == 0, F.col("callee_qualified_name").isNotNull()
    x = _with_source(x.withColumn("shown", F.when(is_caller, F.col("caller_qualified_name")).otherwise(F.col("callee_qualified_name"))), t.sources, "shown")
    target, line = F.coalesce("callee_qualified_name", "callee_name"), F.col("line").cast("string")
    fallback = F.when(is_caller, F.concat(F.col("caller_qualified_name"), F.lit(" calls this at line "), line)).otherwise(F.concat(F.col("caller_qualified_name"), F.lit(" calls "), target, F.lit(" at line "), line))
    calls = F.concat(F.lit("Calls "), target, F.lit(" (line "), line, F.lit(")"))
    called = F.concat(F.lit("Called by "), F.col("caller_qualified_name"), F.lit(" (line "), line, F.lit(")"), F.when(resolved, F.lit("")).otherwise(F.lit(" - target not resolved to a known symbol")))
    trust = F.when(is_caller | resolved, F.col("confidence")).otherwise(F.least(F.col("confidence"), F.lit(UNRESOLVED)))
    return _evidence(
        x, "call_graph", [F.col("sym_ord"), F.col("side"), F.col("edge_ord")], F.col("shown"), F.col("at"), F.col("line"), F.col("line"), T.source_or(F.col("_source"), fallback), F.when(is_caller, calls).otherwise(called), trust
    )


def import_evidence(t: Tables, steps: DataFrame) -> DataFrame:
    """What a file imports and what imports it."""
    f = file_targets(t.files, steps)
    e = t.imports.select("repo", "edge_ord", "importer_file", "imported_module", "resolved_file")
    none, resolved = F.lit(None), F.col("resolved_file").isNotNull()
    a = _wanted(f, "imports", "importers").join(e.withColumn("path", F.col("importer_file")), ["repo", "path"])
    text = F.concat(F.col("importer_file"), F.lit(" imports "), F.col("imported_module"), F.when(resolved, F.lit("")).otherwise(F.lit(" (external, not part of this repo)")))
    out = _evidence(a, "import_graph", [F.lit(0), F.col("edge_ord")], none.cast("string"), F.coalesce("resolved_file", "importer_file"), none, none, text, text, F.when(resolved, F.lit(RESOLVED)).otherwise(F.lit(UNRESOLVED)))
    b = _wanted(f, "importers", "imports").join(e.withColumn("path", F.col("resolved_file")), ["repo", "path"])
    text = F.concat(F.col("importer_file"), F.lit(" imports this file"))
    return out.unionByName(_evidence(b, "import_graph", [F.lit(1), F.col("edge_ord")], none.cast("string"), F.col("importer_file"), none, none, text, text, F.lit(RESOLVED)))


def hierarchy_evidence(t: Tables, steps: DataFrame) -> DataFrame:
    """Base classes and subclasses."""
    c = candidates(t.symbols, steps).select("qid", "repo", "step", "direction", "sym_ord", "confidence", F.col("qualified_name").alias("node"))
    e = t.inherits.select("repo", "edge_ord", "class_qualified_name", "base_name", "base_qualified_name")
    x = _facing(c.join(_ends(e, ("class_qualified_name", "base_qualified_name")), ["repo", "node"]), "bases", "subclasses")
    is_base, known = F.col("side") == 0, F.col("base_qualified_name").isNotNull()
    x = x.withColumn("shown", F.when(is_base, F.col("base_qualified_name")).otherwise(F.col("class_qualified_name")))
    place = t.symbols.groupBy("repo", F.col("qualified_name").alias("shown")).agg(F.max_by(F.struct("file_path", "start_line", "end_line"), "sym_ord").alias("p"))
    x = _with_source(x.join(place, ["repo", "shown"], "left"), t.sources, "shown")
    base_of = F.concat(F.lit("Base class of "), F.col("class_qualified_name"), F.when(known, F.lit("")).otherwise(F.lit(" (external, not part of this repo)")))
    text = F.when(is_base, base_of).otherwise(F.concat(F.lit("Subclass of "), F.coalesce("base_qualified_name", "base_name")))
    fallback = F.concat(F.col("class_qualified_name"), F.lit(" inherits from "), F.col("base_name"))
    trust = F.when(~is_base | known, F.col("confidence")).otherwise(F.least(F.col("confidence"), F.lit(UNRESOLVED)))
    return _evidence(
        x, "hierarchy", [F.col("sym_ord"), F.col("side"), F.col("edge_ord")], F.col("shown"), F.col("p.file_path"), F.col("p.start_line"), F.col("p.end_line"), T.source_or(F.col("_source"), fallback), text, trust
    )


#: The texts of explanations here and above are fixed values.
def semantic_evidence(t: Tables, steps: DataFrame, k: int = 8) -> DataFrame:
    """The chunks nearest to each step's query (or target), within its repository."""
    q = steps.withColumn("text", F.coalesce(F.when(F.col("query") != "", F.col("query")), F.col("target"))).where(F.col("text").isNotNull())
    key = F.xxhash64("qid", "step")
    q = q.withColumn("query_id", key)
    hits = vectors.nearest(
        t.chunks.select(F.col("chunk_ord").alias("id"), "repo", t.embed(F.col("content")).alias("embedding")), q.select("query_id", "repo", t.embed(F.col("text")).alias("embedding")), k, within="repo"
    )
    c = t.chunks.select(F.col("chunk_ord").alias("id"), "qualified_name", "file_path", "start_line", "end_line", "content")
    x = hits.join(q.select("query_id", "qid", "repo", "step", "text"), "query_id").join(c, "id")
    text = F.concat(F.lit("Semantically similar to '"), F.col("text"), F.lit("' (distance "), F.format_string("%.3f", F.col("distance")), F.lit(")"))
    return _evidence(x, "semantic", [F.col("rank")], F.col("qualified_name"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content"), text, T.semantic_confidence(F.col("distance")))


def lexical(chunks: DataFrame, needle: str, limit: int = 8) -> DataFrame:
    """Chunks whose text holds `needle`, by id."""
    return chunks.where(F.contains(F.col("content"), F.lit(needle))).orderBy("id").limit(limit).withColumn("distance", F.lit(None).cast("double"))


def exact(chunks: DataFrame, name: str, limit: int = 8) -> DataFrame:
    return chunks.where(F.col("qualified_name") == name).orderBy("id").limit(limit).withColumn("distance", F.lit(None).cast("double"))


RETRIEVERS = {"symbol_lookup": symbol_evidence, "semantic_search": semantic_evidence, "call_graph": call_evidence, "import_graph": import_evidence, "hierarchy": hierarchy_evidence}


# ---- bundles -------------------------------------------------------------------


def by_source(evidence: DataFrame, source: str) -> DataFrame:
    """The items that one strategy found."""
    return evidence.where(F.col("source") == source)


def capped(evidence: DataFrame, plans: DataFrame) -> DataFrame:
    """Numbers each question's items; where there are more than max_results, the most confident stay, in that order."""
    e = evidence.join(plans.select("qid", "max_results"), "qid")
    by_step = Window.partitionBy("qid").orderBy("ord", "source", "qualified_name", "file_path", "explanation")
    by_trust = Window.partitionBy("qid").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "ord", "source", "qualified_name", "file_path", "explanation")
    n = F.count("*").over(Window.partitionBy("qid"))
    cut_here = (F.col("max_results") > 0) & (F.col("_n") > F.col("max_results"))
    e = e.withColumns({"_n": n, "_a": F.row_number().over(by_step), "_b": F.row_number().over(by_trust)})
    e = e.withColumn("item", F.when(cut_here, F.col("_b")).otherwise(F.col("_a")))
    return e.where(~F.coalesce(cut_here, F.lit(False)) | (F.col("item") <= F.col("max_results"))).select(*EVIDENCE, "item")


def retrievers_used(steps: DataFrame, fallen_back: DataFrame | None = None) -> DataFrame:
    """(qid, retrievers): distinct strategies in the order of their first step; last the search of the questions (qid) that fell back on it."""
    first = steps.groupBy("qid", "strategy").agg(F.min("step").alias("at"))
    if fallen_back is not None:
        first = first.unionByName(fallen_back.select("qid", F.lit("semantic_search").alias("strategy"), F.lit(2**31 - 1).alias("at")).distinct())
    return first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "strategy"))), lambda x: x["strategy"]).alias("retrievers"))


@dataclass
class Execution:
    """What a set of plans gave: evidence, warnings (strategy, message) and the questions (qid) that fell back on a search."""

    evidence: DataFrame
    warnings: list[tuple[str, str]]
    fallen_back: DataFrame


def run(t: Tables, plans: DataFrame, retrievers: dict | None = None) -> Execution:
    """Runs every strategy over all its steps at once; one that fails or is not registered becomes a warning and the others go on.

    A question whose steps found nothing and asked for no semantic search gets one over its text,
    under the same guard.  Results are written to the shared folder once, which shows failures.
    """
    known = retrievers or RETRIEVERS
    steps = cut(steps_of(plans))
    out: list[DataFrame] = []
    warned: list[tuple[str, str]] = []

    def guarded(name: str, some: DataFrame, absent: str) -> None:
        if name not in known:
            warned.append((name, absent))
            return
        try:
            out.append(cut(known[name](t, some).select(*EVIDENCE)))
        except Exception as e:  # noqa: BLE001
            warned.append((name, str(e).splitlines()[0] if str(e) else type(e).__name__))

    for name in sorted(r[0] for r in steps.select("strategy").distinct().collect()):  # at most one row per strategy
        guarded(name, steps.where(F.col("strategy") == name), f"No retriever registered for {name}")
    empty = plans.join(steps.where("strategy = 'semantic_search'").select("qid").distinct(), "qid", "left_anti")
    for frame in out:
        empty = empty.join(frame.select("qid").distinct(), "qid", "left_anti")
    null = F.lit(None).cast("string")
    again = cut(empty.select("qid", "repo", "question", F.lit(0).alias("step"), F.lit("semantic_search").alias("strategy"), null.alias("target"), F.col("question").alias("query"), null.alias("direction")))
    if not again.isEmpty():
        guarded("semantic_search", again, "No retriever registered for semantic_search fallback")
    kind = "repo string, ord array<long>, source string, qualified_name string, file_path string, start_line int, end_line int, content string, explanation string, confidence double"
    frames = reduce(DataFrame.unionByName, out) if out else plans.sparkSession.createDataFrame([], f"qid long, {kind}")
    return Execution(capped(frames, plans), warned, again.select("qid"))


def execute(t: Tables, plans: DataFrame, retrievers: dict | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Evidence of all plans, and warnings of strategies that failed or are not registered."""
    done = run(t, plans, retrievers)
    return done.evidence, done.warnings
