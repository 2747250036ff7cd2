"""Deterministic analyzers over a repository's tables; all give the same finding columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gnomon.functions import text as T
from gnomon.functions.complexity import complexity_column
from gnomon.operators.graph import bounded_cycles, import_rings
from gnomon.session import cut

SEVERITIES = ("info", "warning")
FINDING = ["repo", "id", "category", "severity", "title", "description", "qualified_name", "file_path", "start_line", "end_line", "details"]


def finding(df: DataFrame, category: str, severity: str, key: list[Column], title: Column, description: Column, details: Column, name: Column | None = None, path: Column | None = None, first: Column | None = None, last: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select(
        "repo", T.finding_id(F.lit(category), *key).alias("id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), title.alias("title"), description.alias("description"),
        (name if name is not None else null.cast("string")).alias("qualified_name"), (path if path is not None else null.cast("string")).alias("file_path"),
        (first if first is not None else null.cast("int")).alias("start_line"), (last if last is not None else null.cast("int")).alias("end_line"), details.alias("details"),
    )


#: Titles and descriptions of the findings below.
def dead_code(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols that no resolved call names, without entry points, dunder names and tests."""
    called = calls.where(F.col("callee_qualified_name").isNotNull()).select("repo", F.col("callee_qualified_name").alias("qualified_name")).distinct()
    dead = symbols.where(~T.is_test_or_entry(F.col("qualified_name"), F.col("file_path"))).join(called, ["repo", "qualified_name"], "left_anti")
    q = F.col("qualified_name")
    note = F.concat(
        F.col("kind"), F.lit(" '"), q,
        F.lit("' has no resolved callers in the static call graph. This may be dead code, or it may be invoked dynamically or externally (a CLI entry point, a framework callback, a test discovered by name, an exported public API) - verify before removing."),
    )
    return finding(dead, "dead_code", "warning", [q, F.col("start_line")], F.concat(F.lit("No callers found for '"), q, F.lit("'")), note, F.to_json(F.struct("kind")), q, F.col("file_path"), F.col("start_line"), F.col("end_line"))


def circular_dependencies(imports: DataFrame, longest: int | None = 8) -> DataFrame:
    """One finding per elementary import cycle of up to `longest` files (of any length for None), and one per larger set of files that all reach each other."""
    c, _ = bounded_cycles(imports, longest)
    n = F.size("cycle")
    path = F.concat(F.array_join("cycle", " -> "), F.lit(" -> "), F.element_at("cycle", 1))
    shown = F.concat(F.array_join(F.slice("cycle", 1, 3), " -> "), F.when(n > 3, F.lit("...")).otherwise(F.lit("")))
    short = finding(c, "circular_dependency", "warning", [path], F.concat(F.lit("Circular import: "), shown), F.concat(F.lit("These files import each other in a cycle: "), path), F.to_json(F.struct(n.alias("cycle_length"), path.alias("cycle"))), path=F.element_at("cycle", 1))
    if longest is None:
        return short
    r = import_rings(imports).where(F.col("files") > longest).groupBy("repo", "ring", "files").agg(F.array_sort(F.collect_list("file")).alias("members"))
    size = F.col("files").cast("string")
    title = F.concat(F.lit("Circular imports among "), size, F.lit(" files: "), F.array_join(F.slice("members", 1, 3), ", "), F.lit("..."))
    note = F.concat(F.lit("Each of these files imports every other, directly or through files of the set; "), F.lit(f"cycles of more than {longest} files are not listed one by one: "), F.array_join("members", ", "))
    large = finding(r, "circular_dependency", "warning", [F.lit("set"), F.array_join("members", " -> ")], title, note, F.to_json(F.struct("files", F.lit(longest).alias("listed_up_to"), "members")), path=F.col("ring"))
    return short.unionByName(large)


def complexity(symbols: DataFrame, sources: DataFrame, threshold: int = 10) -> DataFrame:
    """Functions and methods whose cyclomatic complexity is above the threshold."""
    s = symbols.where(F.col("kind").isin("function", "method")).join(sources.where("source <> ''"), ["repo", "qualified_name"])
    s = s.withColumn("complexity", complexity_column(F.col("source"))).where(F.col("complexity") > threshold)
    q, n = F.col("qualified_name"), F.col("complexity").cast("string")
    note = F.concat(F.col("kind"), F.lit(" '"), q, F.lit("' has a cyclomatic complexity of "), n, F.lit(f", above the threshold of {threshold}. Consider splitting it into smaller functions."))
    details = F.to_json(F.struct(F.col("complexity").alias("cyclomatic_complexity"), F.lit(threshold).alias("threshold")))
    return finding(s, "complexity", "warning", [q, F.col("start_line")], F.concat(F.lit("High cyclomatic complexity ("), n, F.lit(") in '"), q, F.lit("'")), note, details, q, F.col("file_path"), F.col("start_line"), F.col("end_line"))


def todo_lines(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, tag, note): the first marker of each line."""
    pattern = r"(?iU)#\s*(TODO|FIXME|HACK|XXX)\b[:\s]*(.*)"
    src = files.where(F.col("content").rlike(r"(?i)#\s*(todo|fixme|hack|xxx)"))
    rows = src.select("repo", "path", F.posexplode(T.lines(F.col("content"))).alias("pos", "line"))
    rows = rows.select("repo", "path", (F.col("pos") + 1).alias("line_no"), F.upper(F.regexp_extract("line", pattern, 1)).alias("tag"), F.regexp_replace(F.regexp_extract("line", pattern, 2), r"(?U)^\s+|\s+$", "").alias("note"))
    return rows.where("tag <> ''").distinct()


def todos(files: DataFrame) -> DataFrame:
    """One finding per marker line."""
    t = todo_lines(files)
    at = F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"))
    note = F.when(F.col("note") != "", F.col("note")).otherwise(F.concat(F.col("tag"), F.lit(" comment with no additional detail.")))
    return finding(t, "todo", "info", [F.col("path"), F.col("line_no")], F.concat(F.col("tag"), F.lit(" in "), at), note, F.to_json(F.struct("tag")), path=F.col("path"), first=F.col("line_no"), last=F.col("line_no"))


def packages(files: DataFrame) -> DataFrame:
    """(repo, package, files): files per directory."""
    return files.select("repo", "path").distinct().groupBy("repo", T.package_dir(F.col("path")).alias("package")).agg(F.count("*").alias("files"))


def hubs(imports: DataFrame, limit: int = 10, least: int = 2) -> DataFrame:
    """(repo, resolved_file, importers): the files with most import edges, the first `limit` of a repository, then those with `least`."""
    n = imports.where(F.col("resolved_file").isNotNull()).groupBy("repo", "resolved_file").agg(F.count("*").alias("importers"), F.min("edge_ord").alias("first_edge"))
    w = Window.partitionBy("repo").orderBy(F.desc("importers"), "first_edge")
    return n.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= limit) & (F.col("importers") >= least)).select("repo", "resolved_file", "importers")


def entry_points(symbols: DataFrame) -> DataFrame:
    return symbols.where((F.col("kind") == "function") & (T.short_name(F.col("qualified_name")) == "main"))


def architecture(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Packages, hub files and entry points."""
    p, h, e = packages(files), hubs(imports), entry_points(symbols)
    pk, n = F.col("package"), F.col("files").cast("string")
    a = finding(p, "architecture", "info", [F.lit("package"), pk], F.concat(F.lit("Package '"), pk, F.lit("': "), n, F.lit(" file(s)")), F.concat(F.lit("'"), pk, F.lit("' contains "), n, F.lit(" source file(s).")), F.to_json(F.struct("package", F.col("files").alias("file_count"))))
    f, m = F.col("resolved_file"), F.col("importers").cast("string")
    b = finding(h, "architecture", "info", [F.lit("hub"), f], F.concat(F.lit("'"), f, F.lit("' is imported by "), m, F.lit(" file(s)")), F.concat(F.lit("'"), f, F.lit("' has high fan-in ("), m, F.lit(" importers), suggesting it's a structurally central module.")), F.to_json(F.struct(F.col("importers").alias("importer_count"))), path=f)
    q = F.col("qualified_name")
    c = finding(e, "architecture", "info", [F.lit("entry_point"), q], F.concat(F.lit("Entry point: '"), q, F.lit("'")), F.concat(F.lit("'"), q, F.lit("' looks like a script entry point.")), F.lit("{}"), q, F.col("file_path"), F.col("start_line"), F.col("end_line"))
    return a.unionByName(b).unionByName(c)


def statistics(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, inherits: DataFrame) -> DataFrame:
    """Ten counters per repository."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    parts = [
        files.groupBy("repo").agg(F.countDistinct("path").alias("files")),
        symbols.groupBy("repo").agg(F.count("*").alias("symbols"), kind("function").alias("functions"), kind("method").alias("methods"), kind("class").alias("classes")),
        imports.groupBy("repo").agg(F.count("*").alias("import_edges"), F.count("resolved_file").alias("resolved_imports")),
        calls.groupBy("repo").agg(F.count("*").alias("call_edges"), F.count("callee_qualified_name").alias("resolved_calls")),
        inherits.groupBy("repo").agg(F.count("*").alias("inherits_edges")),
    ]
    out = reduce(lambda a, b: a.join(b, "repo", "full"), parts)
    return out.na.fill(0)


def only(findings: DataFrame, category: str | None = None, severity: str | None = None) -> DataFrame:
    """The findings of a category, of a severity, or of both."""
    for column, value in (("category", category), ("severity", severity)):
        findings = findings if value is None else findings.where(F.col(column) == value)
    return findings


def summary(findings: DataFrame) -> DataFrame:
    """Findings per repository, category and severity; no rows of zero."""
    return findings.groupBy("repo", "category", "severity").agg(F.count("*").alias("findings"))


def report(analyzers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[str], list[tuple[str, str]]]:
    """Runs analyzers in order; one that fails becomes a warning. Gives findings, the analyzers that ran, warnings."""
    frames, ran, warned = [], [], []
    for name, make in analyzers.items():
        try:
            frame = cut(make().select(*FINDING))  # failures show here, inside the guard
        except Exception as e:  # noqa: BLE001
            warned.append((name, str(e).splitlines()[0] if str(e) else type(e).__name__))
            continue
        frames.append(frame)
        ran.append(name)
    return (reduce(DataFrame.unionByName, frames) if frames else None), ran, warned
