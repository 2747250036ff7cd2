"""The repository graph and cycles among imports."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.operators import hierarchy
from gnomon.session import cut


def nodes(symbols: DataFrame, imports: DataFrame, calls: DataFrame, inherits: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (repo, id, node_type): symbols, files, and a stub for each unresolved target."""
    s = symbols.select("repo", F.col("qualified_name").alias("id"), F.lit("symbol").alias("node_type"))
    f = files.select("repo", F.col("path").alias("id"), F.lit("file").alias("node_type"))
    out = [s, f]
    for edges, raw, target in ((imports, "imported_module", "resolved_file"), (calls, "callee_name", "callee_qualified_name"), (inherits, "base_name", "base_qualified_name")):
        out.append(edges.where(F.col(target).isNull()).select("repo", F.concat(F.lit("external:"), F.col(raw)).alias("id"), F.lit("external").alias("node_type")))
    return reduce(DataFrame.unionByName, out).where(F.col("id").isNotNull()).distinct()


def edges(imports: DataFrame, calls: DataFrame, inherits: DataFrame) -> DataFrame:
    """(repo, src, dst, edge_type), several edges between two nodes kept."""

    def part(df: DataFrame, src: str, raw: str, target: str, kind: str) -> DataFrame:
        return df.select("repo", F.col(src).alias("src"), F.coalesce(F.col(target), F.concat(F.lit("external:"), F.col(raw))).alias("dst"), F.lit(kind).alias("edge_type"))

    return (
        part(imports, "importer_file", "imported_module", "resolved_file", "imports")
        .unionByName(part(calls, "caller_qualified_name", "callee_name", "callee_qualified_name", "calls"))
        .unionByName(part(inherits, "class_qualified_name", "base_name", "base_qualified_name", "inherits"))
    )


def _ring_edges(imports: DataFrame, local_links: int) -> DataFrame:
    """Distinct edges (g, c, p, ring) between two files of one strongly connected set."""
    e = imports.where(F.col("resolved_file").isNotNull() & (F.col("importer_file") != F.col("resolved_file")))
    links = cut(hierarchy.links_of(e, "repo", "importer_file", "resolved_file"))
    sets = hierarchy.forest(links.select(F.col("cid").alias("a"), F.col("pid").alias("b"), F.lit(1).cast("long").alias("w")))
    state = cut(hierarchy.loops(links, sets, local_links).where(F.col("state") == hierarchy.CYCLE).select("v", "ring"))
    return cut(links.join(state.withColumnRenamed("v", "cid"), "cid").join(state.withColumnRenamed("v", "pid"), ["pid", "ring"]).select("g", "c", "p", "ring"))


def import_rings(imports: DataFrame, local_links: int = 200_000) -> DataFrame:
    """(repo, ring, file, files): each file on an import cycle of any length, with its strongly connected set.

    Two files are on a common closed way exactly if their sets are the same; `ring` is the set's
    least file and `files` its size.  There is a row per file, however many cycles there are.
    """
    own = _ring_edges(imports, local_links).select("ring", F.col("g").alias("repo"), F.col("c").alias("file")).distinct()
    sets = own.groupBy(F.col("ring").alias("id")).agg(F.min("file").alias("ring"), F.count("*").alias("files"))
    return own.withColumnRenamed("ring", "id").join(sets, "id").select("repo", "ring", "file", "files")


def import_cycles(imports: DataFrame, longest: int | None = 8) -> DataFrame:
    """(repo, cycle): the elementary cycles of up to `longest` files (None: of any length), each starting at its least file."""
    return bounded_cycles(imports, longest)[0]


def bounded_cycles(imports: DataFrame, longest: int | None = 8) -> tuple[DataFrame, DataFrame]:
    """`import_cycles`, and the repositories (repo) in which ways of more than `longest` files were left unfollowed.

    Edges outside of any cycle go first: those that do not join two files of one strongly
    connected set.  Paths then grow by a join a round, over files greater than the start; without
    a bound the rounds end with the longest path, and the rows grow with the number of cycles.
    """
    e = _ring_edges(imports, 200_000).select("g", "c", "p")
    step = e.select(F.col("g").alias("g2"), F.col("c").alias("c2"), F.col("p").alias("p2"))
    paths = e.where("c < p").select("g", F.col("c").alias("start"), F.col("p").alias("last"), F.array("c", "p").alias("cycle"))
    found = [paths.limit(0).select(F.col("g").alias("repo"), "cycle")]
    for _ in count(2) if longest is None else range(2, longest + 1):
        back = (F.col("g") == F.col("g2")) & (F.col("last") == F.col("c2"))
        found.append(paths.join(step, back & (F.col("p2") == F.col("start")), "left_semi").select(F.col("g").alias("repo"), "cycle"))
        nxt = paths.join(step, back & (F.col("p2") > F.col("start"))).where(~F.array_contains("cycle", F.col("p2")))
        paths = cut(nxt.select("g", "start", F.col("p2").alias("last"), F.concat("cycle", F.array("p2")).alias("cycle")))
        if paths.isEmpty():
            break
    return reduce(DataFrame.unionByName, found), paths.select(F.col("g").alias("repo")).distinct()
