"""Name resolution: raw callee, base and module names to symbols and files, by left joins.

Nothing is dropped: a name that stays ambiguous or unknown keeps its edge with a null target.
Ambiguity counts symbol rows, so an overloaded name has several candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnomon.functions import text as T
from gnomon.session import spread


def resolve_names(pending: DataFrame, symbols: DataFrame, raw: str, out: str, enclosing: Column | None = None, file_path: Column | None = None) -> DataFrame:
    """`pending` (with repo and `raw`) plus `out`: the qualified name that each raw name means.

    In order: self.x and cls.x in the enclosing class; the exact qualified name; the only symbol
    of that short name in the same file; the only one in the repository.
    """
    # one grouping that all three lookups start from, so that its shuffle is done once
    u = symbols.where(F.col("qualified_name").isNotNull()).groupBy("repo", "qualified_name", "file_path").agg(F.count("*").alias("n"))
    s = u.withColumn("short", T.short_name(F.col("qualified_name")))
    names = u.groupBy(F.col("repo").alias("r1"), F.col("qualified_name").alias("q1")).agg(F.sum("n").alias("n")).drop("n")
    by_file = s.groupBy("repo", "file_path", "short").agg(F.sum("n").alias("n"), F.first("qualified_name").alias("q")).where("n = 1")
    by_repo = s.groupBy("repo", "short").agg(F.sum("n").alias("n"), F.first("qualified_name").alias("q")).where("n = 1")
    name = F.col(raw)
    own = F.when(name.rlike(r"^(self|cls)\.[^.]+$") & enclosing.isNotNull(), F.concat(enclosing, F.lit("."), F.substring_index(name, ".", -1))) if enclosing is not None else F.lit(None).cast("string")
    # a name that is absent meets nothing: each row gets one of its own, so that they do not all meet in one task
    alone = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    absent = lambda x: F.coalesce(x, alone)
    work = pending.withColumns({"_own": absent(own), "_short": absent(T.short_name(name)), "_file": absent(file_path) if file_path is not None else F.lit(None).cast("string")})
    work = work.join(names.select(F.col("r1").alias("ra"), F.col("q1").alias("qa")), (F.col("repo") == F.col("ra")) & (F.col("_own") == F.col("qa")), "left").drop("ra")
    work = work.join(names.select(F.col("r1").alias("rb"), F.col("q1").alias("qb")), (F.col("repo") == F.col("rb")) & (name == F.col("qb")), "left").drop("rb")
    f = by_file.select(F.col("repo").alias("rc"), F.col("file_path").alias("fc"), F.col("short").alias("sc"), F.col("q").alias("qc"))
    work = work.join(f, (F.col("repo") == F.col("rc")) & (F.col("_file") == F.col("fc")) & (F.col("_short") == F.col("sc")), "left").drop("rc", "fc", "sc")
    r = by_repo.select(F.col("repo").alias("rd"), F.col("short").alias("sd"), F.col("q").alias("qd"))
    work = work.join(r, (F.col("repo") == F.col("rd")) & (F.col("_short") == F.col("sd")), "left").drop("rd", "sd")
    return work.withColumn(out, F.coalesce("qa", "qb", "qc", "qd")).drop("_own", "_short", "_file", "qa", "qb", "qc", "qd")


def module_map(files: DataFrame, order: str) -> DataFrame:
    """(repo, module, path): the last file of each module name."""
    m = files.where(F.col("path").endswith(".py")).select("repo", T.module_name(F.col("path")).alias("module"), "path", F.col(order).alias("_o"))
    return m.groupBy("repo", "module").agg(F.max_by("path", F.struct("_o", "path")).alias("path"))


def resolve_imports(pending: DataFrame, modules: DataFrame, out: str = "resolved_file") -> DataFrame:
    """`pending` has repo, importer_file, module, name, level, star; adds imported_module and the file it means.

    `from m import n` means the module m.n if there is one, else m.
    """
    base = T.absolute_module(T.package_of(F.col("importer_file")), F.col("module"), F.col("level"))
    work = pending.withColumn("_base", base)
    work = work.withColumn("_sub", F.when(F.col("name").isNotNull(), F.concat_ws(".", F.when(F.col("_base") != "", F.col("_base")), F.col("name"))))
    m1 = modules.select(F.col("repo").alias("r1"), F.col("module").alias("m1"), F.col("path").alias("p1"))
    m2 = modules.select(F.col("repo").alias("r2"), F.col("module").alias("m2"), F.col("path").alias("p2"))
    work = work.join(m1, (F.col("repo") == F.col("r1")) & (F.col("_sub") == F.col("m1")), "left").join(m2, (F.col("repo") == F.col("r2")) & (F.col("_base") == F.col("m2")), "left")
    work = work.withColumn("imported_module", F.when(F.col("p1").isNotNull(), F.col("_sub")).otherwise(F.col("_base")))
    return work.withColumn(out, F.coalesce("p1", "p2")).drop("_base", "_sub", "r1", "m1", "p1", "r2", "m2", "p2")


def symbol_sources(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, qualified_name, source): the lines of each symbol; the last of several definitions wins."""
    f = spread(files.where(F.col("content").isNotNull()).select("repo", F.col("path").alias("file_path"), "content"))
    f = f.select("repo", "file_path", T.lines(F.col("content")).alias("_l"))
    j = symbols.join(f, ["repo", "file_path"])
    body = F.array_join(F.slice("_l", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return j.groupBy("repo", "qualified_name").agg(F.max_by(body, "sym_ord").alias("source"))
