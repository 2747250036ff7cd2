"""Queries over class hierarchies (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.operators import hierarchy
from gnomon.tables import table

_BASE = """
WITH RECURSIVE
l AS (SELECT DISTINCT repo, class_qualified_name AS c, base_qualified_name AS b FROM inherits_edges
      WHERE class_qualified_name IS NOT NULL AND base_qualified_name IS NOT NULL),
n AS (SELECT repo, class_qualified_name AS x FROM inherits_edges WHERE class_qualified_name IS NOT NULL
      UNION SELECT repo, base_qualified_name FROM inherits_edges WHERE base_qualified_name IS NOT NULL),
up AS (SELECT repo, c, b AS a FROM l
       UNION SELECT up.repo, up.c, l.b FROM up JOIN l ON up.repo IS NOT DISTINCT FROM l.repo AND up.a = l.c),
cyc AS (SELECT DISTINCT repo, c FROM up WHERE c = a),
low AS (SELECT DISTINCT up.repo, up.c FROM up JOIN cyc ON up.repo IS NOT DISTINCT FROM cyc.repo AND up.a = cyc.c),
root AS (SELECT repo, x FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.repo IS NOT DISTINCT FROM n.repo AND l.c = n.x)),
p AS (SELECT repo, x AS name, x AS root, 0 AS depth, [x] AS names FROM root
      UNION ALL SELECT p.repo, l.c, p.root, p.depth + 1, list_append(p.names, l.c) FROM p
      JOIN l ON p.repo IS NOT DISTINCT FROM l.repo AND l.b = p.name
      WHERE NOT EXISTS (SELECT 1 FROM low WHERE low.repo IS NOT DISTINCT FROM l.repo AND low.c = l.c))
"""


def _build(spark: SparkSession, sf_dir: str) -> hierarchy.Hierarchy:
    return hierarchy.build(table(spark, sf_dir, "inherits_edges"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build(spark, sf_dir).table().select(
        F.col("g").alias("repo"), F.col("name").alias("class_qualified_name"), F.col("root").alias("root_qualified_name"), "depth", "path"
    )


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build(spark, sf_dir).descendants().select(F.col("g").alias("repo"), "ancestor", "descendant", F.col("depth").cast("int").alias("depth"))


def p1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per weighted set its first name, members, and whether offsets clash (a loop or a diamond of uneven arms)."""
    return _build(spark, sf_dir).components().select(F.col("g").alias("repo"), "first_name", F.col("members").cast("long").alias("members"))


QUERIES = {"p1_found": p1_found, "p1_descendants": p1_descendants, "p1_components": p1_components}

ORACLE = {
    "p1_found": _BASE + """
SELECT repo, name AS class_qualified_name, root AS root_qualified_name, CAST(depth AS INTEGER) AS depth, array_to_string(names, ' > ') AS path FROM p
UNION ALL SELECT repo, c, '(cycle)', -1, '(cycle)' FROM cyc
UNION ALL SELECT repo, c, '(below cycle)', -1, '(below cycle)' FROM low
WHERE NOT EXISTS (SELECT 1 FROM cyc WHERE cyc.repo IS NOT DISTINCT FROM low.repo AND cyc.c = low.c)""",
    "p1_descendants": """
WITH RECURSIVE
l AS (SELECT DISTINCT repo, class_qualified_name AS c, base_qualified_name AS b FROM inherits_edges
      WHERE class_qualified_name IS NOT NULL AND base_qualified_name IS NOT NULL AND class_qualified_name <> base_qualified_name),
r(repo, ancestor, descendant, depth) USING KEY (repo, ancestor, descendant) AS (
  SELECT repo, b, c, 1 FROM l
  UNION
  SELECT r.repo, r.ancestor, l.c, min(r.depth + 1) FROM r JOIN l ON r.repo IS NOT DISTINCT FROM l.repo AND l.b = r.descendant
  LEFT JOIN recurring.r AS o ON o.repo IS NOT DISTINCT FROM r.repo AND o.ancestor = r.ancestor AND o.descendant = l.c
  WHERE o.ancestor IS NULL AND l.c <> r.ancestor GROUP BY ALL)
SELECT repo, ancestor, descendant, CAST(depth AS INTEGER) AS depth FROM r
WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.repo IS NOT DISTINCT FROM r.repo AND x.ancestor = r.descendant AND x.descendant = r.ancestor)""",
    "p1_components": """
WITH RECURSIVE
l AS (SELECT DISTINCT repo, class_qualified_name AS c, base_qualified_name AS b FROM inherits_edges
      WHERE class_qualified_name IS NOT NULL AND base_qualified_name IS NOT NULL),
s AS (SELECT repo, c AS x, b AS y FROM l UNION SELECT repo, b, c FROM l),
r AS (SELECT repo, x, x AS y FROM s UNION SELECT repo, x, y FROM s
      UNION SELECT r.repo, r.x, s.y FROM r JOIN s ON r.repo IS NOT DISTINCT FROM s.repo AND r.y = s.x),
f AS (SELECT repo, x, min(y) AS first_name FROM r GROUP BY repo, x)
SELECT repo, first_name, count(*) AS members FROM f GROUP BY repo, first_name""",
}
