"""Registered queries over the repository tables, with the SQL each is checked against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions import text as T
from gnomon.functions import vectors
from gnomon.functions.complexity import complexity_column
from gnomon.functions.register import ParsePython
from gnomon.operators import answers, graph, insights, packing, parse, planning, resolve, retrieval
from gnomon.session import cut, shared_folder
from gnomon.streaming import ingest
from gnomon.tables import once, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _files(s: SparkSession, d: str) -> DataFrame:
    return once(s, d, "source_files", "repo", "path")


def _python(s: SparkSession, d: str) -> DataFrame:
    """The Python files with their contents, repeated rows included: what is made of them drops the repetitions, so that no content is moved for it."""
    return table(s, d, "source_files").where(F.col("path").endswith(".py"))


def _tables(s: SparkSession, d: str) -> retrieval.Tables:
    symbols, chunks = once(s, d, "symbols"), once(s, d, "chunks")
    sources = resolve.symbol_sources(symbols, table(s, d, "source_files"))
    return retrieval.Tables(_files(s, d), symbols, sources, once(s, d, "import_edges"), once(s, d, "call_edges"), once(s, d, "inherits_edges"), chunks)


def _steps(df: DataFrame, key: str, target: str, strategy: str, direction: str | None = None) -> DataFrame:
    """Searches take as questions every row whose id is divisible by 20."""
    return df.where(F.col(key) % 20 == 0).select(F.col(key).alias("qid"), "repo", F.lit(0).alias("step"), F.lit(strategy).alias("strategy"), F.col(target).alias("target"), F.lit(None).cast("string").alias("query"), F.lit(direction).cast("string").alias("direction"))


_F = "f AS (SELECT DISTINCT file_id, repo, path, content FROM source_files)"
_S = "s AS (SELECT DISTINCT * FROM symbols)"
_C = "c AS (SELECT DISTINCT * FROM call_edges)"
_I = "i AS (SELECT DISTINCT * FROM import_edges)"
_H = "h AS (SELECT DISTINCT * FROM inherits_edges)"
_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"string_split_regex(content, '{_ENDS}')"
_N = f"(len({_LINES}) - CAST({_LINES}[-1] = '' AS INTEGER))"
_SHORT = "split_part({0}, '.', -1)"
_SHORT_Q = "split_part(qualified_name, '.', -1)"
_MODULE = r"replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '\.py$', ''), '^src$', ''), '^src/', ''), '(^|/)__init__$', ''), '/', '.')"
_DEAD = f"""qualified_name IS NOT NULL AND NOT ({_SHORT_Q} IN ('main', '__init__', '__main__') OR regexp_matches({_SHORT_Q}, '^__.+__$') OR starts_with({_SHORT_Q}, 'test_')
 OR len([x FOR x IN string_split(file_path, '/') IF x IN ('test', 'tests') OR starts_with(x, 'test_')]) > 0)"""


@query(rf"""WITH {_F} SELECT file_id, repo, path, CAST({_N} AS INTEGER) AS line_count FROM f
WHERE ends_with(path, '.py') AND strlen(content) BETWEEN 1 AND 500000 AND NOT contains(content, chr(0))
AND NOT list_has_any(string_split(path, '/'), ['.git', '__pycache__', '.venv', 'venv', 'node_modules', 'dist', 'build', '.mypy_cache', '.pytest_cache', '.ruff_cache'])""")
def q01_scan_filter(s: SparkSession, d: str) -> DataFrame:
    f = _python(s, d).where(F.octet_length("content").between(1, 500_000) & ~T.ignored(F.col("path")) & ~F.contains("content", F.lit("\x00")))
    return f.select("file_id", "repo", "path", T.line_count(F.col("content")).alias("line_count")).distinct()


@query(rf"""WITH {_F}, l AS (SELECT repo, path, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM f WHERE ends_with(path, '.py')),
t AS (SELECT DISTINCT repo, path, n, upper(regexp_extract(line, '#\s*(TODO|FIXME|HACK|XXX)\b[:\s]*(.*)', 1, 'i')) AS tag,
 regexp_replace(regexp_extract(line, '#\s*(TODO|FIXME|HACK|XXX)\b[:\s]*(.*)', 2, 'i'), '^\s+|\s+$', '', 'g') AS note FROM l)
SELECT repo, substr(sha1('todo|' || path || '|' || n), 1, 12) AS id, tag || ' in ' || path || ':' || n AS title,
 CASE WHEN note <> '' THEN note ELSE tag || ' comment with no additional detail.' END AS description, path AS file_path, CAST(n AS INTEGER) AS start_line
FROM t WHERE tag <> ''""")
def q02_todo_scan(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "source_files").where(F.col("path").endswith(".py"))
    return insights.todos(f).select("repo", "id", "title", "description", "file_path", "start_line")


@query(f"WITH {_F} SELECT repo, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '(root)' END AS package, count(DISTINCT path) AS files FROM f GROUP BY ALL")
def q04_package_structure(s: SparkSession, d: str) -> DataFrame:
    return insights.packages(table(s, d, "source_files"))


@query(f"""WITH {_I}, n AS (SELECT repo, resolved_file, count(*) AS importers, min(edge_ord) AS e FROM i WHERE resolved_file IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY importers DESC, e) AS k FROM n) SELECT repo, resolved_file, importers FROM r WHERE k <= 10 AND importers >= 2""")
def q05_hub_files(s: SparkSession, d: str) -> DataFrame:
    return insights.hubs(once(s, d, "import_edges", "repo", "resolved_file"))


@query(f"""WITH {_S} SELECT sym_ord, repo, qualified_name, kind = 'function' AND {_SHORT_Q} = 'main' AS entry_point, {_SHORT_Q} IN ('main', '__init__', '__main__') OR regexp_matches({_SHORT_Q}, '^__.+__$') AS called_by_name,
 starts_with({_SHORT_Q}, 'test_') OR len([x FOR x IN string_split(file_path, '/') IF x IN ('test', 'tests') OR starts_with(x, 'test_')]) > 0 AS test FROM s WHERE NOT ({_DEAD}) OR kind = 'function' AND {_SHORT_Q} = 'main'""")
def q06_entry_points(s: SparkSession, d: str) -> DataFrame:
    """Symbols that are called from outside, which findings of unused code pass over: entry points, names with a meaning of their own, tests."""
    symbols = once(s, d, "symbols", "repo", "qualified_name", "kind", "file_path").where(F.col("qualified_name").isNotNull())
    entries = insights.entry_points(symbols).select("sym_ord", F.lit(True).alias("entry_point"))
    short = T.short_name(F.col("qualified_name"))
    by_name = short.isin("main", "__init__", "__main__") | short.rlike("^__.+__$")
    rest = symbols.where(T.is_test_or_entry(F.col("qualified_name"), F.col("file_path"))).join(entries, "sym_ord", "full")
    rest = rest.withColumns({"entry_point": F.coalesce("entry_point", F.lit(False)), "called_by_name": by_name})
    in_tests = short.startswith("test_") | T.is_test_or_entry(F.lit("x"), F.col("file_path"))
    return rest.select("sym_ord", "repo", "qualified_name", "entry_point", "called_by_name", in_tests.alias("test"))


@query(f"""WITH {_F}, {_S}, {_C}, {_I}, {_H},
a AS (SELECT repo, count(DISTINCT path) AS files FROM f GROUP BY repo),
b AS (SELECT repo, count(*) AS symbols, count_if(kind = 'function') AS functions, count_if(kind = 'method') AS methods, count_if(kind = 'class') AS classes FROM s GROUP BY repo),
e AS (SELECT repo, count(*) AS import_edges, count(resolved_file) AS resolved_imports FROM i GROUP BY repo),
g AS (SELECT repo, count(*) AS call_edges, count(callee_qualified_name) AS resolved_calls FROM c GROUP BY repo),
k AS (SELECT repo, count(*) AS inherits_edges FROM h GROUP BY repo)
SELECT repo, coalesce(files, 0) AS files, coalesce(symbols, 0) AS symbols, CAST(coalesce(functions, 0) AS BIGINT) AS functions, CAST(coalesce(methods, 0) AS BIGINT) AS methods, CAST(coalesce(classes, 0) AS BIGINT) AS classes,
 coalesce(import_edges, 0) AS import_edges, coalesce(resolved_imports, 0) AS resolved_imports, coalesce(call_edges, 0) AS call_edges, coalesce(resolved_calls, 0) AS resolved_calls, coalesce(inherits_edges, 0) AS inherits_edges
FROM a FULL JOIN b USING (repo) FULL JOIN e USING (repo) FULL JOIN g USING (repo) FULL JOIN k USING (repo)""")
def q07_statistics(s: SparkSession, d: str) -> DataFrame:
    return insights.statistics(
        table(s, d, "source_files"), once(s, d, "symbols", "repo", "kind"), once(s, d, "import_edges", "repo", "resolved_file"), once(s, d, "call_edges", "repo", "callee_qualified_name"), once(s, d, "inherits_edges", "repo")
    )


_DEAD_SQL = f"""SELECT repo, substr(sha1('dead_code|' || qualified_name || '|' || start_line), 1, 12) AS id, 'No callers found for ''' || qualified_name || '''' AS title, qualified_name, file_path, start_line
FROM s WHERE {_DEAD} AND NOT EXISTS (SELECT 1 FROM c WHERE c.repo = s.repo AND c.callee_qualified_name = s.qualified_name)"""


@query(f"WITH {_S}, {_C} {_DEAD_SQL}")
def q08_dead_code(s: SparkSession, d: str) -> DataFrame:
    symbols = once(s, d, "symbols", "repo", "qualified_name", "kind", "file_path", "start_line", "end_line")
    return insights.dead_code(symbols, table(s, d, "call_edges")).select("repo", "id", "title", "qualified_name", "file_path", "start_line")


@query("""WITH RECURSIVE e0 AS (SELECT DISTINCT repo, importer_file AS c, resolved_file AS p FROM import_edges WHERE importer_file IS NOT NULL AND resolved_file IS NOT NULL AND importer_file <> resolved_file),
r AS (SELECT repo, c AS x, p AS y FROM e0 UNION SELECT r.repo, r.x, e0.p FROM r JOIN e0 ON r.repo = e0.repo AND r.y = e0.c),
e AS (SELECT e0.* FROM e0 JOIN r ON r.repo = e0.repo AND r.x = e0.p AND r.y = e0.c),
w AS (SELECT repo, c AS first, p AS last, [c, p] AS names FROM e WHERE c < p
 UNION ALL SELECT w.repo, w.first, e.p, list_append(w.names, e.p) FROM w JOIN e ON e.repo = w.repo AND e.c = w.last AND e.p > w.first AND NOT list_contains(w.names, e.p) WHERE len(w.names) < 9)
SELECT w.repo, array_to_string(names, ' > ') AS cycle, CAST(len(names) AS INTEGER) AS length FROM w JOIN e ON e.repo = w.repo AND e.c = w.last AND e.p = w.first WHERE len(names) <= 8
UNION ALL SELECT DISTINCT repo, '(longer not listed)', -1 FROM w WHERE len(names) = 9""")
def q09_cycles(s: SparkSession, d: str) -> DataFrame:
    """Elementary import cycles of up to eight files, and a row of length -1 per repository where longer ways were not followed.

    The number of cycles grows with length; q47_import_rings holds every file on a cycle of any length.
    """
    c, left = graph.bounded_cycles(table(s, d, "import_edges"))
    c = c.select("repo", F.array_join("cycle", " > ").alias("cycle"), F.size("cycle").alias("length"))
    return c.unionByName(left.select("repo", F.lit("(longer not listed)").alias("cycle"), F.lit(-1).alias("length")))


_RESOLVE = """n AS (SELECT DISTINCT repo, qualified_name AS q FROM s),
bf AS (SELECT repo, file_path, split_part(qualified_name, '.', -1) AS short, count(*) AS n, min(qualified_name) AS q FROM s GROUP BY ALL HAVING count(*) = 1),
br AS (SELECT repo, split_part(qualified_name, '.', -1) AS short, count(*) AS n, min(qualified_name) AS q FROM s GROUP BY ALL HAVING count(*) = 1)"""


@query(f"""WITH {_S}, {_C}, {_RESOLVE},
m AS (SELECT repo, qualified_name, max(CASE WHEN kind = 'method' THEN regexp_replace(qualified_name, '\\.[^.]*$', '') END) AS enclosing FROM s GROUP BY ALL),
p AS (SELECT c.*, m.enclosing, CASE WHEN regexp_matches(callee_name, '^(self|cls)\\.[^.]+$') THEN enclosing || '.' || split_part(callee_name, '.', -1) END AS own,
 split_part(callee_name, '.', -1) AS short FROM c LEFT JOIN m ON m.repo = c.repo AND m.qualified_name = c.caller_qualified_name)
SELECT p.edge_ord, p.repo, p.callee_name, coalesce(n1.q, n2.q, bf.q, br.q) AS resolved FROM p
LEFT JOIN n n1 ON n1.repo = p.repo AND n1.q = p.own LEFT JOIN n n2 ON n2.repo = p.repo AND n2.q = p.callee_name
LEFT JOIN bf ON bf.repo = p.repo AND bf.file_path = p.file_path AND bf.short = p.short LEFT JOIN br ON br.repo = p.repo AND br.short = p.short""")
def q10_call_resolution(s: SparkSession, d: str) -> DataFrame:
    symbols = once(s, d, "symbols", "repo", "qualified_name", "kind", "file_path")
    owner = F.when(F.col("kind") == "method", F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    owners = symbols.groupBy("repo", F.col("qualified_name").alias("caller_qualified_name")).agg(F.max(owner).alias("enclosing"))
    calls = once(s, d, "call_edges", "repo", "caller_qualified_name", "callee_name", "file_path").join(owners, ["repo", "caller_qualified_name"], "left")
    return resolve.resolve_names(calls, symbols, "callee_name", "resolved", F.col("enclosing"), F.col("file_path")).select("edge_ord", "repo", "callee_name", "resolved")


@query(f"""WITH {_S}, {_H}, {_RESOLVE},
m AS (SELECT repo, qualified_name, max(file_path) AS file_path FROM s GROUP BY ALL),
p AS (SELECT h.*, m.file_path, split_part(base_name, '.', -1) AS short FROM h LEFT JOIN m ON m.repo = h.repo AND m.qualified_name = h.class_qualified_name)
SELECT p.edge_ord, p.repo, p.base_name, coalesce(n2.q, bf.q, br.q) AS resolved FROM p LEFT JOIN n n2 ON n2.repo = p.repo AND n2.q = p.base_name
LEFT JOIN bf ON bf.repo = p.repo AND bf.file_path = p.file_path AND bf.short = p.short LEFT JOIN br ON br.repo = p.repo AND br.short = p.short""")
def q11_base_resolution(s: SparkSession, d: str) -> DataFrame:
    symbols = once(s, d, "symbols", "repo", "qualified_name", "file_path")
    place = symbols.groupBy("repo", F.col("qualified_name").alias("class_qualified_name")).agg(F.max("file_path").alias("file_path"))
    bases = once(s, d, "inherits_edges", "repo", "class_qualified_name", "base_name").join(place, ["repo", "class_qualified_name"], "left")
    return resolve.resolve_names(bases, symbols, "base_name", "resolved", None, F.col("file_path")).select("edge_ord", "repo", "base_name", "resolved")


@query(f"""WITH {_I}, {_F}, m AS (SELECT repo, {_MODULE} AS module, arg_max(path, file_id) AS path FROM f WHERE ends_with(path, '.py') GROUP BY ALL)
SELECT i.edge_ord, i.repo, i.imported_module, m.path AS resolved FROM i LEFT JOIN m ON m.repo = i.repo AND m.module = i.imported_module""")
def q12_import_resolution(s: SparkSession, d: str) -> DataFrame:
    e = once(s, d, "import_edges", "repo", "importer_file", "imported_module").withColumnRenamed("imported_module", "module")
    e = e.withColumns({"name": F.lit(None).cast("string"), "level": F.lit(0), "star": F.lit(False)})
    out = resolve.resolve_imports(e, resolve.module_map(_files(s, d), "file_id"), "resolved")
    return out.select("edge_ord", "repo", "imported_module", "resolved")


@query(f"""WITH {_S}, {_F} SELECT s.repo, s.qualified_name, arg_max(array_to_string({_LINES}[start_line:end_line], chr(10)), sym_ord) AS source
FROM s JOIN f ON f.repo = s.repo AND f.path = s.file_path WHERE content IS NOT NULL GROUP BY s.repo, s.qualified_name""")
def q13_symbol_sources(s: SparkSession, d: str) -> DataFrame:
    return resolve.symbol_sources(once(s, d, "symbols", "repo", "qualified_name", "file_path", "start_line", "end_line"), table(s, d, "source_files"))


@query(f"""WITH {_S}, {_C}, t AS (SELECT edge_ord AS qid, repo, callee_name AS target FROM c WHERE edge_ord % 20 = 0),
x AS (SELECT qid, t.repo, target, max(sym_ord) AS sym_ord, 1 AS tier FROM t JOIN s ON s.repo = t.repo AND s.qualified_name = t.target GROUP BY ALL
 UNION ALL SELECT qid, t.repo, target, sym_ord, 2 FROM t JOIN s ON s.repo = t.repo AND split_part(s.qualified_name, '.', -1) = t.target
 UNION ALL SELECT qid, t.repo, target, sym_ord, 3 FROM t JOIN s ON s.repo = t.repo AND contains(t.target, '.') AND ends_with(s.qualified_name, '.' || t.target)),
y AS (SELECT *, min(tier) OVER (PARTITION BY qid) AS best FROM x), z AS (SELECT *, count(*) OVER (PARTITION BY qid) AS found FROM y WHERE tier = best)
SELECT qid, target, sym_ord, found, CAST(CASE WHEN tier = 1 OR found = 1 THEN 1.0 ELSE 0.6 END AS DOUBLE) AS confidence FROM z""")
def q14_symbol_candidates(s: SparkSession, d: str) -> DataFrame:
    steps = _steps(once(s, d, "call_edges", "repo", "callee_name"), "edge_ord", "callee_name", "symbol_lookup")
    return retrieval.candidates(once(s, d, "symbols"), steps).select("qid", "target", "sym_ord", "found", "confidence")


@query(f"""WITH {_I}, {_F}, t AS (SELECT edge_ord AS qid, repo, imported_module AS target FROM i WHERE edge_ord % 20 = 0),
m AS (SELECT repo, {_MODULE} AS module, arg_min(path, file_id) AS path FROM f GROUP BY ALL),
b AS (SELECT repo, split_part(path, '/', -1) AS base, min(path) AS path FROM f GROUP BY ALL HAVING count(DISTINCT path) = 1),
p AS (SELECT DISTINCT repo, path FROM f)
SELECT qid, t.repo, target, coalesce(p.path, m.path, CASE WHEN NOT contains(target, '/') THEN b.path END) AS path FROM t LEFT JOIN p ON p.repo = t.repo AND p.path = t.target
LEFT JOIN m ON m.repo = t.repo AND m.module = t.target LEFT JOIN b ON b.repo = t.repo AND b.base = t.target WHERE coalesce(p.path, m.path, CASE WHEN NOT contains(target, '/') THEN b.path END) IS NOT NULL""")
def q15_file_targets(s: SparkSession, d: str) -> DataFrame:
    steps = _steps(once(s, d, "import_edges", "repo", "imported_module"), "edge_ord", "imported_module", "import_graph")
    return retrieval.file_targets(_files(s, d), steps).select("qid", "repo", "target", "path")


@query(f"""WITH {_S}, {_C}, t AS (SELECT sym_ord AS qid, repo, qualified_name AS node FROM s WHERE sym_ord % 20 = 0),
a AS (SELECT qid, c.*, row_number() OVER (PARTITION BY qid ORDER BY edge_ord) AS k FROM t JOIN c ON c.repo = t.repo AND c.callee_qualified_name = t.node),
b AS (SELECT qid, c.*, row_number() OVER (PARTITION BY qid ORDER BY edge_ord) AS k FROM t JOIN c ON c.repo = t.repo AND c.caller_qualified_name = t.node)
SELECT qid, caller_qualified_name AS qualified_name, file_path, line AS start_line, 'Calls ' || coalesce(callee_qualified_name, callee_name) || ' (line ' || line || ')' AS explanation, CAST(1.0 AS DOUBLE) AS confidence FROM a WHERE k <= 20
UNION ALL SELECT qid, callee_qualified_name, file_path, line, 'Called by ' || caller_qualified_name || ' (line ' || line || ')' || CASE WHEN callee_qualified_name IS NULL THEN ' - target not resolved to a known symbol' ELSE '' END,
 CASE WHEN callee_qualified_name IS NULL THEN 0.3 ELSE 1.0 END FROM b WHERE k <= 20""")
def q16_call_evidence(s: SparkSession, d: str) -> DataFrame:
    t = _tables(s, d)
    steps = _steps(once(s, d, "symbols", "repo", "qualified_name"), "sym_ord", "qualified_name", "call_graph")
    return retrieval.call_evidence(t, steps).select("qid", "qualified_name", "file_path", "start_line", "explanation", "confidence")


@query(f"""WITH {_F}, {_I}, t AS (SELECT file_id AS qid, repo, path FROM f WHERE file_id % 20 = 0)
SELECT qid, coalesce(resolved_file, importer_file) AS file_path, importer_file || ' imports ' || imported_module || CASE WHEN resolved_file IS NULL THEN ' (external, not part of this repo)' ELSE '' END AS explanation,
 CAST(CASE WHEN resolved_file IS NULL THEN 0.3 ELSE 1.0 END AS DOUBLE) AS confidence FROM t JOIN i ON i.repo = t.repo AND i.importer_file = t.path
UNION ALL SELECT qid, importer_file, importer_file || ' imports this file', 1.0 FROM t JOIN i ON i.repo = t.repo AND i.resolved_file = t.path""")
def q17_import_evidence(s: SparkSession, d: str) -> DataFrame:
    files = _files(s, d)
    t = retrieval.Tables(files, files, files, once(s, d, "import_edges"), files, files, files)
    return retrieval.import_evidence(t, _steps(files, "file_id", "path", "import_graph")).select("qid", "file_path", "explanation", "confidence")


@query(f"""WITH {_S}, {_H}, t AS (SELECT sym_ord AS qid, repo, qualified_name AS node FROM s WHERE sym_ord % 20 = 0),
p AS (SELECT repo, qualified_name, arg_max(file_path, sym_ord) AS file_path, arg_max(start_line, sym_ord) AS start_line FROM s GROUP BY ALL)
SELECT qid, base_qualified_name AS qualified_name, p.file_path, CAST(p.start_line AS VARCHAR) AS start_line, 'Base class of ' || class_qualified_name || CASE WHEN base_qualified_name IS NULL THEN ' (external, not part of this repo)' ELSE '' END AS explanation,
 CAST(CASE WHEN base_qualified_name IS NULL THEN 0.3 ELSE 1.0 END AS DOUBLE) AS confidence
FROM t JOIN h ON h.repo = t.repo AND h.class_qualified_name = t.node LEFT JOIN p ON p.repo = h.repo AND p.qualified_name = h.base_qualified_name
UNION ALL SELECT qid, class_qualified_name, p.file_path, CAST(p.start_line AS VARCHAR), 'Subclass of ' || coalesce(base_qualified_name, base_name), 1.0
FROM t JOIN h ON h.repo = t.repo AND h.base_qualified_name = t.node LEFT JOIN p ON p.repo = h.repo AND p.qualified_name = h.class_qualified_name""")
def q18_hierarchy_evidence(s: SparkSession, d: str) -> DataFrame:
    t = _tables(s, d)
    steps = _steps(once(s, d, "symbols", "repo", "qualified_name"), "sym_ord", "qualified_name", "hierarchy")
    return retrieval.hierarchy_evidence(t, steps).select("qid", "qualified_name", "file_path", F.col("start_line").cast("string").alias("start_line"), "explanation", "confidence")


@query("""WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT q.vec_id AS query_id, e.vec_id AS id, 1 - list_cosine_similarity(q.v, e.v) AS distance FROM e q, e WHERE q.vec_id % 20 = 0),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) AS rank FROM x) SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM y WHERE rank <= 8""")
def q19_nearest(s: SparkSession, d: str) -> DataFrame:
    e = once(s, d, "embeddings", "embedding").withColumnRenamed("vec_id", "id")
    out = vectors.nearest(e, e.where("id % 20 = 0").withColumnRenamed("id", "query_id"))
    return out.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def _embedded(name: str, key: str, text: str) -> str:
    """SQL of the default embedder: hashed words, damped, of length one, in single precision."""
    return f"""{name}w AS (SELECT {key} AS id, repo, lower(unnest(regexp_extract_all({text}, '[A-Za-z]+|[0-9]+'))) AS w FROM {name}),
{name}h AS (SELECT id, repo, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM {name}w),
{name}b AS (SELECT id, repo, h % 256 AS b, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS n FROM {name}h GROUP BY ALL),
{name}l AS (SELECT id, repo, b, sign(n) * ln(1 + abs(n)) AS x FROM {name}b),
{name}n AS (SELECT id, sqrt(sum(x * x)) AS n FROM {name}l GROUP BY id),
{name}v AS (SELECT l.id, repo, b, CAST(CAST(x / n AS FLOAT) AS DOUBLE) AS x FROM {name}l l JOIN {name}n k ON k.id = l.id WHERE n > 0)"""


@query(f"""WITH c AS (SELECT DISTINCT chunk_ord, repo, content FROM chunks), q AS (SELECT DISTINCT doc_id, repo, text FROM documents WHERE doc_id % 20 = 0 AND length(trim(text)) > 0),
{_embedded("c", "chunk_ord", "content")}, {_embedded("q", "doc_id", "text")},
cz AS (SELECT id, sqrt(sum(x * x)) AS n FROM cv GROUP BY id), qz AS (SELECT id, sqrt(sum(x * x)) AS n FROM qv GROUP BY id),
p AS (SELECT q.id AS q, c.id AS c, sum(q.x * c.x) AS s FROM qv q JOIN cv c ON c.repo = q.repo AND c.b = q.b GROUP BY ALL),
d AS (SELECT q.id AS q, c.id AS c, 1 - coalesce(p.s, 0) / (qz.n * cz.n) AS distance FROM (SELECT DISTINCT id, repo FROM qv) q JOIN (SELECT DISTINCT id, repo FROM cv) c ON c.repo = q.repo
 JOIN qz ON qz.id = q.id JOIN cz ON cz.id = c.id LEFT JOIN p ON p.q = q.id AND p.c = c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(distance, 12), c) AS k FROM d)
SELECT DISTINCT q AS qid, qualified_name, file_path, start_line, round(greatest(0, 1 - distance), 6) AS confidence, CAST(k AS BIGINT) AS place FROM r JOIN chunks ON chunk_ord = c WHERE k <= 8""")
def q20_semantic_evidence(s: SparkSession, d: str) -> DataFrame:
    """Every twentieth document's text against the chunks of its repository."""
    t = retrieval.Tables(*[once(s, d, "chunks")] * 7)
    docs = once(s, d, "documents", "repo", "text").where(F.length(F.trim("text")) > 0)
    steps = _steps(docs, "doc_id", "text", "semantic_search")
    e = retrieval.semantic_evidence(t, steps)
    return e.select("qid", "qualified_name", "file_path", "start_line", F.round("confidence", 6).alias("confidence"), F.element_at("ord", 2).alias("place"))


@query("""WITH c AS (SELECT DISTINCT repo, qualified_name, id FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY repo, qualified_name ORDER BY id) AS rank FROM c)
SELECT repo, qualified_name, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def q21_exact_lookup(s: SparkSession, d: str) -> DataFrame:
    """Of every name of a repository its first eight chunks by id."""
    w = retrieval.Window.partitionBy("repo", "qualified_name").orderBy("id")
    return table(s, d, "chunks").select("repo", "qualified_name", "id").distinct().withColumn("rank", F.row_number().over(w)).where("rank <= 8")


@query("""WITH c AS (SELECT DISTINCT repo, id FROM chunks WHERE contains(content, 'Error')), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS rank FROM c)
SELECT repo, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def q22_lexical_contains(s: SparkSession, d: str) -> DataFrame:
    w = retrieval.Window.partitionBy("repo").orderBy("id")
    c = table(s, d, "chunks").where(F.contains("content", F.lit("Error"))).select("repo", "id").distinct()
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 8")


def _plans(s: SparkSession, d: str) -> DataFrame:
    """A question about every twentieth symbol: look it up, then who calls it, at most five items."""
    syms = once(s, d, "symbols", "repo", "qualified_name").where("sym_ord % 20 = 0")
    null = F.lit(None).cast("string")
    step = lambda k, direction=null: F.struct(F.lit(k).alias("strategy"), F.col("qualified_name").alias("target"), null.alias("query"), direction.alias("direction"))
    return syms.select(F.col("sym_ord").alias("qid"), "repo", F.concat(F.lit("What calls "), F.col("qualified_name"), F.lit("?")).alias("question"), F.array(step("symbol_lookup"), step("call_graph", F.lit("callers"))).alias("steps"), F.lit(5).alias("max_results"))


_RUN = f"""{_S}, {_C}, {_F},
t AS (SELECT sym_ord AS qid, repo, qualified_name AS node FROM s WHERE sym_ord % 20 = 0 AND qualified_name IS NOT NULL),
src AS (SELECT s.repo, s.qualified_name, arg_max(array_to_string({_LINES}[start_line:end_line], chr(10)), sym_ord) AS source FROM s JOIN f ON f.repo = s.repo AND f.path = s.file_path WHERE content IS NOT NULL GROUP BY s.repo, s.qualified_name),
l AS (SELECT repo, qualified_name, max(sym_ord) AS o, arg_max(file_path, sym_ord) AS p, arg_max(start_line, sym_ord) AS a, arg_max(end_line, sym_ord) AS b, arg_max(coalesce(signature, chr(0)), sym_ord) AS g FROM s GROUP BY ALL),
u AS (SELECT qid, t.repo, 0 AS step, CAST(0 AS BIGINT) AS e, 'symbol' AS source, node AS qualified_name, p AS file_path, a AS start_line, b AS end_line, 'Exact match for ''' || node || '''' AS explanation, nullif(g, chr(0)) AS fallback
 FROM t JOIN l ON l.repo = t.repo AND l.qualified_name = node
 UNION ALL SELECT qid, t.repo, 1, edge_ord, 'call_graph', caller_qualified_name, file_path, line, line, 'Calls ' || coalesce(callee_qualified_name, callee_name) || ' (line ' || line || ')', caller_qualified_name || ' calls this at line ' || line
 FROM t JOIN c ON c.repo = t.repo AND c.callee_qualified_name = node),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY step, e) AS INTEGER) AS item FROM u QUALIFY item <= 5),
v AS (SELECT r.*, coalesce(nullif(src.source, ''), fallback) AS content FROM r LEFT JOIN src ON src.repo = r.repo AND src.qualified_name = r.qualified_name)"""


@query(f"WITH {_RUN} SELECT qid, item, source, qualified_name, explanation, CAST(1 AS DOUBLE) AS confidence FROM v")
def q23_execute(s: SparkSession, d: str) -> DataFrame:
    """Plans run to evidence with caps and the semantic fallback."""
    evidence, _ = retrieval.execute(_tables(s, d), _plans(s, d))
    return evidence.select("qid", "item", "source", "qualified_name", "explanation", "confidence")


@query(f"""WITH {_RUN}, k AS (SELECT qid, item, '[' || item || '] source=' || source || ' location=' || CASE WHEN file_path IS NULL THEN '(no location)' WHEN start_line IS NULL OR end_line IS NULL THEN file_path ELSE file_path || ':' || start_line || '-' || end_line END
 || ' confidence=1.00' || chr(10) || 'reason: ' || explanation || chr(10) || coalesce(content, '') AS block FROM v)
SELECT qid, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY item) AS evidence_text FROM k GROUP BY qid""")
def q24_prompts(s: SparkSession, d: str) -> DataFrame:
    evidence, _ = retrieval.execute(_tables(s, d), _plans(s, d))
    return answers.prompts(evidence)


@query(f"WITH {_RUN} SELECT qid, item - 1 AS place, item, source, qualified_name, file_path, start_line, end_line FROM v WHERE item <= 3")
def q25_answers(s: SparkSession, d: str) -> DataFrame:
    """Extractive answers, their citations resolved to evidence."""
    evidence, _ = retrieval.execute(_tables(s, d), _plans(s, d))
    return answers.citations(answers.parse(answers.extracts(evidence)), evidence)


@query("""WITH RECURSIVE x AS (SELECT DISTINCT doc_id, coalesce(repo, '') AS repo, n_chars FROM documents WHERE n_chars IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n_chars, doc_id) AS k FROM x),
p AS (SELECT repo, doc_id, n_chars, k, CAST(0 AS BIGINT) AS batch, 1 AS size FROM o WHERE k = 1
 UNION ALL SELECT o.repo, o.doc_id, o.n_chars, o.k, CASE WHEN p.size + 1 > 32 OR (p.size + 1) * o.n_chars > 8192 THEN p.batch + 1 ELSE p.batch END,
  CASE WHEN p.size + 1 > 32 OR (p.size + 1) * o.n_chars > 8192 THEN 1 ELSE p.size + 1 END FROM p JOIN o ON o.repo = p.repo AND o.k = p.k + 1)
SELECT repo, doc_id, n_chars AS length, batch FROM p""")
def q26_batch_packing(s: SparkSession, d: str) -> DataFrame:
    docs = once(s, d, "documents", "repo", "n_chars").withColumn("repo", F.coalesce("repo", F.lit("")))
    return packing.pack(docs, "repo", "doc_id", "n_chars")


@query("""WITH c AS (SELECT DISTINCT chunk_ord, repo, len(regexp_extract_all(content, '[A-Za-z]+|[0-9]+')) AS n FROM chunks)
SELECT repo, CAST(count_if(n > 64) AS BIGINT) AS truncated, CAST(max(n) AS INTEGER) AS longest, CAST(sum(least(n, 64)) AS BIGINT) AS kept FROM c GROUP BY repo""")
def q27_truncate(s: SparkSession, d: str) -> DataFrame:
    """Chunks cut at 64 tokens, as for a model that takes no more."""
    c = once(s, d, "chunks", "repo", "content")
    n, kept = F.size(vectors.tokens(F.col("content"))), F.size(vectors.tokens(vectors.truncated(F.col("content"), 64)))
    return c.groupBy("repo").agg(F.count_if(n > 64).alias("truncated"), F.max(n).alias("longest"), F.sum(kept.cast("long")).alias("kept"))


@query(rf"""WITH f AS (SELECT DISTINCT repo, path FROM source_files WHERE ends_with(path, '.py')), m AS (SELECT *, {_MODULE} AS module FROM f)
SELECT repo, path, module, CASE WHEN regexp_matches(path, '(^|/)__init__\.py$') THEN module ELSE regexp_replace(module, '\.?[^.]*$', '') END AS package FROM m""")
def q28_module_names(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "source_files").where(F.col("path").endswith(".py")).select("repo", "path").distinct()
    return f.select("repo", "path", T.module_name(F.col("path")).alias("module"), T.package_of(F.col("path")).alias("package"))


@query(r"""WITH n AS (SELECT DISTINCT repo_name, regexp_replace(lower(repo_name), '[^a-z0-9_-]', '-', 'g') AS a FROM repo_metadata), m AS (SELECT repo_name, substr(regexp_replace(a, '^[-_]+|[-_]+$', '', 'g'), 1, 63) AS b FROM n)
SELECT repo_name, CASE WHEN length(b) < 3 THEN 'repo-' || b ELSE b END AS slug FROM m""")
def q29_slugs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "repo_metadata").select("repo_name").distinct().select("repo_name", T.slug(F.col("repo_name")).alias("slug"))


@query(r"""SELECT DISTINCT source, regexp_matches(source, '^(https?://|git@)|\.git$') AS is_url, regexp_replace(split_part(regexp_replace(source, '/+$', ''), '/', -1), '\.git$', '') AS name FROM repo_metadata""")
def q30_repo_urls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "repo_metadata").select("source").distinct().select("source", T.is_git_url(F.col("source")).alias("is_url"), T.repo_of_url(F.col("source")).alias("name"))


@query(f"""WITH {_S}, {_H}, p AS (SELECT repo, qualified_name, arg_max(file_path, sym_ord) AS f, arg_max(start_line, sym_ord) AS a, arg_max(end_line, sym_ord) AS b FROM s GROUP BY ALL)
SELECT edge_ord, CASE WHEN f IS NULL THEN '(no location)' WHEN a IS NULL OR b IS NULL THEN f ELSE f || ':' || a || '-' || b END AS location FROM h LEFT JOIN p ON p.repo = h.repo AND p.qualified_name = h.base_qualified_name""")
def q31_locations(s: SparkSession, d: str) -> DataFrame:
    p = once(s, d, "symbols").groupBy("repo", F.col("qualified_name").alias("base_qualified_name")).agg(F.max_by(F.struct("file_path", "start_line", "end_line"), "sym_ord").alias("p"))
    e = once(s, d, "inherits_edges", "repo", "base_qualified_name").join(p, ["repo", "base_qualified_name"], "left")
    return e.select("edge_ord", T.location(F.col("p.file_path"), F.col("p.start_line"), F.col("p.end_line")).alias("location"))


@query("""WITH c AS (SELECT DISTINCT * EXCLUDE (content, docstring) FROM chunks) SELECT chunk_ord, CASE WHEN chunk_type = 'module' THEN file_path || '::module::<module>'
 ELSE concat_ws('::', file_path, chunk_type, qualified_name, start_line || '-' || end_line) END AS id FROM c""")
def q32_chunk_ids(s: SparkSession, d: str) -> DataFrame:
    c = once(s, d, "chunks", "file_path", "chunk_type", "qualified_name", "start_line", "end_line")
    return c.select("chunk_ord", T.chunk_id(*(F.col(x) for x in ("file_path", "chunk_type", "qualified_name", "start_line", "end_line"))).alias("id"))


@query(f"""WITH {_F}, {_S}, {_C}, {_I}, {_H},
n AS (SELECT repo, qualified_name AS id, 'symbol' AS kind FROM s UNION SELECT repo, path, 'file' FROM f UNION SELECT repo, 'external:' || imported_module, 'external' FROM i WHERE resolved_file IS NULL
 UNION SELECT repo, 'external:' || callee_name, 'external' FROM c WHERE callee_qualified_name IS NULL UNION SELECT repo, 'external:' || base_name, 'external' FROM h WHERE base_qualified_name IS NULL),
e AS (SELECT repo, 'imports' AS kind, count(*) AS n FROM i GROUP BY repo UNION ALL SELECT repo, 'calls', count(*) FROM c GROUP BY repo UNION ALL SELECT repo, 'inherits', count(*) FROM h GROUP BY repo)
SELECT repo, kind, count(*) AS n FROM n WHERE id IS NOT NULL GROUP BY ALL UNION ALL SELECT * FROM e""")
def q33_graph_counts(s: SparkSession, d: str) -> DataFrame:
    i, c, h = once(s, d, "import_edges"), once(s, d, "call_edges"), once(s, d, "inherits_edges")
    n = graph.nodes(table(s, d, "symbols"), i, c, h, table(s, d, "source_files")).groupBy("repo", F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(graph.edges(i, c, h).groupBy("repo", F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


@query(f"WITH {_S} SELECT repo, qualified_name, max(sym_ord) AS sym_ord, arg_max(file_path, sym_ord) AS file_path, arg_max(start_line, sym_ord) AS start_line FROM s GROUP BY repo, qualified_name")
def q34_last_wins(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "symbols").groupBy("repo", "qualified_name").agg(F.max_by(F.struct("sym_ord", "file_path", "start_line"), "sym_ord").alias("x"))
    return x.select("repo", "qualified_name", "x.*")


@query("""WITH m AS (SELECT DISTINCT ingest_id, repo_name, len(files) AS n, symbol_count FROM repo_metadata) SELECT repo_name, max(ingest_id) AS ingest_id, CAST(arg_max(n, ingest_id) AS INTEGER) AS files, arg_max(symbol_count, ingest_id) AS symbol_count FROM m GROUP BY repo_name""")
def q35_repositories(s: SparkSession, d: str) -> DataFrame:
    """The latest ingest of each repository."""
    m = table(s, d, "repo_metadata").groupBy("repo_name").agg(F.max_by(F.struct("ingest_id", F.size("files").alias("files"), "symbol_count"), "ingest_id").alias("m"))
    return m.select("repo_name", "m.*")


@query("""WITH c AS (SELECT DISTINCT chunk_ord, repo, chunk_type, qualified_name, start_line FROM chunks),
p AS (SELECT chunk_ord AS qid, CASE chunk_type WHEN 'function' THEN 'symbol_lookup' WHEN 'method' THEN 'call_graph' WHEN 'class_skeleton' THEN 'hierarchy' END AS k, qualified_name AS q, start_line - 5 AS m FROM c)
SELECT qid, coalesce(k, 'semantic_search') AS strategy, CASE WHEN k IS NOT NULL THEN q END AS target, CASE WHEN k IS NULL THEN 'What does ' || q || ' do?' END AS query,
 CASE WHEN k = 'call_graph' THEN 'callers' END AS direction, CASE WHEN k IS NOT NULL AND m > 0 THEN CAST(m AS VARCHAR) END AS max_results, CASE WHEN k IS NULL THEN 'fallback' ELSE 'explain' END AS intent FROM p""")
def q36_parse_plans(s: SparkSession, d: str) -> DataFrame:
    """Tool arguments in JSON, one per chunk, parsed: unknown strategies, odd directions and caps, fallbacks."""
    c = once(s, d, "chunks", "repo", "chunk_type", "qualified_name", "start_line")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("function", "symbol_lookup", "method", "call_graph", "class_skeleton", "hierarchy", "module", "read_minds")]), F.col("chunk_type"))
    direction = F.when(F.col("chunk_type") == "method", F.lit("callers")).otherwise(F.lit("sideways"))
    body = F.to_json(F.struct(F.array(F.struct(kind.alias("strategy"), F.col("qualified_name").alias("target"), direction.alias("direction"))).alias("steps"), F.lit("explain").alias("intent"), (F.col("start_line") - 5).alias("max_results")))
    asked = c.select(F.col("chunk_ord").alias("qid"), "repo", F.concat(F.lit("What does "), F.col("qualified_name"), F.lit(" do?")).alias("question"), body.alias("arguments"))
    p = retrieval.parse_plans(asked)
    return p.select("qid", F.explode("steps").alias("s"), F.col("max_results").cast("string").alias("max_results"), "intent").select("qid", "s.strategy", "s.target", "s.query", "s.direction", "max_results", "intent")


def _findings(s: SparkSession, d: str) -> DataFrame:
    symbols = once(s, d, "symbols", "repo", "qualified_name", "kind", "file_path", "start_line", "end_line")
    files = table(s, d, "source_files")
    parts = [insights.dead_code(symbols, table(s, d, "call_edges")), insights.todos(files.where(F.col("path").endswith(".py"))), insights.architecture(files, symbols, once(s, d, "import_edges", "repo", "resolved_file"))]
    return reduce(DataFrame.unionByName, parts)


@query(rf"""WITH {_F}, {_S}, {_C}, {_I},
l AS (SELECT repo, path, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM f WHERE ends_with(path, '.py')),
t AS (SELECT DISTINCT repo, path, n FROM l WHERE regexp_matches(line, '(?i)#\s*(TODO|FIXME|HACK|XXX)\b')),
g AS (SELECT DISTINCT repo, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '(root)' END AS package FROM f),
n AS (SELECT repo, resolved_file, count(*) AS k, min(edge_ord) AS e FROM i WHERE resolved_file IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY k DESC, e) AS o FROM n),
u AS (SELECT repo, 'dead_code' AS category, 'warning' AS severity FROM ({_DEAD_SQL}) UNION ALL SELECT repo, 'todo', 'info' FROM t UNION ALL SELECT repo, 'architecture', 'info' FROM g
 UNION ALL SELECT repo, 'architecture', 'info' FROM r WHERE o <= 10 AND k >= 2 UNION ALL SELECT repo, 'architecture', 'info' FROM s WHERE kind = 'function' AND {_SHORT_Q} = 'main')
SELECT repo, category, severity, count(*) AS findings FROM u GROUP BY ALL""")
def q37_report_summary(s: SparkSession, d: str) -> DataFrame:
    return insights.summary(_findings(s, d))


@query(rf"""WITH {_F}, {_S}, {_C}, {_I},
l AS (SELECT repo, path, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM f WHERE ends_with(path, '.py')),
t AS (SELECT DISTINCT repo, path, n, upper(regexp_extract(line, '#\s*(TODO|FIXME|HACK|XXX)\b', 1, 'i')) AS tag FROM l WHERE regexp_matches(line, '(?i)#\s*(TODO|FIXME|HACK|XXX)\b')),
g AS (SELECT repo, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '(root)' END AS package, count(DISTINCT path) AS n FROM f GROUP BY ALL),
n AS (SELECT repo, resolved_file, count(*) AS k, min(edge_ord) AS e FROM i WHERE resolved_file IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY k DESC, e) AS o FROM n)
SELECT repo, id, 'dead_code' AS category, 'warning' AS severity, title FROM ({_DEAD_SQL})
UNION ALL SELECT repo, substr(sha1('todo|' || path || '|' || n), 1, 12), 'todo', 'info', tag || ' in ' || path || ':' || n FROM t
UNION ALL SELECT repo, substr(sha1('architecture|package|' || package), 1, 12), 'architecture', 'info', 'Package ''' || package || ''': ' || n || ' file(s)' FROM g
UNION ALL SELECT repo, substr(sha1('architecture|hub|' || resolved_file), 1, 12), 'architecture', 'info', '''' || resolved_file || ''' is imported by ' || k || ' file(s)' FROM r WHERE o <= 10 AND k >= 2
UNION ALL SELECT repo, substr(sha1('architecture|entry_point|' || qualified_name), 1, 12), 'architecture', 'info', 'Entry point: ''' || qualified_name || '''' FROM s WHERE kind = 'function' AND {_SHORT_Q} = 'main'""")
def q37_flagship_report(s: SparkSession, d: str) -> DataFrame:
    """Findings of unused code, markers and structure in one table."""
    return _findings(s, d).select("repo", "id", "category", "severity", "title")


@query()
def q38_complexity(s: SparkSession, d: str) -> DataFrame:
    symbols = once(s, d, "symbols", "repo", "qualified_name", "kind", "file_path", "start_line", "end_line")
    return insights.complexity(symbols, resolve.symbol_sources(symbols, table(s, d, "source_files")), 4).select("repo", "qualified_name", "start_line", "details")


@query(f"WITH {_S} SELECT sym_ord, repo, qualified_name, kind, file_path, start_line, end_line, signature FROM s")
def q39_parse_symbols(s: SparkSession, d: str) -> DataFrame:
    """The given symbols as parsing all files again reads them; the SQL has what the table says."""
    keys = ["repo", "file_path", "qualified_name", "start_line"]
    read = parse.symbols(parse.parse(_python(s, d))).select(*keys, "kind", "end_line", "signature").dropDuplicates(keys)
    return once(s, d, "symbols", *keys).join(read, keys, "left").select("sym_ord", "repo", "qualified_name", "kind", "file_path", "start_line", "end_line", "signature")


@query("WITH c AS (SELECT DISTINCT * EXCLUDE (docstring) FROM chunks) SELECT chunk_ord, repo, id, chunk_type, qualified_name, start_line, end_line, md5(content) AS content FROM c")
def q40_parse_chunks(s: SparkSession, d: str) -> DataFrame:
    """The given chunks as parsing all files again reads them, their contents as a hash."""
    read = parse.chunks(parse.parse(_python(s, d))).select("repo", "id", "chunk_type", "qualified_name", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content")).dropDuplicates(["repo", "id"])
    return once(s, d, "chunks", "repo", "id").join(read, ["repo", "id"], "left").select("chunk_ord", "repo", "id", "chunk_type", "qualified_name", "start_line", "end_line", "content")


@query(f"""WITH {_C}, {_I} SELECT edge_ord, repo, 'call' AS kind, file_path AS at, callee_name AS name, callee_qualified_name AS target FROM c
UNION ALL SELECT edge_ord, repo, 'import', importer_file, imported_module, resolved_file FROM i""")
def q41_parse_edges(s: SparkSession, d: str) -> DataFrame:
    """The given call and import edges as parsing all files again finds and resolves them."""
    p = cut(parse.parse(_python(s, d)))
    sym = parse.symbols(p).dropDuplicates(["repo", "file_path", "ord"])
    keys = ["repo", "file_path", "caller_qualified_name", "callee_name", "line"]
    calls = resolve.resolve_names(parse.calls(p).dropDuplicates(keys), sym, "callee_name", "target", F.col("enclosing_class"), F.col("file_path")).select(*keys, "target")
    imports = resolve.resolve_imports(parse.imports(p), resolve.module_map(_files(s, d), "file_id"), "target").select("repo", "importer_file", "imported_module", "target").distinct()
    a = once(s, d, "call_edges", *keys).join(calls, keys, "left").select("edge_ord", "repo", F.lit("call").alias("kind"), F.col("file_path").alias("at"), F.col("callee_name").alias("name"), "target")
    b = once(s, d, "import_edges", "repo", "importer_file", "imported_module").join(imports, ["repo", "importer_file", "imported_module"], "left")
    return a.unionByName(b.select("edge_ord", "repo", F.lit("import").alias("kind"), F.col("importer_file").alias("at"), F.col("imported_module").alias("name"), "target"))


@query("""SELECT chunk_type, count(*) AS chunks FROM (SELECT DISTINCT chunk_ord, chunk_type FROM chunks) GROUP BY chunk_type""")
def q42_chunk_types(s: SparkSession, d: str) -> DataFrame:
    return once(s, d, "chunks", "chunk_type").groupBy("chunk_type").agg(F.count("*").alias("chunks"))


@query()
def q43_complexity_histogram(s: SparkSession, d: str) -> DataFrame:
    """Functions by cyclomatic complexity, from the chunks."""
    c = once(s, d, "chunks", "chunk_type", "content").where(F.col("chunk_type").isin("function", "method"))
    body = F.regexp_replace("content", r"^[^\n]*\n[^\n]*\n", "")
    return c.groupBy(complexity_column(body).alias("complexity")).agg(F.count("*").alias("functions"))


@query(r"""WITH d AS (SELECT doc_id, text, lower(text) AS low, CASE WHEN regexp_extract(text, '`([A-Za-z_][\w./]*)`', 1) <> '' THEN regexp_extract(text, '`([A-Za-z_][\w./]*)`', 1)
 WHEN regexp_extract(text, '\b([A-Za-z_]\w*(?:\.\w+)+|[a-z]+_\w+)\b', 1) <> '' THEN regexp_extract(text, '\b([A-Za-z_]\w*(?:\.\w+)+|[a-z]+_\w+)\b', 1) END AS target FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))
SELECT doc_id AS qid, target, CASE WHEN target IS NULL THEN 'explore' WHEN regexp_matches(low, '\b(break|impact|affect|change[sd]?)\b') THEN 'impact' WHEN regexp_matches(low, '\b(subclass\w*|derive\w*|extends?)\b') THEN 'subclasses'
 WHEN regexp_matches(low, '\b(bases?|parents?|inherits?)\b') THEN 'bases' WHEN regexp_matches(target, '/|\.py$') OR regexp_matches(low, '\bimport\w*\b') THEN 'imports'
 WHEN regexp_matches(low, '\b(who|what|which) calls\b|\bcallers?\b|\bused by\b') THEN 'callers' WHEN regexp_matches(low, '\bcalls?\b|\bcallees?\b|\buses\b') THEN 'callees' ELSE 'lookup' END AS intent FROM d""")
def q44_rule_plans(s: SparkSession, d: str) -> DataFrame:
    """Every document's text planned as a question."""
    docs = once(s, d, "documents", "repo", "text").where(F.col("text").isNotNull())
    p = planning.plan(docs.select(F.col("doc_id").alias("qid"), "repo", F.col("text").alias("question")))
    return p.select("qid", planning.target(F.col("question")).alias("target"), "intent")


@query(f"WITH {_S} SELECT repo, kind, count(*) AS symbols FROM s GROUP BY ALL")
def q45_parse_table_function(s: SparkSession, d: str) -> DataFrame:
    """The given symbols that the table function parse_python finds in the files, per repository and kind."""
    s.udtf.register("parse_python", ParsePython)
    _python(s, d).where(F.col("content").isNotNull()).createOrReplaceTempView("gnomon_files")
    once(s, d, "symbols", "repo", "file_path", "qualified_name", "start_line").createOrReplaceTempView("gnomon_symbols")
    return s.sql(
        """WITH found AS (SELECT DISTINCT f.repo, f.path, p.qualified_name, p.start_line, p.kind FROM gnomon_files f, LATERAL parse_python(f.path, f.content) p)
        SELECT repo, kind, count(*) AS symbols FROM gnomon_symbols JOIN found USING (repo, qualified_name, start_line) WHERE path = file_path GROUP BY repo, kind"""
    )


@query(r"""SELECT strftime(date_trunc('day', ingested_at), '%Y-%m-%d') AS day, repo, count(*) AS files, CAST(sum(coalesce(len(regexp_extract_all(content, '(?i)#\s*(TODO|FIXME|HACK|XXX)\b')), 0)) AS BIGINT) AS markers
FROM source_files WHERE ingested_at IS NOT NULL GROUP BY ALL""")
def q46_stream_markers(s: SparkSession, d: str) -> DataFrame:
    """The files read as a stream: arrivals and markers per day and repository."""
    path = f"{d}/source_files.parquet"
    # a pattern, so that a table of one file streams like a folder of many
    counts = ingest.marker_counts(ingest.source(s, f"{d}/source_files.parque[t]", s.read.parquet(path).schema))
    out = ingest.drain(counts, shared_folder(s))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "repo", "files", "markers")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT repo, importer_file AS c, resolved_file AS p FROM import_edges WHERE importer_file IS NOT NULL AND resolved_file IS NOT NULL AND importer_file <> resolved_file),
r AS (SELECT repo, c AS x, p AS y FROM e UNION SELECT r.repo, r.x, e.p FROM r JOIN e ON r.repo IS NOT DISTINCT FROM e.repo AND r.y = e.c)
SELECT a.repo, min(a.y) AS ring, a.x AS file, count(*) AS files FROM r a JOIN r b ON a.repo IS NOT DISTINCT FROM b.repo AND a.x = b.y AND a.y = b.x GROUP BY a.repo, a.x""")
def q47_import_rings(s: SparkSession, d: str) -> DataFrame:
    """Every file on an import cycle of any length with its strongly connected set."""
    return graph.import_rings(table(s, d, "import_edges"))
