import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gnomon import service
from gnomon.functions import text as T
from gnomon.functions import vectors
from gnomon.functions.complexity import complexity
from gnomon.operators import answers, graph, insights, packing, parse, resolve, retrieval
from gnomon.sources.scan import scan
from gnomon.sources.store import NotIngested, SchemaMismatch, Store

FILES = "repo string, path string, content string"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "\n\n", "a\r\nb\rc", "x\x0by\x0cz", "p\u2028q\x85r", "a\n\nb\n"])
def test_lines_are_those_of_python(spark, text):
    assert one(spark, T.lines(F.col("t")), t=text) == text.splitlines()
    assert one(spark, T.slice_lines(F.col("t"), F.lit(1), F.lit(2)), t=text) == "\n".join(text.splitlines()[:2])


@pytest.mark.parametrize(
    ("path", "module", "package"),
    [("a/b.py", "a.b", "a"), ("src/pkg/a.py", "pkg.a", "pkg"), ("pkg/__init__.py", "pkg", "pkg"), ("__init__.py", "", ""), ("top.py", "top", ""), ("src/a/__init__.py", "a", "a"), ("srcs/a.py", "srcs.a", "srcs")],
)
def test_module_names(spark, path, module, package):
    assert one(spark, T.module_name(F.col("p")), p=path) == module == parse.dotted(path)
    assert one(spark, T.package_of(F.col("p")), p=path) == package


@pytest.mark.parametrize(("package", "module", "level", "want"), [("a.b", "x", 1, "a.b.x"), ("a.b", "x", 2, "a.x"), ("a.b", "", 2, "a"), ("a.b", "x.y", 0, "x.y"), ("a.b", "", 4, "a"), ("", "x", 1, "x")])
def test_relative_imports(spark, package, module, level, want):
    assert one(spark, T.absolute_module(F.col("p"), F.col("m"), F.lit(level)), p=package, m=module) == want


def test_names(spark):
    assert one(spark, T.slug(F.col("x")), x="My Repo!") == "my-repo"
    assert one(spark, T.slug(F.col("x")), x="a") == "repo-a"
    assert one(spark, T.repo_of_url(F.col("x")), x="https://h.example/a/b.git/") == "b"
    assert one(spark, T.location(F.col("x"), F.lit(1), F.lit(2)), x="f.py") == "f.py:1-2"
    assert one(spark, T.location(F.lit(None).cast("string"), F.lit(1), F.lit(2)), x="") == "(no location)"
    assert one(spark, T.location(F.col("x"), F.lit(None).cast("int"), F.lit(2)), x="f") == "f"
    assert one(spark, T.finding_id(F.lit("dead_code"), F.col("x"), F.lit(None).cast("string")), x="q") == one(spark, T.finding_id(F.lit("dead_code"), F.col("x")), x="q")
    assert one(spark, T.semantic_confidence(F.lit(1.5)), x="") == 0.0
    assert one(spark, T.semantic_confidence(F.lit(None).cast("double")), x="") is None


def test_complexity():
    assert complexity("def f(x):\n" + "    if x: pass\n" * 12) == 13
    assert complexity("    def f(a, b):\n        return a and b or a\n") == 3
    assert complexity("def f(:") is None and complexity(None) is None and complexity("") is None


def tables(spark, files):
    df = spark.createDataFrame([("r", p, c) for p, c in files.items()], FILES).withColumn("file_id", F.monotonically_increasing_id())
    parsed = parse.parse(df).persist()
    sym = parse.symbols(parsed).withColumn("sym_ord", F.monotonically_increasing_id())
    calls = resolve.resolve_names(parse.calls(parsed).withColumn("edge_ord", F.monotonically_increasing_id()), sym, "callee_name", "callee_qualified_name", F.col("enclosing_class"), F.col("file_path"))
    bases = resolve.resolve_names(parse.bases(parsed).withColumn("edge_ord", F.monotonically_increasing_id()), sym, "base_name", "base_qualified_name", None, F.col("file_path"))
    imports = resolve.resolve_imports(parse.imports(parsed).withColumn("edge_ord", F.monotonically_increasing_id()), resolve.module_map(df, "file_id"))
    chunks = parse.chunks(parsed).withColumn("chunk_ord", F.monotonically_increasing_id())
    return retrieval.Tables(df, sym, resolve.symbol_sources(sym, df), imports, calls, bases, chunks)


def resolved(t):
    return {(r["caller_qualified_name"], r["callee_name"]): r["callee_qualified_name"] for r in t.calls.collect()}


def test_resolution_prefers_the_same_file_and_keeps_the_ambiguous(spark):
    t = tables(spark, {
        "pkg/a.py": "def helper(): pass\ndef entry():\n    helper()\n    shared()\n    only()\n    over(1)\n",
        "pkg/b.py": "def helper(): pass\ndef shared(): pass\ndef only(): pass\ndef over(a): pass\ndef over(b): pass\n",
        "pkg/c.py": "def shared(): pass\n",
        "pkg/w.py": "class Base: pass\nclass Worker(Base, metaclass=Meta):\n    def run(self):\n        self.setup()\n        self.gone()\n    def setup(self): pass\n",
        "bad.py": "def broken(:\n",
    })
    got = resolved(t)
    assert got[("pkg.a.entry", "helper")] == "pkg.a.helper"
    assert got[("pkg.a.entry", "shared")] is None and got[("pkg.a.entry", "over")] is None
    assert got[("pkg.a.entry", "only")] == "pkg.b.only"
    assert got[("pkg.w.Worker.run", "self.setup")] == "pkg.w.Worker.setup" and got[("pkg.w.Worker.run", "self.gone")] is None
    assert [(r["base_name"], r["base_qualified_name"]) for r in t.inherits.collect()] == [("Base", "pkg.w.Base")]
    assert {r["file_path"] for r in t.symbols.select("file_path").distinct().collect()} == {"pkg/a.py", "pkg/b.py", "pkg/c.py", "pkg/w.py"}


def test_imports(spark):
    t = tables(spark, {"pkg/__init__.py": "", "pkg/shared.py": "x = 1\n", "pkg/sub/__init__.py": "", "pkg/sub/a.py": "from .. import shared\nfrom ..shared import x, y\nimport os, pkg.shared\nfrom . import *\n", "src/lib/b.py": "import lib.c\n", "src/lib/c.py": "\n"})
    got = sorted((r["importer_file"], r["imported_module"], r["resolved_file"] or "") for r in t.imports.collect())
    assert got == [
        ("pkg/sub/a.py", "os", ""), ("pkg/sub/a.py", "pkg.shared", "pkg/shared.py"), ("pkg/sub/a.py", "pkg.shared", "pkg/shared.py"), ("pkg/sub/a.py", "pkg.shared", "pkg/shared.py"),
        ("pkg/sub/a.py", "pkg.shared", "pkg/shared.py"), ("pkg/sub/a.py", "pkg.sub", "pkg/sub/__init__.py"), ("src/lib/b.py", "lib.c", "src/lib/c.py"),
    ]


def test_chunks(spark):
    text = '"""Doc."""\nimport os\n\n@deco\ndef f(a):\n    """F."""\n    return a\n\nclass C(Base):\n    """K."""\n    def m(self): ...\n    class D: pass\n\nX = 1\n'
    t = tables(spark, {"m.py": text, "o.py": "".join(f"def parse(a{i}): pass\n" for i in range(3))})
    c = {r["id"]: r for r in t.chunks.collect()}
    assert c["m.py::function::f::4-7"]["content"] == '# file: m.py\n# f\n@deco\ndef f(a):\n    """F."""\n    return a'
    assert c["m.py::class_skeleton::C::9-12"]["content"] == '# file: m.py\n# C\nclass C(Base):\n    """K."""\n    def m(self):\n        ...\n\n    class D: ...'
    assert c["m.py::module::<module>"]["start_line"] == 1 and c["m.py::module::<module>"]["end_line"] == 14
    assert sum(k.startswith("o.py::function::parse") for k in c) == 3


def test_insights(spark):
    t = tables(spark, {
        "pkg/a.py": "import pkg.b\n# TODO: refactor this\ndef used(): pass\ndef main():\n    used()\n# FIXME\n",
        "pkg/b.py": "import pkg.a\ndef dead(): pass\nclass T:\n    def __init__(self): pass\n",
        "tests/x.py": "def untested(): pass\n",
        "big.py": "def big(x):\n" + "    if x: pass\n" * 12,
    })
    dead = {r["qualified_name"] for r in insights.dead_code(t.symbols, t.calls).collect()}
    assert dead == {"pkg.b.dead", "pkg.b.T", "big.big"}
    assert {(r["title"], r["description"]) for r in insights.todos(t.files).collect()} == {("TODO in pkg/a.py:2", "refactor this"), ("FIXME in pkg/a.py:6", "FIXME comment with no additional detail.")}
    cycles = insights.circular_dependencies(t.imports).collect()
    assert [r["title"] for r in cycles] == ["Circular import: pkg/a.py -> pkg/b.py"] and json.loads(cycles[0]["details"])["cycle_length"] == 2
    assert [json.loads(r["details"])["cyclomatic_complexity"] for r in insights.complexity(t.symbols, t.sources).collect()] == [13]
    assert {r["title"] for r in insights.architecture(t.files, t.symbols, t.imports).collect()} == {"Package 'pkg': 2 file(s)", "Package 'tests': 1 file(s)", "Package '(root)': 1 file(s)", "Entry point: 'pkg.a.main'"}
    found, ran, warned = insights.report({"good": lambda: insights.todos(t.files), "bad": lambda: 1 / 0})
    assert ran == ["good"] and warned[0][0] == "bad" and found.count() == 2
    assert insights.report({}) == (None, [], [])
    assert graph.nodes(t.symbols, t.imports, t.calls, t.inherits, t.files).where("node_type = 'file'").count() == 4


def test_cycles_against_enumeration(spark):
    import itertools
    import random

    rnd = random.Random(2)
    edges = {(rnd.randrange(7), rnd.randrange(7)) for _ in range(16)}
    df = spark.createDataFrame([("r", i, f"f{a}", "m", f"f{b}") for i, (a, b) in enumerate(edges)], "repo string, edge_ord long, importer_file string, imported_module string, resolved_file string")
    got = {tuple(r["cycle"]) for r in graph.import_cycles(df, 7).collect()}
    want = set()
    for n in range(2, 8):
        for p in itertools.permutations(range(7), n):
            if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in edges for i in range(n)):
                want.add(tuple(f"f{x}" for x in p))
    assert got == want


@pytest.mark.parametrize("local_links", [200_000, 0])
def test_rings_of_any_length(spark, local_links):
    """A repository whose only ring has many files is not free of cycles."""
    edges = [("five", i, (i + 1) % 5) for i in range(5)] + [("ten", i, (i + 1) % 10) for i in range(10)] + [("ten", 20, 0), ("ten", 3, 21), ("ten", 21, 22), ("ten", 22, 21), ("none", 0, 1), ("none", 1, 2), ("none", 0, 2)]
    df = spark.createDataFrame([(g, i, f"f{a}", "m", f"f{b}") for i, (g, a, b) in enumerate(edges)], "repo string, edge_ord long, importer_file string, imported_module string, resolved_file string")
    rings = {(r["repo"], r["ring"], r["file"], r["files"]) for r in graph.import_rings(df, local_links).collect()}
    assert rings == {("five", "f0", f"f{i}", 5) for i in range(5)} | {("ten", "f0", f"f{i}", 10) for i in range(10)} | {("ten", "f21", "f21", 2), ("ten", "f21", "f22", 2)}
    cycles, left = graph.bounded_cycles(df)
    assert {(r["repo"], len(r["cycle"])) for r in cycles.collect()} == {("five", 5), ("ten", 2)} and [r["repo"] for r in left.collect()] == ["ten"]
    large = [r for r in insights.circular_dependencies(df).collect() if r["repo"] == "ten" and "among 10 files" in r["title"]]
    assert len(large) == 1 and len(json.loads(large[0]["details"])["members"]) == 10


def test_long_cycles_are_reported(spark, tmp_path):
    from gnomon.plans import core_queries

    ring = lambda g, n: [(g, i, f"f{i:02}", "m", f"f{(i + 1) % n:02}") for i in range(n)]
    spark.createDataFrame(ring("five", 5) + ring("ten", 10), "repo string, edge_ord long, importer_file string, imported_module string, resolved_file string").write.parquet(f"{tmp_path}/import_edges.parquet")
    assert {tuple(r) for r in core_queries.q09_cycles(spark, str(tmp_path)).collect()} == {("five", "f00 > f01 > f02 > f03 > f04", 5), ("ten", "(longer not listed)", -1)}


def test_candidates_and_files(spark):
    t = tables(spark, {"requests/sessions.py": "class Session:\n    def request(self): pass\n    def close(self): pass\n", "a/models.py": "class M:\n    def close(self): pass\n", "b/models.py": "x = 1\n", "solo.py": "y = 1\n"})
    step = "qid long, repo string, step int, strategy string, target string, query string, direction string"
    steps = spark.createDataFrame([(k, "r", 0, "symbol_lookup", x, None, None) for k, x in enumerate(["requests.sessions.Session.request", "Session.request", "close", "nothing", None])], step)
    got = {r["qid"]: (r["found"], r["confidence"]) for r in retrieval.candidates(t.symbols, steps).collect()}
    assert got == {0: (1, 1.0), 1: (1, 1.0), 2: (2, 0.6)}
    steps = spark.createDataFrame([(k, "r", 0, "import_graph", x, None, None) for k, x in enumerate(["solo.py", "models.py", "a/models.py", "c/models.py", "a.models"])], step)
    got = {r["qid"]: r["path"] for r in retrieval.file_targets(t.files, steps).collect()}
    assert got == {0: "solo.py", 2: "a/models.py", 4: "a/models.py"}


def test_plans_and_answers(spark):
    asked = [
        json.dumps({"steps": [{"strategy": "symbol_lookup", "target": "x", "direction": "sideways"}, {"strategy": "read_minds"}], "max_results": -1, "intent": "i"}),
        json.dumps({"steps": []}), "no json", None,
    ]
    df = spark.createDataFrame([(k, "r", f"q{k}", a) for k, a in enumerate(asked)], "qid long, repo string, question string, arguments string")
    got = {r["qid"]: r for r in retrieval.parse_plans(df).collect()}
    assert [s["strategy"] for s in got[0]["steps"]] == ["symbol_lookup"] and got[0]["steps"][0]["direction"] is None and got[0]["max_results"] is None
    for k in (1, 2, 3):
        assert got[k]["intent"] == "fallback" and got[k]["steps"][0]["query"] == f"q{k}"
    ev = spark.createDataFrame([(0, 1, "symbol", "q", "f.py", 1, 2, "body", "why", 0.5), (1, 1, "symbol", None, None, None, None, "b", "w", None)], "qid long, item int, source string, qualified_name string, file_path string, start_line int, end_line int, content string, explanation string, confidence double")
    said = [json.dumps({"answer": "a", "confidence": "odd", "evidence_sufficient": True, "citations": [1, 7]}), json.dumps({"answer": "b", "evidence_sufficient": True}), json.dumps({"answer": " ", "evidence_sufficient": True, "citations": []}), None]
    parsed = answers.parse(spark.createDataFrame(list(enumerate(said)), "qid long, output string"))
    assert [(r["qid"], r["item"]) for r in answers.citations(parsed, ev).collect()] == [(0, 1)]
    got = {(r["qid"], r["severity"], r["message"][:24]) for r in answers.issues(parsed, ev).collect()}
    assert got == {(0, "error", "Citation [7] does not co"), (1, "warning", "Answer claims evidence w"), (2, "error", "Answer claims evidence w"), (2, "error", "Answer text is empty"), (3, "error", "Answer text is empty")}
    texts = {r["qid"]: r["evidence_text"] for r in answers.prompts(ev).collect()}
    assert texts[0] == "[1] source=symbol location=f.py:1-2 confidence=0.50\nreason: why\nbody" and "location=(no location) confidence=n/a" in texts[1]


def test_execute_falls_back_caps_and_warns(spark):
    t = tables(spark, {"a.py": "def slugify(x): pass\n" + "".join(f"def c{i}():\n    slugify(1)\n" for i in range(25)), "b.py": "def other(): pass\n"})
    plan = "qid long, repo string, question string, steps array<struct<strategy: string, target: string, query: string, direction: string>>, max_results int"
    rows = [
        (0, "r", "?", [("symbol_lookup", "slugify", None, None), ("call_graph", "slugify", None, "callers")], 3),
        (1, "r", "other", [("symbol_lookup", "unknown", None, None)], None),
        (2, "r", "?", [("call_graph", "slugify", None, "callers")], None),
        (3, "r", "def other", [("telepathy", "x", None, None)], None),
    ]
    plans = spark.createDataFrame(rows, plan)
    ev, warned = retrieval.execute(t, plans)
    by = {}
    for r in ev.collect():
        by.setdefault(r["qid"], []).append(r)
    assert [r["item"] for r in sorted(by[0], key=lambda r: r["item"])] == [1, 2, 3]
    assert {r["source"] for r in by[1]} == {"semantic"} and len(by[2]) == 20 and {r["source"] for r in by[3]} == {"semantic"}
    assert warned == [("telepathy", "No retriever registered for telepathy")]
    used = {r["qid"]: r["retrievers"] for r in retrieval.retrievers_used(retrieval.steps_of(plans)).collect()}
    assert used[0] == ["symbol_lookup", "call_graph"]


def test_nearest(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    got = vectors.nearest(df, df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 4, row_block=20, query_block=2).collect()
    for q in range(0, 90, 20):
        def dist(v, w=rows[q][1]):
            return 1 - sum(a * b for a, b in zip(v, w, strict=True)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w))
        want = sorted((dist(v), i) for i, v in rows[:90])[:4]
        mine = sorted((r["rank"], r["id"], r["distance"]) for r in got if r["query_id"] == q)
        assert [i for _, i in want] == [i for _, i, _ in mine] and all(abs(a - b[2]) < 1e-5 for (a, _), b in zip(want, mine, strict=True))
    assert vectors.nearest(df.limit(0), df.limit(0).withColumnRenamed("id", "query_id")).count() == 0


def test_nearest_within_groups(spark):
    """Blocks of any size give the same rows; groups do not meet, and null ones meet nothing."""
    import random

    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), [float(rnd.randrange(3)) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, repo string, embedding array<float>")
    q = df.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    one, two = ({tuple(r) for r in vectors.nearest(df, q, 5, within="repo", row_block=a, query_block=b).select("query_id", "id", "rank").collect()} for a, b in ((10**6, 10**6), (7, 3)))
    assert one == two
    group = {i: (g, v) for i, g, v in rows}
    for k in range(0, 150, 3):
        g, v = group[k]
        n = math.sqrt(sum(x * x for x in v))
        near = sorted((round(1 - sum(a * b for a, b in zip(v, w, strict=True)) / n / math.sqrt(sum(b * b for b in w)), 12), i) for i, (h, w) in group.items() if g is not None and h == g and n and any(w))
        assert [i for _, i, _ in sorted((rank, i, q_) for q_, i, rank in one if q_ == k)] == [i for _, i in near[:5]]


def test_the_embedder_is_given(spark):
    t = tables(spark, {"a.py": "def xx(): pass\ndef yyyy(): pass\n"})
    by_length = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
    t = retrieval.Tables(**{**t.__dict__, "embed": by_length})
    step = "qid long, repo string, step int, strategy string, target string, query string, direction string"
    got = retrieval.semantic_evidence(t, spark.createDataFrame([(0, "r", 0, "semantic_search", None, "x" * 40, None)], step)).collect()
    assert len(got) == 2 and all(r["confidence"] > 0.99 for r in got)
    assert one(spark, vectors.truncated(F.col("x"), 2), x="a, b-c d") == "a b" and one(spark, vectors.truncated(F.col("x"), 9), x="a, b-c d") == "a, b-c d"


def test_hints_and_templates(spark):
    from gnomon.operators import planning

    df = spark.createDataFrame([("q?", "a.b", "f.py"), ("q?", None, "f.py"), ("q?", "", None), ("q?", "a.b", "")], "q string, s string, f string")
    got = [r[0] for r in df.select(planning.in_context(F.col("q"), F.col("s"), F.col("f"))).collect()]
    assert got == ["q?\n\n(Context: the user is currently viewing symbol `a.b` and in file `f.py`.)", "q?\n\n(Context: in file `f.py`.)", "q?", "q?\n\n(Context: the user is currently viewing symbol `a.b`.)"]
    assert one(spark, planning.in_context(F.col("q")), q="q?") == "q?"
    assert [r[0] for r in df.select(answers.filled("Q: $q, ${s}! $$5", {"q": F.col("q"), "s": F.col("s")})).collect()][:2] == ["Q: q?, a.b! $5", "Q: q?, ! $5"]
    with pytest.raises(KeyError):
        answers.filled("$nope", {})
    with pytest.raises(ValueError):
        answers.filled("5 $ a", {})


def test_tracked_files(spark, tmp_path):
    import subprocess

    from gnomon.sources.scan import NothingTracked, tracked

    assert tracked(spark, str(tmp_path)) is None and tracked(spark, str(tmp_path / "no")) is None
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_text("y = 1\n")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    with pytest.raises(NothingTracked):
        tracked(spark, str(tmp_path))
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(service.IngestionFailed):
        service.ingest(spark, str(tmp_path), "r", store)
    subprocess.run(["git", "-C", str(tmp_path), "add", "a.py"], check=True)
    service.ingest(spark, str(tmp_path), "r", store)
    assert [r[0] for r in store.read("files", "r").select("path").collect()] == ["a.py"]


def test_empty_documentation_is_none(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("chunks", spark.createDataFrame([("i", "", "r"), ("j", "Doc.", "r")], "id string, docstring string, repo string"))
    assert {(r["id"], r["docstring"]) for r in store.read("chunks", "r").collect()} == {("i", None), ("j", "Doc.")}


def test_a_failing_fallback_is_a_warning(spark):
    t = tables(spark, {"a.py": "def f(): pass\n"})
    plan = "qid long, repo string, question string, steps array<struct<strategy: string, target: string, query: string, direction: string>>, max_results int"
    plans = spark.createDataFrame([(0, "r", "?", [("symbol_lookup", "f", None, None)], None), (1, "r", "?", [("symbol_lookup", "nothing", None, None)], None)], plan)

    def broken(t, steps):
        raise RuntimeError("no index")

    done = retrieval.run(t, plans, {**retrieval.RETRIEVERS, "semantic_search": broken})
    assert done.warnings == [("semantic_search", "no index")] and {r["qid"] for r in done.evidence.collect()} == {0}
    used = {r["qid"]: r["retrievers"] for r in retrieval.retrievers_used(retrieval.steps_of(plans), done.fallen_back).collect()}
    assert used == {0: ["symbol_lookup"], 1: ["symbol_lookup", "semantic_search"]}
    del_search = {k: v for k, v in retrieval.RETRIEVERS.items() if k != "semantic_search"}
    assert retrieval.run(t, plans, del_search).warnings == [("semantic_search", "No retriever registered for semantic_search fallback")]


def test_cycles_of_any_length(spark):
    ring = [("r", i, f"f{i:02}", "m", f"f{(i + 1) % 12:02}") for i in range(12)]
    df = spark.createDataFrame(ring, "repo string, edge_ord long, importer_file string, imported_module string, resolved_file string")
    assert [len(r["cycle"]) for r in graph.import_cycles(df, None).collect()] == [12] and graph.import_cycles(df).count() == 0
    assert [json.loads(r["details"])["cycle_length"] for r in insights.circular_dependencies(df, None).collect()] == [12]


def test_the_shared_folder_is_not_guessed(spark, monkeypatch):
    from types import SimpleNamespace

    from gnomon import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://h:7077"))
    with pytest.raises(RuntimeError):
        session._shared(cluster)
    cluster.sparkContext.master = "local[4]"
    assert session._shared(cluster).startswith("/tmp/")


def test_packing(spark):
    def batches(rows, most, budget):
        df = spark.createDataFrame([("g", i, n) for i, n in enumerate(rows)], "g string, i long, n long")
        out = {}
        for r in packing.pack(df, "g", "i", "n", most, budget).collect():
            out.setdefault(r["batch"], []).append(r["length"])
        return [sorted(out[k]) for k in sorted(out)]

    assert batches([50, 5, 40, 3], 2, 8192) == [[3, 5], [40, 50]]
    assert batches([1000] * 4, 32, 2000) == [[1000, 1000], [1000, 1000]]
    assert batches([9000, 1, 9500], 32, 8192) == [[1], [9000], [9500]]
    import random

    rnd = random.Random(3)
    lengths = [rnd.choice([0, 1, 5, 70, 400, 3000, 9000]) for _ in range(300)]
    want, now = [], []
    for n in sorted(lengths):
        if now and (len(now) + 1 > 32 or (len(now) + 1) * n > 8192):
            want.append(now)
            now = []
        now.append(n)
    assert batches(lengths, 32, 8192) == [*want, now]


def test_store_and_demo(spark, tmp_path):
    root = tmp_path / "demo"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "pkg" / "__init__.py").write_text("x = 1\n")
    (root / "pkg" / "a.py").write_text("from pkg import x\ndef f():\n    return g()\ndef g():\n    # TODO: later\n    return 1\n")
    (root / "node_modules" / "b.py").write_text("y = 1\n")
    (root / "bad.py").write_bytes(b"\xff\xfe")
    (root / "nul.py").write_bytes(b"a\x00b")
    (root / "empty.py").write_bytes(b"")
    assert {r["path"] for r in scan(spark, str(root), "demo").collect()} == {"pkg/__init__.py", "pkg/a.py"}
    store = Store(spark, str(tmp_path / "store"))
    assert store.repos() == [] and store.read("symbols") is None
    with pytest.raises(NotIngested):
        service.tables(store, "demo")
    service.ingest(spark, str(root), "demo", store)
    service.ingest(spark, str(root), "demo", store)  # replaced, not doubled
    t = service.tables(store, "demo")
    assert store.repos() == ["demo"] and t.symbols.count() == 2 and t.inherits.count() == 0
    found, ran, warned = service.analyze(t)
    assert not warned and len(ran) == 5 and {r["category"] for r in found.collect()} == {"dead_code", "todo", "architecture"}
    answer, cited, issues = service.ask(spark, t, "demo", "what is g?", lambda q: json.dumps({"steps": [{"strategy": "symbol_lookup", "target": "g"}]}))
    assert "Exact match for 'g'" in answer.first()["answer"] and cited.first()["qualified_name"] == "pkg.a.g" and issues.count() == 0
    tries = []

    def failing(question, evidence):
        tries.append(question)
        raise RuntimeError

    answer, cited, _ = service.ask(spark, t, "demo", "what is g?", lambda q: "{}", failing)
    assert len(tries) == 2 and answer.first()["confidence"] == "low" and cited.count() == 0
    with pytest.raises(ValueError):
        service.analyze(t, "nope")
    (root2 := tmp_path / "none").mkdir()
    (root2 / "x.txt").write_text("x")
    with pytest.raises(service.IngestionFailed):
        service.ingest(spark, str(root2), "none", store)
    meta = store.read("repo_metadata", "demo").withColumn("schema_version", F.lit(9)).cache()
    meta.count()
    store.write("repo_metadata", meta)
    with pytest.raises(SchemaMismatch):
        service.tables(store, "demo")


def test_command_line(spark, tmp_path, capsys):
    from gnomon import cli

    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("import b\n# TODO: later\ndef f():\n    return g()\ndef g():\n    return 1\n")
    (root / "b.py").write_text("import a\n")
    at = ["--store", str(tmp_path / "s")]

    def said(*args, code=0):
        assert cli.main([*at, *args]) == code
        out = capsys.readouterr()
        return out.out if not code else out.err

    assert "My Repo" in said("info", "My Repo", code=1)
    assert said("ingest", str(root), "My Repo") == "" and said("list") == "My Repo\n"
    info = said("info", "My Repo")
    assert info.startswith("My Repo\n  source: ") and "files: 2, symbols: 2" in info
    assert json.loads(said("--json", "info", "My Repo"))["symbol_count"] == 2
    report = said("analyze", "My Repo")
    assert "statistics: files 2, symbols 2, functions 2" in report and "todo: 1\n" in report and "[info] TODO in a.py:2 (a.py:2)\n    later\n" in report and "[warning] Circular import: a.py -> b.py (a.py)" in report
    assert "TODO" not in said("analyze", "My Repo", "--severity", "warning")
    rows = [json.loads(x) for x in said("--json", "analyze", "My Repo", "--category", "todo").splitlines()]
    assert [r["title"] for r in rows] == ["TODO in a.py:2"]
    answer = said("ask", "My Repo", "What does `g` do?")
    assert "[1] symbol a.g a.py:5-6" in answer and "confidence medium, evidence sufficient" in answer
    assert said("analyze", "My Repo", "--category", "nope", code=1) and said("ask", "other", "x", code=1)
    store = Store(spark, str(tmp_path / "s"))
    assert store.collections() == ["my-repo"] and store.has("My Repo") and not store.has("other")
    t = service.tables(store, "My Repo")
    found, _, _ = service.analyze(t)
    assert insights.only(found, "todo").count() == 1 and insights.only(found, "todo", "warning").count() == 0 and insights.only(found).count() == found.count()


def test_knowledge_base(spark, tmp_path):
    from gnomon.kb import KnowledgeBase, Registry

    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("import b\nclass A(b.B):\n    def m(self):\n        return helper()\ndef helper(): pass\ndef helper(): return 2\n")
    (root / "b.py").write_text("class B: pass\n")
    store = Store(spark, str(tmp_path / "s"))
    service.ingest(spark, str(root), "r", store)
    kb = Registry(store).get("r")
    assert isinstance(kb, KnowledgeBase) and kb.symbol("a.helper").first()["start_line"] == 6 and kb.symbol("nope").count() == 0
    assert kb.symbols_named("helper").count() == 2 and kb.names().count() == 4 and kb.symbols_in("b.py").first()["qualified_name"] == "b.B"
    assert kb.module("b").first()[0] == "b.py" and [r[0] for r in kb.files().collect()] == ["a.py", "b.py"]
    assert kb.callees_of("a.A.m").first()["callee_qualified_name"] is None and kb.callers_of("a.helper").count() == 0
    assert kb.imports_of("a.py").first()["resolved_file"] == "b.py" and kb.importers_of("b.py").first()["importer_file"] == "a.py"
    assert kb.bases_of("a.A").first()["base_qualified_name"] == "b.B" and kb.subclasses_of("b.B").count() == 1
    assert kb.source("a.helper").first()[0] == "def helper(): return 2" and kb.file_source("b.py").first()[0] == "class B: pass\n"
    assert kb.search("helper", 2).count() == 2 and kb.exact("A.m").first()["distance"] is None and kb.lexical("class B").count() == 1
    kb.set_summary("short")
    assert store.read("repo_metadata", "r").first()["summary"] == "short"


def test_rule_plans_and_sql_functions(spark):
    from gnomon.functions.register import register
    from gnomon.operators import planning

    asked = ["What calls `slugify`?", "What would break if I changed a.b?", "Which classes extend `B`?", "What does `src/a.py` import?", "How does retrying work?", "What does `f` do?", ""]
    df = spark.createDataFrame([(k, "r", x) for k, x in enumerate(asked)], "qid long, repo string, question string")
    got = {r["qid"]: (r["intent"], [s["strategy"] for s in r["steps"]], r["steps"][0]["target"]) for r in planning.plan(df).collect()}
    assert got[0] == ("callers", ["symbol_lookup", "call_graph"], "slugify") and got[1][0] == "impact" and got[1][2] == "a.b"
    assert got[2][0] == "subclasses" and got[3] == ("imports", ["import_graph"], "src/a.py") and got[4][1] == ["semantic_search"] and got[5][0] == "lookup" and got[6][0] == "explore"
    register(spark)
    assert spark.sql("SELECT cyclomatic_complexity('if a and b: pass') AS c").first()["c"] == 3
    rows = spark.sql("SELECT p.* FROM VALUES ('a.py', 'class C:\n  def m(self): pass'), ('b.py', 'def (') AS f(path, text), LATERAL parse_python(f.path, f.text) p").collect()
    assert {r["qualified_name"] for r in rows} == {"a.C", "a.C.m"}


def test_streaming(spark, tmp_path):
    from gnomon.streaming import ingest

    rows = [("r", "a.py", "# TODO: x\n# FIXME\n", "2024-01-01 00:00:00"), ("r", "b.py", "x = 1\n", "2024-01-01 01:00:00"), ("q", "c.py", "# todo\n", "2024-01-05 00:00:00")]
    schema = "repo string, path string, content string, ingested_at string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    s = ingest.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    got = []
    q = ingest.keep_findings(s, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert {r["title"] for r in got} == {"TODO in a.py:1", "FIXME in a.py:2", "TODO in c.py:1"}
    s = ingest.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = ingest.marker_counts(s).writeStream.format("memory").queryName("markers").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["repo"], r["files"], r["markers"]) for r in spark.table("markers").collect()} == {("r", 2, 2), ("q", 1, 1)}


@pytest.mark.parametrize("name", ["q01_scan_filter", "q05_hub_files", "q06_entry_points", "q08_dead_code", "q09_cycles", "q10_call_resolution", "q13_symbol_sources", "q14_symbol_candidates", "q16_call_evidence", "q18_hierarchy_evidence", "q19_nearest", "q20_semantic_evidence", "q23_execute", "q24_prompts", "q25_answers", "q26_batch_packing", "q27_truncate", "q39_parse_symbols", "q40_parse_chunks", "q41_parse_edges", "q45_parse_table_function", "p1_found", "p1_descendants"])
def test_queries_against_sql(spark, name):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("source_files", "symbols", "chunks", "import_edges", "call_edges", "inherits_edges", "repo_metadata", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name]).to_arrow_table().to_pylist()
    show = lambda rows: sorted(json.dumps({k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()}, sort_keys=True, default=str) for r in rows)
    assert show(r.asDict() for r in mine.collect()) == show(want)


def test_without_llm():
    """The core neither imports nor needs the llm subpackage."""
    import os
    import re

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "gnomon")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"gnomon\.llm|from gnomon import .*\bllm\b", open(os.path.join(folder, n)).read()), n
