import random

import pytest

from gnomon.llm import docpairs, origin, validity
from gnomon.llm.ecma import is_module

FILES = "file_id long, repo string, path string, language string, content string, reason string, hash string"

# ---- documentation ------------------------------------------------------------


@pytest.mark.parametrize(
    ("doc", "name", "signature", "informs"),
    [
        ("Empty input gives an empty list.", "pack_silo", "", True), ("None stands for an unlimited load.", "f", "", True), ("Renvoie le dernier élément.", "f", "", True), ("上限を超えた行だけを返す。", "f", "", True), ("Idempotent.", "f", "", True),
        ("Pack silo.", "pack_silo", "", False), ("Packs the silos", "_pack_silo", "", False), ("This function packs silo", "pack_silo", "", False), ("TODO", "f", "", False), ("TODO: describe.", "f", "", False), ("noqa: D103", "f", "", False),
        ("pylint: disable=missing-docstring", "f", "", False), ("Description of pack_silo.", "pack_silo", "", False), ("_summary_\n\nArgs:\n    mode: _description_\n\nReturns:\n    _type_", "f", "def f(mode): ...", False), (":param mode:\n:return:", "f", "def f(mode): ...", False),
        ("Args:\n    mode: Upper bound on the rank.", "f", "def f(mode): ...", True), ("", "f", "", False), (None, "f", "", False), ("   ", "f", "", False), ("pendiente", "f", "", False), ("À compléter", "f", "", False), ("-----", "f", "", False), ("????", "f", "", False), ("n/a", "f", "", False),
        ("未実装", "f", "", False), ("getUserName", "get_user_name", "", False),
    ],
)
def test_informs(doc, name, signature, informs):
    assert docpairs.informs(doc, name, signature) is informs


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ('# file: a.py\n# f\ndef f(a, b="):"):\n    """Doc."""\n    pass', ("f", "Doc.")),
        ("    @deco(x, y=[1, 2])\n    async def f[T](self, a: dict[str, int] = {}) -> list[str]:\n        # note\n\n        r'''Raw \\d\n        two'''\n", ("f", "Raw \\d\ntwo")),
        ("def f(): 'one line'", ("f", "one line")), ("def f():\n    ('not doc')\n", ("f", None)), ("def f():\n    f'no {x}'\n", ("f", None)), ("def f():\n    b'no'\n", ("f", None)), ("def f():\n    return 1", ("f", None)),
        ('def f():\r\n    """Doc."""\r\n    # next\r\n    pass', ("f", "Doc.")), ("x = 1", (None, None)), ("", (None, None)), ('def f(a=(1, "(")):\n    "a" "b"\n', ("f", "ab")),
    ],
)
def test_python_grammar(code, want):
    assert docpairs.python_doc(code) == want


def test_javascript_grammar():
    text = "/** File. */\nimport a from 'b';\n/**\n * Sorts the rows.\n * @param x rows\n */\nexport function sortRows(x) {\n  /* no */ if (x) { '/** no */'; }\n}\n/** Adds. */\nconst add = (a, b) => a + b;\nclass C {\n  /** Closes the pool. */\n  async close() {}\n}\n"
    got = docpairs.javascript_pairs(text)
    assert [(p["name"], p["doc"].split("\n")[0]) for p in got] == [("sortRows", "Sorts the rows."), ("add", "Adds."), ("close", "Closes the pool.")]
    assert all(text[p["start"] :].startswith(p["signature"]) and text[p["doc_start"] :].startswith("/**") for p in got)


def test_javascript_headers():
    """Brackets, strings and comments within parameters; functions without a name; properties, fields and accessors."""
    cases = {
        'function add(a = f(1), b = ")") {}': ("add", 'function add(a = f(1), b = ")")'), "export default function (a, [b] = [1, (2)]) {}": ("default", "export default function (a, [b] = [1, (2)])"),
        "export default async (x) => x;": ("default", "export default async (x)"), "const pick = async ({ a, b: { c } }, /* ) */ d = `}${1}`) => 1;": ("pick", "const pick = async ({ a, b: { c } }, /* ) */ d = `}${1}`)"),
        "exports.run = function (q) {};": ("run", "exports.run = function (q)"), "make: function (a) {},": ("make", "make: function (a)"), "get size() { return 1; }": ("size", "get size()"), "async *walk(a = { b: [1] }) {}": ("walk", "async *walk(a = { b: [1] })"),
        "static #hide(a) {}": ("#hide", "static #hide(a)"), "field = (a, b) => 1;": ("field", "field = (a, b)"), "export const single = x => x;": ("single", "export const single = x"), "// note\nfunction f() {}": ("f", "function f()"),
    }
    for code, want in cases.items():
        (p,) = docpairs.javascript_pairs(f"const x = 1;\n/** Tells more. */\n{code}\n")
        assert (p["name"], p["signature"], p["doc"]) == (*want, "Tells more."), code
    for code in ("if (x) { y(); }", "count = 3;", "foo(1, 2);", "import a from 'b';", "return (a) => a;", "class C {}"):
        assert docpairs.javascript_pairs(f"/** Tells more. */\n{code}\n") == [], code


def test_javascript_table(spark):
    rows = [(1, "r", "a.js", "javascript", "/** Sorts by weight, heaviest first. */\nexport function sortRows(rows = f(1)) {}\n/** sort rows */\nfunction sortRows(rows) {}\n", "", ""), (1, "r", "a.js", "javascript", "/** Sorts by weight, heaviest first. */\nexport function sortRows(rows = f(1)) {}\n/** sort rows */\nfunction sortRows(rows) {}\n", "", ""), (2, "r", "b.mjs", None, None, "", ""), (3, "r", "c.py", "python", "/** x */ function f() {}", "", "")]
    df = spark.createDataFrame(rows, FILES)
    assert [tuple(r) for r in docpairs.javascript(df).collect()] == [(1, "sortRows", "export function sortRows(rows = f(1))", "Sorts by weight, heaviest first.", 40, 0)]
    assert docpairs.javascript(df.limit(0)).count() == 0


def test_pairs_table(spark):
    sym = "sym_ord long, repo string, qualified_name string, kind string, file_path string, start_line int, end_line int, signature string, docstring string, content string"
    chk = "chunk_ord long, repo string, id string, file_path string, chunk_type string, qualified_name string, start_line int, end_line int, content string, docstring string, signature string"
    code = lambda n, doc: f"# file: a.py\n# {n}\ndef {n}():\n    {doc}\n    pass"
    s = [(1, "r", "a.f", "function", "a.py", 1, 3, "def f(): ...", "Closes the pool.", "x"), (2, "r", "a.g", "function", "a.py", 5, 7, "def g(): ...", None, "x"), (3, "r", "a.h", "function", "a.py", 9, 11, "def h(): ...", " ", "x"), (4, "r", "a.k", "function", "a.py", 13, 15, "def k(): ...", "TODO", "x"),
         (5, "r", "a.C", "class", "a.py", 17, 19, "class C:", "A class.", "x"), (6, None, "a.z", "function", "a.py", 1, 3, "", "Closes it.", "x"), (7, "q", "a.f", "function", "a.py", 1, 3, "def f(): ...", "Closes the pool.", "x"), (8, "r", "a.n", "function", "a.py", None, 3, "", "Closes it.", "x"), (9, "r", "a.m", "function", "a.py", 21, 23, "def m(): ...", "Weighs the load.", "x"), (10, "r", "a.o", "function", "a.py", 25, 27, "def o(): ...", "o", "x")]
    c = [(1, "r", "i", "a.py", "function", "f", 1, 3, code("f", "pass"), None, "x"), (2, "r", "i", "a.py", "function", "g", 5, 7, code("g", "pass"), "Opens the pool.", "x"), (3, "r", "i", "a.py", "function", "h", 9, 11, code("h", '"""Drains the pool."""'), "", "x"), (4, "r", "i", "a.py", "function", "k", 13, 15, code("k", '"""TODO"""'), None, "x"),
         (5, "r", "i", "a.py", "class_skeleton", "C", 17, 19, "class C: ...", "A class.", "x"), (9, "r", "i", "a.py", "function", "w", 1, 3, None, None, "x"), (10, "r", "i", "a.py", "function", "m", 21, 23, code("m", '"""TODO"""'), None, "x"), (11, "r", "i", "a.py", "function", "o", 25, 27, code("o", '"""Waits for the lock."""'), "TODO", "x")]
    sd, cd = spark.createDataFrame(s * 2, sym), spark.createDataFrame(c * 2, chk)
    got = sorted((r["sym_ord"], r["chunk_ord"], r["documentation"]) for r in docpairs.pairs(sd, cd).collect())
    assert got == [(1, 1, "Closes the pool."), (1, 9, "Closes the pool."), (2, 2, "Opens the pool."), (3, 3, "Drains the pool."), (9, 10, "Weighs the load."), (10, 11, "Waits for the lock.")]
    assert docpairs.pairs(sd.limit(0), cd).count() == 0
    js = spark.createDataFrame([(1, "r", "a.js", "js", "/** Sorts. rows by age */\nfunction f(x) {}\n", "", ""), (2, "r", "b.js", "js", None, "", ""), (3, "r", None, "js", "x", "", "")], FILES)
    assert [r["name"] for r in docpairs.javascript(js).collect()] == ["f"]


# ---- validity ------------------------------------------------------------------

GOOD_JS = [
    "", "import a from 'b'; import * as c from \"d\"; import {x as y, default as z} from './q.js'; export {y as default}; export * as ns from 'k'", "export default class extends A { static #p = 1; #q(){ return #p in this } get x(){return 1} set x(v){} static { this.y=1 } async *gen(){ yield* z; await q } }",
    "const f = async (a, {b=1, ...c}, [d,,e]=[], ...r) => { await a }; const h = () => ({a:1}); let q = async x => x;", "a = b\n++c", "x = a / b / c; y = /re[/]g/.test(s) ? 1 : 2; if (x) /foo/.exec(y)", "`a${b+`c${d}`}e`", "for (const [a,b] of Object.entries(c)) ;",
    "var x = {a, b, c(){}, get d(){return 1}, async e(){}, *f(){}, [h]: 1, 'i': 2, 3: 4, ...j}; ({a, b:[c]} = d); [a, b] = [b, a]", "x?.y?.[z]?.(w) ?? v; a ||= b; 2 ** -1; (-2) ** 2", "switch(a){case 1: b(); break; default: c()} try{}catch{}finally{} do x++; while(x<5) y()",
    "await import('x'); import.meta.url", "0x1F; 0b11; 0o17; 1_000n; .5e-3; 1.; 1.e5", "(function(m){return m})([\n/* 0 */function(req){var a=req(1)},\nfunction(){}]);", "#!/usr/bin/env node\nx()", "let async; async = 1; let get = 1, set = 2, from = 3", "export const a = 1, b = () => {}; export async function q() { return await 1 }",
]
BAD_JS = ["x = ", "function (){}", "const a;", "let let = 1", "if (a) {", "}", "a b", "'abc", "`abc", "/* abc", "import a from b", "with (a) b", "010", "class A { constructor( }", "return 1", "export x", "x = <div/>", "let a: number = 1", "<<<<<<< HEAD", "def f(x):", "() + 1", "for (;;", "1 = 2", "f() = 1", "const kept = ite)", "throw\nx", "{\"a\": 1, \"b\": 2}", "‘x’"]


@pytest.mark.parametrize("text", GOOD_JS)
def test_modules(text):
    assert is_module(text)


@pytest.mark.parametrize("text", BAD_JS)
def test_no_modules(text):
    assert not is_module(text)


def test_truncated_modules_fail():
    text = "import { a } from './b.js';\n\nexport function f(items, n) {\n  const kept = items.filter((x) => x.n > 3);\n  if (!kept.length) { return 5; }\n  return kept.map((x) => `${x.n} k`);\n}\n"
    assert is_module(text)
    inside = range(text.index("f(items"), len(text) - 2)
    assert not any(is_module(text[:k]) for k in inside)


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("python", "x = 1\n", "ok"), ("python", "", "ok"), ("python", "\ufeffx = 1\n", "ok"), ("python", "raise ValueError, 'bad'\n", "corrupt"), ("python", "import { a } from './b.js';\nexport const x = 1;\n", "javascript"), ("python", "x = 1\n<<<<<<< HEAD\n", "corrupt"), ("python", "a\x00b", "corrupt"),
        ("python", "return 1\n", "ok"), ("json", '{"a": [1, 2.5e3, null]}', "ok"), ("json", "", "corrupt"), ("json", '{"a": NaN}', "not ok"), ("json", "{'name': 'x', 'b': 1}", "python"), ("json", '{"a": 1,}', "corrupt-ish"), ("json", '// c\n{"a": 1}', "corrupt-ish"), ("json", "9" * 6000, "ok"),
        ("toml", 'a = 1\n[b]\nc = "d"\n', "ok"), ("toml", "", "ok"), ("toml", "a = 1\na = 2\n", "not ok"), ("toml", "a : 1\n[b]\n", "not ok"), ("toml", "[a\n", "corrupt"), ("javascript", "", "ok"), ("javascript", "def f(x):\n    return x\n", "python"), ("json", "[" * 200_000, "corrupt"),
    ],
)
def test_verdicts(language, text, want):
    got = validity.verdict(language, text)
    assert (got == want) if want in ("ok", "corrupt", "python", "javascript") else got != "ok"


@pytest.mark.parametrize(("language", "path", "want"), [("PYTHON", "x.js", "python"), (" js ", "x", "javascript"), (None, "a/b.toml", "toml"), ("", "a.json", "json"), (None, "Makefile", None), ("cobol", "x.py", None), (None, None, None)])
def test_languages(language, path, want):
    assert validity.language_of(language, path) == want


def test_judged_table(spark):
    rows = [(1, "r", "a.py", "python", "x = (", "", ""), (1, "r", "a.py", "python", "x = (", "", ""), (2, "r", "b.py", None, "x = 1", "", ""), (3, None, "c.json", "json", "", "", ""), (4, "r", "d.py", "python", None, "", ""), (None, "r", "e.py", "py", "x =", "", ""), (5, "r", None, None, "x", "", "")]
    df = spark.createDataFrame(rows, FILES)
    got = sorted(((r["file_id"], r["verdict"]) for r in validity.judged(df).collect()), key=str)
    assert got == sorted([(1, "corrupt"), (2, "ok"), (3, "corrupt"), (None, "corrupt")], key=str)
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid"]) for r in validity.rates(validity.judged(df)).collect()}
    assert rates == {("r", "python"): (3, 2), (None, "json"): (1, 1)}
    assert validity.judged(df.limit(0)).count() == 0


# ---- origin --------------------------------------------------------------------


def hand(seed, n=12):
    rnd = random.Random(seed)
    return "import os\n\n" + "\n".join(f"def f{rnd.randrange(10**6)}(a, b):\n    total = a * {rnd.randrange(99)} + b\n    return total\n" for _ in range(n))


def test_origin(spark):
    lib = {"__init__.py": "# lib\nfrom .a import x\n", "a.py": hand("a"), "sub/b.py": hand("b")}
    rows, k = [], 0
    want = {}

    def add(repo, path, text, reason):
        nonlocal k
        k += 1
        rows.append((k, repo, path, "python", text, "x", "y"))
        want[k] = reason

    for n, repo in enumerate(("r1", "r2", "r3")):
        for p, t in lib.items():
            add(repo, f"app{n}/support/lib/{p}", (f"# copy {n}\n" if n else "") + t.replace("\n", "\r\n" if n == 1 else "\n"), "vendored")
        add(repo, f"app{n}/__init__.py", "# package marker\n", "")
        add(repo, f"app{n}/main.py", hand(repo), "")
    add("r1", "gen/x.py", "# Code generated by tool v1.2; changes will be lost.\n" + hand("g"), "generated")
    add("r1", "gen/y.py", "# Copyright\n#\n\n\"\"\"\n    Client\n\n    Autogenerated with tool 1.0.\n\"\"\"\nx = 1\n", "generated")
    add("r1", "gen/z.py", "# Automatisch erzeugt von tool - nicht bearbeiten\nx = 1\n", "generated")
    add("r1", "tools/emit.py", 'BANNER = "# Generated by {tool}. DO NOT EDIT."\n' + hand("e"), "")
    add("r1", "tools/doc.py", '"""Reads files that were generated by the compiler."""\n' + hand("d"), "")
    add("r1", "static/a.min.js", "!function(e,t){" + "".join(f"function p{i}(a,n){{return j?2:t({i},[2,9])}};" for i in range(60)) + "}(this,0)", "minified")
    add("r1", "data/rows.py", "ROWS = [\n" + "".join("    " + ", ".join(str(i * 7.13)[:7] for i in range(j, j + 9)) + ",\n" for j in range(60)) + "]\n", "data")
    add("r1", "data/small.py", "LEVELS = {\n" + "".join(f'    "l{i}": {i},\n' for i in range(8)) + "}\n" + hand("s"), "")
    add("r1", "package-lock.json", '{\n "lockVersion": 2,\n' + "".join(f' "p{i}": {{"resolved": "https://x.example/{i}",\n "integrity": "sha512-{i}"}},\n' for i in range(9)) + "}", "lock")
    add("r1", "conf.json", '{"name": "x", "version": "1"}', "")
    add("r1", "vendor/tool/c.py", hand("v"), "")  # a folder's name is no evidence
    add("r1", "support/tool/d.py", "# vendored from kiln 1.2\n" + hand("w"), "vendored")
    add("r1", None, hand("n"), "")
    add("r1", "null.py", None, "")
    add("r1", "blank.py", "  \n", "")
    df = spark.createDataFrame(rows + rows[:5], FILES)
    got = {r["file_id"]: r["reason"] for r in origin.classify(df).collect()}
    assert got == want
    assert origin.classify(df.limit(0)).count() == 0


def test_where_copies_come_from(spark):
    """Forks are no evidence, and the project that code comes from keeps its own."""
    rows = [("kiln", f"kiln/m{i}.py", hand(f"k{i}")) for i in range(4)]  # the project itself
    rows += [(r, f"lib/kiln/m{i}.py", hand(f"k{i}")) for r in ("a", "b") for i in range(4)]  # two that copied it
    rows += [(r, f"own{r}/x{i}.py", hand(f"{r}{i}")) for r in ("a", "b") for i in range(3)]
    rows += [(r, f"app/y{i}.py", hand(f"y{i}")) for r in ("fork1", "fork2", "fork3") for i in range(5)] + [("fork2", "app/z.py", hand("z"))]
    rows += [(None, "deep/lib/kiln/m0.py", hand("k0")), (None, "n.py", hand("n"))]
    df = spark.createDataFrame([(k, r, p, "python", t, "", "") for k, (r, p, t) in enumerate(rows)], FILES)
    got = {(r["repo"], r["path"]): (r["reason"], r["basis"]) for r in origin.classify(df).collect()}
    assert {k for k, v in got.items() if v[0]} == {(r, f"lib/kiln/m{i}.py") for r in ("a", "b") for i in range(4)} | {(None, "deep/lib/kiln/m0.py")}
    assert got["a", "lib/kiln/m1.py"] == ("vendored", "subtree") and got[None, "deep/lib/kiln/m0.py"] == ("vendored", "file")


def test_merkle_finds_equal_trees(spark):
    rows = [("r1", "a/x/p.py", "h1", 300), ("r1", "a/x/q/r.py", "h2", 5), ("r2", "z/x/p.py", "h1", 300), ("r2", "z/x/q/r.py", "h2", 5), ("r3", "x/p.py", "h1", 300), ("r3", "x/q/other.py", "h2", 5), ("r3", "top.py", "h3", 9)]
    df = spark.createDataFrame(rows, "repo string, path string, hash string, code int")
    h = {(r["repo"], r["dir"]): (r["hash"], r["files"], r["code"]) for r in origin.merkle(df).collect()}
    assert h[("r1", "a/x")] == h[("r2", "z/x")] and h[("r1", "a/x/q")][0] == h[("r2", "z/x/q")][0]
    assert h[("r3", "x")][0] != h[("r1", "a/x")][0] and h[("r1", "a/x")][1:] == (2, 305)
    assert origin.merkle(df.where("path = 'top.py'")).count() == 0


def test_origin_of_long_files():
    """Neither long lines nor long headers nor late lock keys are left out."""
    blob = "aB3dE5gH7jK+" * 2500
    shape = lambda path, text: origin.layout(path, text, text.split("\n"))
    for line in (f'"{blob}"', f"[{', '.join(f'0x{k:x}z' for k in range(9000))}]", "a;" * 20_000, "{" + '"k": "v", ' * 4000 + "}"):
        assert shape("a.py", f"DATA = (\n    {line}\n)\n") == "data", line[:40]
    licence = "# a line of a licence\n" * 60
    assert origin.marked((licence + "# @generated by a tool\nx = 1\n").split("\n"))[0] and origin.marked((licence + "# vendored from kiln\nx = 1\n").split("\n"))[1]
    assert not origin.marked((licence + "x = 1\n# @generated by a tool\n").split("\n"))[0]
    entry = '"integrity": "sha512-x",\n'
    assert shape("a.json", "{\n" + entry * 2 + '"dependencies": "' + "x " * 2000 + '",\n"lockfileVersion": 3\n}\n') == "lock"
