"""Python files to symbols, edges and chunks: one pass over each file, exploded into tables.

`parse(files)` reads each file once and keeps what it found in arrays of one row per file; the
table functions explode those.  Files that do not parse give a row without contents.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.session import spread

SYMBOL = "qualified_name string, kind string, start_line int, end_line int, signature string, docstring string, decorators array<string>"
IMPORT = "module string, name string, level int, star boolean"
CALL = "caller_qualified_name string, callee_name string, enclosing_class string, line int"
BASE = "class_qualified_name string, base_name string"
CHUNK = "chunk_type string, qualified_name string, start_line int, end_line int, body string, docstring string"


def _ddl(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in fields.split(", ")))


PARSED = (
    f"repo string, path string, parsed boolean, symbols array<struct<{_ddl(SYMBOL)}>>, imports array<struct<{_ddl(IMPORT)}>>, "
    f"calls array<struct<{_ddl(CALL)}>>, bases array<struct<{_ddl(BASE)}>>, chunks array<struct<{_ddl(CHUNK)}>>"
)

_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)
_NAMED = (*_DEF, ast.ClassDef)
_TAB = "    "
#: What of a path without its extension is no part of the module's name (as in functions.text.module_name).
_LAYOUT, _PACKAGE = re.compile(r"^src(?:/|$)"), re.compile(r"(?:^|/)__init__$")


def dotted(path: str) -> str:
    """The module name of a path."""
    return _PACKAGE.sub("", _LAYOUT.sub("", path.removesuffix(".py"))).replace("/", ".")


def header(node: ast.AST) -> str:
    """A definition with ... for a body."""
    shown = type(node)(**{f: getattr(node, f) for f in node._fields if f != "body"}, body=[ast.Expr(ast.Constant(...))])
    return ast.unparse(ast.fix_missing_locations(ast.copy_location(shown, node)))


def span(node: ast.AST) -> tuple[int, int]:
    """First and last line, decorators included."""
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))]), node.end_lineno


def outline(node: ast.ClassDef) -> str:
    """A class without its bodies: the title, the documentation, and a paragraph for each member."""
    doc = ast.get_docstring(node)
    members = [f"class {x.name}: ..." if isinstance(x, ast.ClassDef) else header(x) for x in node.body if isinstance(x, _NAMED)]
    paragraphs = "\n\n".join(members) or "..."
    inner = [f'"""{doc}"""'] * bool(doc)
    bases = ", ".join(map(ast.unparse, node.bases))
    lines = [f"class {node.name}{f'({bases})' * bool(bases)}:"]
    lines += [_TAB + x for x in inner]  # the lines of a text within are left as they are
    lines += [_TAB + x if x or not members else x for x in paragraphs.split("\n")]
    return "\n".join(lines)


def definitions(body: list[ast.stmt], owner: str = "") -> Iterator[tuple[ast.AST, str, str]]:
    """(node, local name, owner's local name) of the functions and classes of a module and of its classes, in order."""
    for node in body:
        if isinstance(node, _NAMED):
            local = f"{owner}.{node.name}" if owner else node.name
            yield node, local, owner
            if isinstance(node, ast.ClassDef):
                yield from definitions(node.body, local)


class FileReader:
    """What one file holds."""

    def __init__(self, path: str, text: str) -> None:
        tree, self.lines, module = ast.parse(text), text.splitlines(), dotted(path)
        self.within = f"{module}." if module else ""
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.bases: list[dict] = []
        self.chunks: list[dict] = []
        for node, local, owner in definitions(tree.body):
            if isinstance(node, ast.ClassDef):
                self.add(node, local, "class", "class_skeleton", next(x for x in header(node).splitlines() if x.startswith("class ")), outline(node))
                self.bases += [{"class_qualified_name": self.within + local, "base_name": ast.unparse(b)} for b in node.bases]
            else:
                kind = "method" if owner else "function"
                self.add(node, local, kind, kind, header(node), self.text(node))
                self.calls += [
                    {"caller_qualified_name": self.within + local, "callee_name": ast.unparse(x.func), "enclosing_class": self.within + owner if owner else None, "line": x.lineno}
                    for stmt in node.body for x in ast.walk(stmt) if isinstance(x, ast.Call)
                ]
        rest = [x for x in tree.body if not isinstance(x, _NAMED)]
        if rest:
            self.chunk("module", "<module>", (span(rest[0])[0], rest[-1].end_lineno), "\n\n".join(map(self.text, rest)), ast.get_docstring(tree))
        self.imports = [x for node in ast.walk(tree) for x in imported(node)]

    def text(self, node: ast.AST) -> str:
        first, last = span(node)
        return "\n".join(self.lines[first - 1 : last])

    def chunk(self, kind: str, name: str, at: tuple[int, int], body: str, doc: str | None) -> None:
        self.chunks.append({"chunk_type": kind, "qualified_name": name, "start_line": at[0], "end_line": at[1], "body": body, "docstring": doc})

    def add(self, node: ast.AST, local: str, kind: str, chunk_type: str, signature: str, body: str) -> None:
        """A symbol and its chunk."""
        doc, at = ast.get_docstring(node), span(node)
        self.symbols.append({
            "qualified_name": self.within + local, "kind": kind, "start_line": at[0], "end_line": at[1], "signature": signature,
            "docstring": doc, "decorators": [ast.unparse(d) for d in node.decorator_list],
        })
        self.chunk(chunk_type, local, at, body, doc)


def imported(node: ast.AST) -> Iterator[dict]:
    """What an import statement names; a star stands alone."""
    if isinstance(node, ast.Import):
        for a in node.names:
            yield {"module": a.name, "name": None, "level": 0, "star": False}
    elif isinstance(node, ast.ImportFrom):
        star = any(a.name == "*" for a in node.names)
        for name in (None,) if star else (a.name for a in node.names):
            yield {"module": node.module or "", "name": name, "level": node.level, "star": star}


def parse(files: DataFrame) -> DataFrame:
    """A row per file (repo, path, parsed, symbols, imports, calls, bases, chunks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["repo", "path", "parsed", "symbols", "imports", "calls", "bases", "chunks"]
        for pdf in batches:
            rows = []
            for repo, path, text in zip(pdf["repo"], pdf["path"], pdf["content"], strict=True):
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        r = FileReader(path, text)
                    rows.append((repo, path, True, r.symbols, r.imports, r.calls, r.bases, r.chunks))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows.append((repo, path, False, [], [], [], [], []))
            yield pd.DataFrame(rows, columns=columns)

    src = files.where(F.col("content").isNotNull() & F.col("path").isNotNull()).select("repo", "path", "content")
    return spread(src).mapInPandas(run, PARSED)


def _exploded(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.select("repo", "path", F.posexplode(column).alias("ord", "x")).select("repo", "path", "ord", "x.*")


def symbols(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "symbols").withColumnRenamed("path", "file_path")


def calls(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "calls").withColumnRenamed("path", "file_path")


def bases(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "bases").withColumnRenamed("path", "file_path")


def imports(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "imports").withColumnRenamed("path", "importer_file")


def chunks(parsed: DataFrame) -> DataFrame:
    """Chunks with ids and headers as they are stored."""
    from gnomon.functions import text as T

    c = _exploded(parsed, "chunks").withColumnRenamed("path", "file_path")
    return c.select(
        "repo", T.chunk_id(F.col("file_path"), F.col("chunk_type"), F.col("qualified_name"), F.col("start_line"), F.col("end_line")).alias("id"), "file_path", "chunk_type",
        "qualified_name", "start_line", "end_line", T.with_header(F.col("file_path"), F.col("qualified_name"), F.col("body")).alias("content"), "docstring", "ord",
    )
