"""Functions paired with their documentation.

A packrat grammar per language reads a function's header and the documentation that belongs to
it, with source offsets: for Python the string that opens the body, for JavaScript the `/** */`
comment before a function.  Symbols and chunks of the same repository, file and lines are joined;
the documentation is the one the grammar finds in the chunk's code, and only where the code has
lost it, or has one that tells nothing, the chunk's own or the symbol's (`found_in` tells which).  Texts that say no more than
name and parameters are dropped; what the grammar reads is judged by the header it reads with it,
in the task that holds the code, so that no text is shuffled to be judged.

Defined results: a null or blank docstring counts as absent; null contents have no documentation
of their own; rows with a null repository, file or line join nothing; repeated rows count once;
several symbols or chunks with the same lines give every pairing (the header's name decides where
it can); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import ast
import inspect
import re
import warnings
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gnomon.llm.peg import Choice, Expr, Many, Not, Rule, Seq, Term, maybe

# ---- Python ----------------------------------------------------------------

_blank = Term(r"[ \t\f]*")
_string = Term(r"(?i:[rbuf]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')", re.S)
_comment = Term(r"#[^\n]*")
_gap = Many(Choice(Term(r"[ \t\f\r\n]+"), _comment, Term(r"\\\r?\n")))
_nested = Rule()
_nested.define(
    Choice(
        Seq(Term(r"\("), Many(_nested), Term(r"\)")),
        Seq(Term(r"\["), Many(_nested), Term(r"\]")),
        Seq(Term(r"\{"), Many(_nested), Term(r"\}")),
        _string,
        _comment,
        Term(r"[^()\[\]{}\"'#]+"),
    )
)
_plain = Choice(_string, Seq(Term(r"[(\[{]"), Many(_nested), Term(r"[)\]}]")), Term(r"[^()\[\]{}\"'#:\n\\]+"), Term(r"\\\r?\n"))
_decorator = Seq(_blank, Term(r"@"), Many(Choice(_plain, Term(r":"))), maybe(_comment), Term(r"\r?\n"))
_head_line = Seq(_blank, maybe(_comment), Term(r"\r?\n"))
_name = Term(r"[^\W\d]\w*")


def _literal(text: str, start: int, end: int, value: Any) -> tuple[str, int, int] | None:
    """The documentation string and its offsets; formatted and byte strings are none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            got = ast.literal_eval("(" + text[start:end].strip() + "\n)")
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return (inspect.cleandoc(got), start, end) if isinstance(got, str) else None


def _function(text: str, start: int, end: int, value: list) -> dict[str, Any]:
    _, _, intro, name, _, _, _, _, _, colon, doc = value
    return {"name": text[name[0] : name[1]], "start": intro[0], "end": end, "head": text[intro[0] : colon[1][1]], "doc": doc[0] if doc else None}


_docstring = Rule(_literal).define(Many(Seq(_string, _gap), 1))
_body = Seq(_gap, _docstring)
_def = Rule(_function).define(
    Seq(
        Many(Choice(_decorator, _head_line)), _blank, Term(r"(?:async[ \t]+)?def[ \t]+"), _name, _blank, maybe(Seq(Term(r"\["), Many(_nested), Term(r"\]"))), _blank,
        Seq(Term(r"\("), Many(_nested), Term(r"\)")), maybe(Seq(_blank, Term(r"->"), Many(_plain))), Seq(_blank, Term(r":")), maybe(Rule(lambda t, a, b, v: v[1]).define(_body)),
    )
)


_MARK = re.compile(r"(?m)^[ \t]*@.*$")


def python_pair(code: str) -> tuple[str | None, str | None, str]:
    """(function name, documentation, header with decorators) of a chunk that holds one function."""
    try:
        got = _def.parse(code)
    except RecursionError:  # brackets nested beyond any hand-written header
        return None, None, ""
    if got is None:
        return None, None, ""
    found = got[1]
    head = "\n".join([*_MARK.findall(code[: found["start"]]), found["head"]])
    return found["name"], found["doc"][0] if found["doc"] else None, head


def python_doc(code: str) -> tuple[str | None, str | None]:
    """(function name, documentation) of a chunk that holds one function."""
    return python_pair(code)[:2]


# ---- JavaScript --------------------------------------------------------------

_js_space = Term(r"\s+")
_js_doc = Term(r"/\*\*(?:[^*]|\*(?!/))*\*/")
_js_comment = Choice(Term(r"/\*(?:[^*]|\*(?!/))*\*/"), Term(r"//[^\n]*"))
_js_string = Choice(Term(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S), Term(r"`(?:[^`\\]|\\.)*`", re.S))
_js_name = Term(r"#?[A-Za-z_$][\w$]*")
_js_skip = Many(Choice(_js_space, _js_comment))
_js_nested = Rule()
_js_nested.define(
    Choice(
        Seq(Term(r"\("), Many(_js_nested), Term(r"\)")),
        Seq(Term(r"\["), Many(_js_nested), Term(r"\]")),
        Seq(Term(r"\{"), Many(_js_nested), Term(r"\}")),
        _js_comment,
        _js_string,
        Term(r"[^()\[\]{}\"'`/]+"),
        Term(r"/"),
    )
)
_js_params = Seq(Term(r"\("), Many(_js_nested), Term(r"\)"))
_js_export = maybe(Term(r"export\s+(?:default\s+)?"))
_js_async = maybe(Term(r"async\b\s*"))
_js_function = Seq(_js_async, Term(r"function\b\s*\*?\s*"), maybe(_js_name), _js_skip, _js_params)
_js_arrow = Seq(_js_async, Choice(_js_params, _js_name), _js_skip, Term(r"=>"))
_js_value = Choice(_js_function, _js_arrow)
_js_head = Choice(
    Seq(_js_export, Not(Term(r"(?:const|let|var|return)\b")), _js_value),
    Seq(_js_export, Term(r"(?:const|let|var)\s+"), _js_name, _js_skip, Term(r"=(?!=)\s*"), _js_value),
    Seq(Many(Term(r"[A-Za-z_$][\w$]*\s*\.\s*")), _js_name, _js_skip, Term(r"[=:](?!=)\s*"), _js_value),  # a property or a field
    Seq(Many(Term(r"(?:(?:static|async|get|set)\b\s+|\*\s*)")), Choice(_js_name, _js_string, Seq(Term(r"\["), Many(_js_nested), Term(r"\]"))), _js_skip, _js_params, _js_skip, Not(Not(Term(r"\{")))),
)


def _js_pair(text: str, start: int, end: int, value: list) -> tuple[int, int, int, int]:
    (d0, d1), _, _, _ = value
    head = _JS_GAP.match(text, d1).end()
    return d0, d1, head, end


_JS_GAP = re.compile(r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_js_documented = Rule(_js_pair).define(Seq(_js_doc, _js_skip, Not(Term(r"(?:if|for|while|switch|catch|with|return|new|typeof|await|throw)\b")), _js_head))
_js_other: Expr = Choice(_js_comment, _js_string, Term(r"[^/\"'`]+?(?=/\*\*)|[^/\"'`]+"), Term(r"[/\"'`]"))
_js_file = Rule().define(Many(Choice(_js_documented, _js_other)))


_JS_CALLED = re.compile(r"(?:export\s+)?(?:default\s+)?(?:(?:async|static|get|set|const|let|var)\s+)*(?:function\b\s*)?\*?\s*(?P<name>(?:[A-Za-z_$][\w$]*\s*\.\s*)*#?[A-Za-z_$][\w$]*)\s*(?=[=:(]|/\*)(?!=>)")


def javascript_pairs(text: str) -> list[dict[str, Any]]:
    """The documented functions of a file: name, signature, documentation and the offsets of both; a function without a name is called default."""
    out = []
    try:
        got = _js_file.parse(text)
    except RecursionError:  # brackets nested beyond any hand-written header
        return []
    for v in got[1] if got else ():
        if isinstance(v, tuple) and len(v) == 4:
            d0, d1, h0, h1 = v
            lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in text[d0 + 3 : d1 - 2].split("\n")]
            head = text[h0:h1].strip()
            named = _JS_CALLED.match(head)
            name = re.split(r"\s*\.\s*", named["name"])[-1] if named else ""
            out.append({"name": name if name and name not in ("function", "async", "default") else "default", "signature": head.removesuffix("=>").strip(), "doc": "\n".join(lines).strip(), "start": h0, "doc_start": d0})
    return out


# ---- Does a description inform? --------------------------------------------

#: Words of templates, placeholders and of no content.
EMPTY = frozenset(
    """a an the of to for in on is are be it its this that these and or with from by as at do does did done has have will function functions method methods helper helpers routine procedure class
    implementation implements description describe described desc docstring docstrings doc docs document documents documented documentation undocumented summary brief details detail args arg arguments argument parameters parameter params param
    return returns returned rtype type types raises raise yields yield note notes example examples todo tbd fixme xxx none na null missing stub placeholder here there go goes add write fill me in later yet not no nothing
    coming soon pending later now wip work progress empty blank text insert your put something some what my value values object self cls int str float bool list dict tuple set optional any default defaults
    string integer number boolean callable kwargs keyword input output inputs outputs result results given see above below please
    pendiente descripcion documentar por hacer beschreibung folgt fehlt noch a compléter completer à remplir description manquante ainda""".split()
)
_LINTER = re.compile(r"(?im)(?:#\s*)?\b(?:noqa|pylint|flake8|mypy|nosec|pragma|type:\s*ignore|ruff|isort|fmt|eslint)\b(?:\s*[:=-]\s*[\w\-, =]*)?")
_FIELD = re.compile(r"^\s*(?::(?:param|parameter|arg|type|raises?|keyword)\s+[^:]*:|@(?:param|arg|type|returns?|throws)\b\s*(?:\{[^}]*\})?|:(?:returns?|rtype):)", re.M)
_CJK_EMPTY = re.compile(r"待补充|待完善|未実装|未记录|説明なし|説明は後で|後で書く|暂无|無し|なし")
_WIDE = re.compile(r"[぀-ヿ一-鿿가-힯]")


def _split(name: str) -> list[str]:
    return [w.lower() for part in re.split(r"[\W_]+", name) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\WA-Z\d_]+|\d+", part)]


def _stems(words: list[str]) -> set[str]:
    out = set(words)
    for w in words:
        root = w[:-1] if w.endswith("e") else w
        out |= {w + "s", w + "es", root + "ing", root + "ed", w + "d", w + w[-1:] + "ing", w + w[-1:] + "ed"}
        if w.endswith("y"):
            out |= {w[:-1] + "ies", w[:-1] + "ied"}
        if w.endswith("s"):
            out.add(w[:-1])
    return out


def informs(doc: str | None, name: str, signature: str | None = None) -> bool:
    """Whether a documentation text tells more than the name and the parameters do."""
    if not doc or not doc.strip():
        return False
    text = _CJK_EMPTY.sub(" ", _LINTER.sub(" ", doc))
    if _WIDE.search(text):
        return True
    known = set(_split(name)) | {name.lower()}
    if signature:
        known |= set(_split(signature))
    known = _stems(sorted(known))
    text = _FIELD.sub(lambda m: " " + " ".join(re.findall(r":(?:param|type|raises?|arg)\s+([^:]*):", m[0])) + " ", text)
    text = re.sub(r"(?i)\btodo\b[:\s]+(?:describe|document|write docs|add docs|fill in|docs?)\b", " ", text)
    for w in _split(text):
        if len(w) < 2 or w.isdigit() or w in EMPTY or w in known:
            continue
        return True
    return False


# ---- over tables --------------------------------------------------------------


def _chunk_docs(chunks: DataFrame) -> DataFrame:
    """Function and method chunks with the name and the documentation that the grammar finds, and whether that informs (null where there is none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for code in pdf["content"]:
                name, doc, head = python_pair(code) if code else (None, None, "")
                doc = doc if doc and doc.strip() else None
                rows.append((name, doc, None if doc is None else informs(doc, name or "", head)))
            out = pdf.drop(columns=["content"])
            out["own_name"], out["code_doc"], out["told"] = (pd.Series([r[k] for r in rows], dtype=object, index=out.index) for k in range(3))
            yield out

    src = chunks.where(F.col("chunk_type").isin("function", "method")).select(
        F.col("chunk_ord").cast("string").alias("chunk_ord"), "repo", "file_path", F.col("start_line").cast("string").alias("a"), F.col("end_line").cast("string").alias("b"),
        F.when(F.length(F.trim("docstring")) > 0, F.col("docstring")).alias("doc"), "content",
    )
    fields = "chunk_ord string, repo string, file_path string, a string, b string, doc string, own_name string, code_doc string, told boolean"
    found = src.mapInPandas(run, fields)
    # the column's text is of use only where the code's tells nothing
    return found.select("chunk_ord", "repo", "file_path", "a", "b", "own_name", "code_doc", "told", F.when(~F.coalesce("told", F.lit(False)), F.col("doc")).alias("chunk_doc"))


@F.pandas_udf(BooleanType())
def informs_udf(doc: pd.Series, name: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([informs(d, n or "", s) for d, n, s in zip(doc, name, signature, strict=True)], dtype=bool)


def pairs(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(sym_ord, chunk_ord, repo, qualified_name, signature, documentation, found_in), informative ones only."""
    s = symbols.where(F.col("kind").isin("function", "method")).select(
        "sym_ord", "repo", "file_path", F.col("start_line").cast("string").alias("a"), F.col("end_line").cast("string").alias("b"), "qualified_name", "signature",
        F.when(F.length(F.trim("docstring")) > 0, F.col("docstring")).alias("sym_doc"),
    )
    short = F.substring_index("qualified_name", ".", -1)
    joined = s.join(_chunk_docs(chunks), ["repo", "file_path", "a", "b"]).where(F.col("own_name").isNull() | F.col("qualified_name").isNull() | (F.col("own_name") == short))
    told = F.coalesce("told", F.lit(False))
    open_ = lambda x: F.when(~told, x)
    judged = lambda doc: informs_udf(open_(F.col(doc)), open_(short), open_(F.col("signature")))
    out = joined.where(told | F.col("chunk_doc").isNotNull() | F.col("sym_doc").isNotNull()).withColumns({"by_chunk": judged("chunk_doc"), "by_symbol": judged("sym_doc")})
    out = out.where(told | F.col("by_chunk") | F.col("by_symbol"))
    source = lambda code, chunk, symbol: F.when(told, code).when(F.col("by_chunk"), chunk).otherwise(symbol)
    out = out.withColumns({"documentation": source(F.col("code_doc"), F.col("chunk_doc"), F.col("sym_doc")), "found_in": source(F.lit("code"), F.lit("chunk"), F.lit("symbol"))})
    return out.select("sym_ord", F.col("chunk_ord").cast("long").alias("chunk_ord"), "repo", "qualified_name", "signature", "documentation", "found_in").dropDuplicates(["sym_ord", "chunk_ord"])


def javascript(files: DataFrame) -> DataFrame:
    """(file_id, name, signature, documentation, start, doc_start) of JavaScript files' informative pairs; offsets count from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "name", "signature", "documentation", "start", "doc_start"]
        for pdf in batches:
            rows = [
                (key, p["name"], p["signature"], p["doc"], p["start"], p["doc_start"])
                for key, text in zip(pdf["file_id"], pdf["content"], strict=True)
                for p in javascript_pairs(text)
                if informs(p["doc"], p["name"], p["signature"])
            ]
            yield pd.DataFrame(rows, columns=columns)

    src = files.where(F.col("path").rlike(r"(?i)\.[cm]?jsx?$") & F.col("content").isNotNull()).select(F.col("file_id").cast("string").alias("file_id"), "content")
    out = src.mapInPandas(run, "file_id string, name string, signature string, documentation string, start int, doc_start int")
    return out.withColumn("file_id", F.col("file_id").cast("long")).distinct()
