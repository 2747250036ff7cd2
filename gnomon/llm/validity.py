"""Source files that are not valid in their own language.

Every file is read by all grammars (Python 3.13 by the interpreter's own parser, an ECMAScript
module by `gnomon.llm.ecma`, JSON strictly, TOML 1.0), in the order of a ranking by its tokens.
Where its own language rejects it, the first other one that accepts it names the language it is
really in (a wrong extension); a file that none accepts is corrupt.  A grammar meets text in
another language with an error near the beginning, so the foreign readings cost little.

Defined results: null content is not judged; empty content is valid Python, JavaScript and TOML
and no JSON; a null or blank language means the one of the extension; a file whose language and
extension are both unknown is not judged; repeated rows count once; a null repository or id stays
null; a text that a grammar's reader gives up on (nested beyond the limits it states, or out of
memory) gets the verdict 'not judged' and is never found; JSON is read at any depth; an empty
table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import ast
import gc
import json
import re
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.ecma import is_module
from gnomon.session import spread

#: Spellings of the languages and their extensions.
SPELLINGS = {"python": "python", "py": "python", "python3": "python", "javascript": "javascript", "js": "javascript", "node": "javascript", "ecmascript": "javascript", "mjs": "javascript", "json": "json", "toml": "toml"}
EXTENSIONS = {"py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "json": "json", "toml": "toml"}
DEFINITE_ERRORS = (SyntaxError, ValueError, OverflowError)
#: What the interpreter's parser says where it gives up, not where the text is wrong.
LIMITS = ("too many nested parentheses", "too many levels of indentation", "too many statically nested blocks", "f-string: expressions nested too deeply", "too complex")
NOT_JUDGED = "not judged"

#: Tokens that speak for a language.
SIGNS = {
    "python": ("def ", "import ", "self", ":\n", "None", "elif ", "return "),
    "javascript": ("function", "=>", "const ", ";\n", "export ", "{\n", "===", "return "),
    "json": ('":', '{"', "}\n", "],", '",\n'),
    "toml": (" = ", "\n[", "]\n"),
}


def language_of(language: str | None, path: str | None) -> str | None:
    if language and language.strip():
        return SPELLINGS.get(language.strip().lower())
    name = (path or "").rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def _constant(_: str) -> None:
    raise ValueError("not JSON")


def _python(text: str) -> None:
    compile(text.removeprefix("﻿"), "x", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)


def _json(text: str) -> None:
    try:
        json.loads(text, parse_constant=_constant, parse_int=str, parse_float=str)
    except RecursionError:
        _deep_json(text)


_JSON_TOKEN = re.compile(r"""[ \t\n\r]*+(?:(?P<value>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true\b|false\b|null\b)|(?P<sign>[\[\]{},:]))""")


def _deep_json(text: str) -> None:
    """The same grammar read with a stack of its own, for texts nested beyond the library's depth."""
    stack: list[str] = []
    state, at, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            raise ValueError("not JSON")
        at, sign = m.end(), m["sign"]
        if sign in ("[", "{") and state in ("value", "first"):
            stack.append(sign)
            state = "first" if sign == "[" else "first key"
        elif sign is None and state in ("key", "first key"):
            if not m["value"].startswith('"'):
                raise ValueError("not JSON")
            state = "colon"
        elif sign is None and state in ("value", "first"):
            state = "after"
        elif sign == ":" and state == "colon":
            state = "value"
        elif sign == "," and state == "after" and stack:
            state = "value" if stack[-1] == "[" else "key"
        elif sign == "]" and state in ("after", "first") and stack and stack[-1] == "[" or sign == "}" and state in ("after", "first key") and stack and stack[-1] == "{":
            stack.pop()
            state = "after"
        else:
            raise ValueError("not JSON")
    if stack or state != "after":
        raise ValueError("not JSON")


_BARE_TOML = re.compile(r"\s*(?:(?:#[^\n]*|\[{1,2}[\w.\-\"' \t]+\]{1,2}[ \t]*(?:#[^\n]*)?)?\r?\n\s*)*+\s*")


def _toml(text: str) -> None:
    if "=" not in text and not _BARE_TOML.fullmatch(text + "\n"):
        raise ValueError("neither values nor tables alone")  # long runs of dotted words would take the reader long
    tomllib.loads(text.removeprefix("﻿"), parse_float=str)


def _javascript(text: str) -> None:
    if not is_module(text):
        raise ValueError("not a module")


GRAMMARS = {"python": _python, "javascript": _javascript, "json": _json, "toml": _toml}


def valid(language: str, text: str) -> bool | None:
    """Whether a grammar accepts a text; None where its reader gives up."""
    try:
        GRAMMARS[language](text)
    except (RecursionError, MemoryError):
        return None
    except DEFINITE_ERRORS as e:
        return None if any(x in str(e) for x in LIMITS) else False
    return True


def ranked(text: str) -> list[str]:
    """The languages by how many of a text's tokens speak for them."""
    return sorted(GRAMMARS, key=lambda k: (-sum(map(text.count, SIGNS[k])), k))


def accepted(text: str) -> list[str]:
    """The languages whose grammars accept a text, likeliest first."""
    return [k for k, ok in _read(text) if ok]


def _read(text: str) -> list[tuple[str, bool | None]]:
    return [(k, valid(k, text)) for k in ranked(text)]


def verdict(language: str, text: str) -> str:
    """'ok', the language the text is really in, 'corrupt' or 'not judged'."""
    return _verdict(language, text, _read(text))


def _verdict(language: str, text: str, read: list[tuple[str, bool | None]]) -> str:
    own = dict(read)[language]
    if own is not False:
        return "ok" if own else NOT_JUDGED
    takers = [k for k, ok in read if ok]
    # a bare word or an empty text passes as another language by accident
    return takers[0] if takers and len(text.strip()) > 8 else "corrupt"


def judged(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, verdict, accepted) of every file whose language is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # syntax trees are freed by counting; looking for cycles among them costs a third of the time
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                for pdf in batches:
                    gc.collect()
                    rows = []
                    for key, repo, path, language, text in zip(pdf["file_id"], pdf["repo"], pdf["path"], pdf["language"], pdf["content"], strict=True):
                        known = language_of(language, path)
                        if known is not None and text is not None:
                            read = _read(text)
                            rows.append((key, repo, known, _verdict(known, text, read), [k for k, ok in read if ok]))
                    yield pd.DataFrame(rows, columns=["file_id", "repo", "language", "verdict", "accepted"])
        finally:
            gc.enable()

    src = files.where(F.col("content").isNotNull()).select(F.col("file_id").cast("string").alias("file_id"), "repo", "path", "language", "content")
    out = spread(src).mapInPandas(run, "file_id string, repo string, language string, verdict string, accepted array<string>")
    return out.withColumn("file_id", F.col("file_id").cast("long")).distinct()


def rates(judged_files: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid ones, wrong extensions, those not judged, the share of invalid ones among the judged."""
    open_ = F.col("verdict") == NOT_JUDGED
    bad = (~F.col("verdict").isin("ok", NOT_JUDGED)).cast("long")
    wrong = (~F.col("verdict").isin("ok", "corrupt", NOT_JUDGED)).cast("long")
    rate = F.round(F.avg(F.when(~open_, bad.cast("double"))), 6)
    return judged_files.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum(bad).alias("invalid"), F.sum(wrong).alias("wrong_extension"), F.sum(open_.cast("long")).alias("not_judged"), rate.alias("rate"))
