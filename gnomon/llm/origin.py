"""Files that nobody wrote by hand here: generated, minified, bundled, vendored or bulk data.

One pass over the contents reads each file's header and layout and hashes its code without
comments and blank space.  Only those small rows go on: Merkle hashes of the directories are
built bottom-up, a level a round, from the hashes and names of their children (an exclusive-or of
child hashes, so a directory of any size is aggregated before the shuffle).  A file is a subtree
of one node, a directory one of several.  A subtree whose hash occurs in unrelated repositories is
a copy and everything in it vendored.  No folder name counts by itself; but where nine in ten of the
files in the folders of one name are such copies, in three unrelated repositories or more, that
name is a package's and the rest of the files in these folders are vendored as well (another
version, or the only copy here).

Two repositories are related (mirrors, forks) where half of the files of both have the same path
and code; what only related ones share is their own.  Where one repository's path is the end of
the paths of all the other copies (`pkg/a.py` of `lib/pkg/a.py`), it is where the code comes from,
and its own files are not copies.

Defined results: null, empty and blank contents are hand-written (never found); a null path has
no directory; a null repository is one of its own; repeated rows count once; a null id keeps its
row; a subtree with less than `least_code` characters of code is no evidence by itself (one-line
modules and error pages are alike by accident), but is part of the larger ones it lies in; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnomon.session import cut, spread

#: Phrases with which tools mark their output, in comments and at the start of docstring lines.
MARKED = re.compile(
    r"(?i)auto-?\s?generated|\bgenerated (?:by|from|with|using|automatically|code)\b|@generated|do not (?:edit|modify)\b|auto-?created|machine[- ](?:made|generated)|automatisch (?:erzeugt|generiert)|nicht bearbeiten"
    r"|généré automatiquement|generado (?:por|autom)|no editar|changes will be lost|edit the template instead|regenerate with|to refresh\b.*lock|lock` to refresh|自動生成|自动生成|сгенерирован"
)
MARKED_DOC = re.compile(r"(?i)^\s*(?:this (?:file|module|code) (?:is|was) )?(?:auto-?\s?generated|generated (?:by|from|with)|do not edit|machine[- ]made|auto-?created)\b")
#: Notices that copied files carry.
COPIED = re.compile(
    r"(?i)\bimported from \S+ v?\d|local copy,? keep in sync|\bupstream: ?https?:|spdx-filecopyrighttext: the (?!.*this repository)\S+ (?:maintainers|authors|developers)|\bthe \S+ project contributors|"
    r"vendored from|copied (?:verbatim )?from \S+ v?\d|do not patch here|redistribution (?:and use|permitted) (?:in|under)"
)
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|<!--|;)")
_DOC = re.compile(r"\s*[rRuU]?(\"\"\"|''')")
_TABLES = re.compile(r"(?m)^_(?:tabversion|lr_method|action_rows|goto_rows|action_items)\b|AddSerialized(?:File)?\(|_serialized_start\s*=")
_CLIENT = re.compile(r"_with_http_info\(")
_REVISION = re.compile(r"(?m)^class (?:Revision|Migration)\b[^\n]*:\n(?:[^\n]*\n){0,6}\s+operations = \[")
_DATA_LINE = re.compile(r"""^\s*(?:[-+\d.,\s\[\](){}xXeE]+|["'][A-Za-z0-9+/=]{40,}["'],?|(?:["'][^"']{0,40}["']\s*:\s*)?[\[({][^()\[\]{}]*\d[^()\[\]{}]*[\])}],?|\{?(?:["'][^"']{0,40}["']: ?(?:-?[\d.]+|["'][^"']{0,60}["']|true|false|null|None),? ?)+\}?,?|[\w.\-]*(?:[,;\t|][^,;\t|(){}=]*){2,})\s*,?\s*$""")
#: The same for long lines, stripped, without ways back: its time is linear in the length.
_LONG_DATA_LINE = re.compile(r"""(?:[-+\d.,\s\[\](){}xXeE]++|["'][A-Za-z0-9+/=]{40,}+["'],?|(?:["'][^"']{0,40}["']\s*:\s*)?[\[({](?=[^()\[\]{}\d]*+\d)[^()\[\]{}]*+[\])}],?|\{?(?:["'][^"']{0,40}["']: ?(?:-?[\d.]++|["'][^"']{0,60}["']|true|false|null|None),? ?)++\}?,?|[\w.\-]*+(?:[,;\t|][^,;\t|(){}=]*+){2,}+)\s*,?$""")
_BUNDLE = re.compile(r"\(function\s*\(modules\)|__webpack_require__|webpackBootstrap|webpackJsonp|parcelRequire|System\.register\(|!function\((?:e|t|n|r)?,?|eval\(function\(p,a,c,k,e,[dr]\)|exec\((?:zlib|marshal|base64|bz2)")
_LOCK_JSON = re.compile(r'"(?:lockVersion|lockfileVersion|packageManagerLock|_resolved)"')
_LOCK_LINE = re.compile(r'(?m)^\s*"?(?:integrity|checksum|resolved|sha256|content-hash)"?\s*[:=]')


def marked(lines: list[str]) -> tuple[bool, bool]:
    """(made by a tool, copied) by the comments and the docstring before the first code line."""
    made = copied = False
    quote = ""
    for line in lines:
        if quote:
            if MARKED_DOC.match(line):
                made = True
            if quote in line:
                quote = ""
            continue
        if not line.strip():
            continue
        m = _DOC.match(line)
        if m:
            rest = line[m.end() :]
            if MARKED_DOC.match(rest):
                made = True
            if m[1] not in rest:
                quote = m[1]
            continue
        if not _COMMENT.match(line):
            break
        if MARKED.search(line):
            made = True
        if COPIED.search(line):
            copied = True
        if line.lstrip().startswith("/*") and "*/" in line and line.split("*/", 1)[1].strip():
            break
    return made, copied


def layout(path: str, text: str, lines: list[str]) -> str:
    """What the file's shape tells: generated, minified, data, lock or nothing."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    size = len(text)
    if ext in ("json", "toml", "lock", "yaml", "yml"):
        locked = len(_LOCK_LINE.findall(text))
        if locked >= 5 or _LOCK_JSON.search(text) and locked >= 2:
            return "lock"
        return ""
    if _TABLES.search(text) or len(_CLIENT.findall(text)) >= 2 and "# noqa: E501" in text:
        return "generated"
    if _REVISION.search(text):
        return "generated"
    long = sum(len(x) for x in lines if len(x) > 250)
    blank = text.count(" ") + text.count("\n") + text.count("\t")
    code = [x for x in lines if x.strip()]
    if ext in ("js", "mjs", "cjs", "jsx", "ts"):
        signs = sum(text.count(c) for c in "(){};,=")
        if size >= 300 and _BUNDLE.search(text):
            return "minified"
        if size >= 500 and long > 0.5 * size and blank < 0.12 * size and signs > 0.12 * size:
            digits = sum(map(str.isdigit, text))
            return "data" if digits > 0.4 * size else "minified"
        if size >= 500 and blank < 0.06 * size and len(code) and size / len(code) > 80:
            return "minified"
    elif size >= 300 and _BUNDLE.search(text):
        return "minified"
    if size >= 1200:
        data = [x for x in code if (_DATA_LINE.match(x) if len(x) <= 20_000 else _LONG_DATA_LINE.match(x.strip()))]
        weight = sum(map(len, data))
        if weight > 0.6 * size and (len(data) >= 30 or weight >= 1500):
            return "data"
        if long > 0.7 * size:
            digits = sum(map(str.isdigit, text))
            if digits > 0.35 * size:
                return "data"
    if ext in ("py", "pyw") and size >= 300 and len(code) and blank < 0.1 * size:
        if size / len(code) > 60 and text.count(";") > len(code) and sum(len(w) == 1 for w in re.findall(r"[A-Za-z_]\w*", text)) > 0.25 * max(1, len(re.findall(r"[A-Za-z_]\w*", text))):
            return "minified"
    return ""


def _bare(lines: list[str]) -> str:
    return "\n".join(s for x in lines if (s := x.strip()) and not _COMMENT.match(s))


def facts(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, reason, notice, code, hash) per file: a small row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, repo, path, text in zip(pdf["file_id"], pdf["repo"], pdf["path"], pdf["content"], strict=True):
                if not text or not text.strip():
                    rows.append((key, repo, path, "", False, 0, ""))
                    continue
                lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                made, copied = marked(lines)
                bare = _bare(lines)
                rows.append((key, repo, path, "generated" if made else layout(path or "", text, lines), copied, len(bare), hashlib.md5(bare.encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(rows, columns=["file_id", "repo", "path", "reason", "notice", "code", "hash"])

    src = files.select(F.col("file_id").cast("string").alias("file_id"), "repo", "path", "content")
    return spread(src).mapInPandas(run, "file_id string, repo string, path string, reason string, notice boolean, code long, hash string")


def merkle(leaves: DataFrame, deepest: int | None = None) -> DataFrame:
    """(repo, dir, hash, code, files): a hash for every directory, built bottom-up.

    `leaves` has repo, path, hash and code, a row for each (repo, path).
    """
    parts = F.split("path", "/")
    nodes = leaves.where(F.col("path").isNotNull()).select(
        "repo", F.size(parts).alias("depth"), F.array_join(F.expr("slice(split(path, '/'), 1, size(split(path, '/')) - 1)"), "/").alias("dir"),
        F.element_at(parts, -1).alias("name"), "hash", F.col("code").cast("long").alias("code"), F.lit(1).cast("long").alias("files"),
    )
    nodes = cut(nodes)
    if deepest is None:
        deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below: DataFrame | None = None
    out = []
    for depth in range(deepest, 1, -1):
        level = nodes.where(F.col("depth") == depth).drop("depth")
        if below is not None:
            level = level.unionByName(below)
        child = F.xxhash64("name", "hash"), F.xxhash64("hash", "name", F.lit(1))
        dirs = level.groupBy("repo", "dir").agg(
            F.concat_ws("-", F.bit_xor(child[0]), F.bit_xor(child[1])).alias("hash"), F.sum("code").alias("code"), F.sum("files").alias("files")
        )
        dirs = cut(dirs)
        out.append(dirs)
        # the directory becomes a child of the one above it
        below = dirs.select(
            "repo", F.regexp_replace("dir", r"/?[^/]*$", "").alias("dir"), F.regexp_extract("dir", r"([^/]*)$", 1).alias("name"), "hash", "code", "files"
        )
    if not out:
        return leaves.select("repo", F.lit("").alias("dir"), "hash", F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("files")).limit(0)
    return reduce(DataFrame.unionByName, out)


def families(rows: DataFrame) -> DataFrame:
    """(repo, family) of the repositories that are related to one of a lesser name: half of the files of both agree in path and code.

    Each file is counted against the first repository that has it, so a file that many have gives
    one row for each of them and no pairs among them.
    """
    own = rows.where(F.col("path").isNotNull() & (F.col("code") > 0)).select(_repo().alias("r"), "path", "hash").distinct()
    size = own.groupBy("r").agg(F.count("*").alias("n"))
    first = own.groupBy("path", "hash").agg(F.min("r").alias("first"), F.max("r").alias("last")).where("first <> last").drop("last")
    common = own.join(first, ["path", "hash"]).where("r <> first").groupBy("r", "first").agg(F.count("*").alias("both"))
    common = common.join(size, "r").join(size.select(F.col("r").alias("first"), F.col("n").alias("m")), "first").where(F.col("both") * 2 >= F.greatest("n", "m"))
    near = common.groupBy("r").agg(F.min("first").alias("family"))
    # a repository's first relative may itself be related to a lesser one
    up = near.select(F.col("r").alias("family"), F.col("family").alias("top"))
    return near.join(up, "family", "left").select(F.col("r"), F.coalesce("top", "family").alias("family"))


def _repo() -> Column:
    """A null repository is one of its own, unlike any name."""
    return F.coalesce(F.concat(F.lit("r"), "repo"), F.lit("n"))


def copies(nodes: DataFrame, related: DataFrame) -> DataFrame:
    """(r, path, hash) of the subtrees (r, path, hash) that unrelated repositories share, without those in the repository they come from."""
    n = nodes.join(related, "r", "left").withColumn("family", F.coalesce("family", "r"))
    # the place within the project: a leading src/ is the layout of a repository
    n = n.withColumn("at", F.regexp_replace("path", "^src/", ""))
    groups = n.groupBy("hash").agg(F.min("family").alias("a"), F.max("family").alias("b"), F.min(F.struct(F.length("at").alias("n"), "at", "family")).alias("x")).where("a <> b")
    n = n.join(groups.select("hash", F.col("x.at").alias("least"), F.col("x.family").alias("owner")), "hash")
    inner = F.endswith("at", F.concat(F.lit("/"), "least"))
    whole = n.groupBy("hash").agg(F.bool_and(inner | (F.col("at").eqNullSafe(F.col("least")) & (F.col("family") == F.col("owner")))).alias("clear"))
    n = n.join(whole, "hash")
    source = F.coalesce("clear", F.lit(False)) & (F.col("family") == F.col("owner")) & F.col("at").eqNullSafe(F.col("least"))
    return n.where(~source).select("r", "path", "hash")


def classify(files: DataFrame, least_code: int = 200) -> DataFrame:
    """(file_id, repo, path, reason, basis): reason is '' for hand-written files, basis what shows it: header, layout, subtree, file, notice or package."""
    rows = cut(facts(files).dropDuplicates(["file_id", "repo", "path", "hash"]))
    related = cut(families(rows))
    dirs = merkle(rows.where("code > 0").dropDuplicates(["repo", "path"])).where("files > 1")
    leaves = rows.where(F.col("code") >= least_code).select(_repo().alias("r"), "path", F.concat(F.lit("f:"), "hash").alias("hash")).distinct()
    trees = dirs.where(F.col("code") >= least_code).select(_repo().alias("r"), F.col("dir").alias("path"), F.concat(F.lit("d:"), "hash").alias("hash"))
    found = cut(copies(leaves.unionByName(trees), related))
    place_key = F.coalesce(F.concat(F.lit("p"), "path"), F.lit("n"))
    alone = found.where(F.col("hash").startswith("f:")).select("r", place_key.alias("at"), F.expr("substring(hash, 3)").alias("hash"), F.lit(True).alias("alone")).distinct()
    tree = found.where(F.col("hash").startswith("d:")).select("r", F.col("path").alias("dir")).distinct()
    place = rows.withColumns({"r": _repo(), "at": place_key}).join(alone, ["r", "at", "hash"], "left")
    ups = place.where("code > 0 and path is not null").select("r", "path", F.explode(F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), k -> array_join(slice(split(path, '/'), 1, k), '/'))")).alias("dir"))
    inside = ups.join(tree, ["r", "dir"], "left_semi").select("r", "path").distinct().withColumn("inside", F.lit(True))
    place = place.join(inside, ["r", "path"], "left").withColumn("copied", F.coalesce("alone", "inside", F.col("notice") & (F.col("reason") == "")))
    place = cut(place.withColumn("package", _package()))
    named = place.join(related, "r", "left").where(F.col("package").isNotNull() & (F.col("code") > 0)).groupBy("package")
    named = named.agg(F.avg(F.col("copied").cast("int")).alias("share"), F.approx_count_distinct(F.when(F.col("copied"), F.coalesce("family", "r"))).alias("n"))
    named = named.where((F.col("share") >= 0.9) & (F.col("n") >= 3)).select("package", F.lit(True).alias("known"))
    place = place.join(named, "package", "left")
    by_name = F.coalesce("known", F.lit(False)) & (F.col("code") > 0)
    reason = F.when(F.col("reason") != "", F.col("reason")).when(F.col("copied") | by_name, "vendored").otherwise("")
    basis = (
        F.when(F.col("reason") == "generated", "header").when(F.col("reason") != "", "layout").when(F.col("inside"), "subtree").when(F.col("alone"), "file").when(F.col("notice"), "notice").when(by_name, "package").otherwise("")
    )
    return place.select(F.col("file_id").cast("long").alias("file_id"), "repo", "path", reason.alias("reason"), basis.alias("basis")).distinct()


def _package() -> Column:
    """The name of the folder a file lies in, where that folder is inside another one (a leading src/ does not count)."""
    parts = F.split(F.regexp_replace("path", "^src/", ""), "/")
    return F.when(F.size(parts) >= 3, F.lower(F.element_at(parts, -2)))
