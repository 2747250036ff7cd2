"""Text, path and naming functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The line ends that Python's str.splitlines() knows.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Directories that a scan leaves out.
IGNORED_DIRS = (".git", "__pycache__", ".venv", "venv", "node_modules", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache")


def lines(text: Column) -> Column:
    """The lines as str.splitlines() gives them: no empty last one, none at all for empty text."""
    parts = F.split(text, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last, counted from 1, joined by line feeds."""
    return F.array_join(F.slice(lines(text), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def with_header(path: Column, name: Column, body: Column) -> Column:
    return F.concat(F.lit("# file: "), path, F.lit("\n# "), name, F.lit("\n"), body)


def chunk_id(path: Column, kind: Column, name: Column, first: Column, last: Column) -> Column:
    """path::kind::name::first-last; a module chunk has no span."""
    span = F.concat(first.cast("string"), F.lit("-"), last.cast("string"))
    return F.when(kind == "module", F.concat(path, F.lit("::module::<module>"))).otherwise(F.concat_ws("::", path, kind, name, span))


def short_name(name: Column) -> Column:
    """The last dotted segment."""
    return F.substring_index(name, ".", -1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def package_dir(path: Column) -> Column:
    """The directory, or (root)."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("(root)"))


def module_name(path: Column) -> Column:
    """src/a/b.py -> a.b; a/__init__.py -> a; a root __init__.py has the empty name."""
    bare = F.regexp_replace(path, r"\.py$", "")
    bare = F.when(bare == "src", F.lit("")).otherwise(F.regexp_replace(bare, r"^src/", ""))
    bare = F.regexp_replace(bare, r"(^|/)__init__$", "")
    return F.translate(bare, "/", ".")


def package_of(path: Column) -> Column:
    """The package a file lies in; an __init__.py is its own package."""
    name = module_name(path)
    return F.when(path.rlike(r"(^|/)__init__\.py$"), name).otherwise(F.regexp_replace(name, r"\.?[^.]*$", ""))


def absolute_module(package: Column, module: Column, level: Column) -> Column:
    """A relative import's module; a level deeper than the package keeps a prefix of it, as slicing from the end does."""
    parts = F.split(package, r"\.")
    up = level - 1
    count = F.size(parts)
    kept = F.when(up <= 0, count).when(up <= count, count - up).otherwise(F.greatest(2 * count - up, F.lit(0)))
    base = F.array_join(F.slice(parts, F.lit(1), kept), ".")
    joined = F.concat_ws(".", F.when(base != "", base), F.when(module != "", module))
    return F.when(level == 0, module).otherwise(joined)


def finding_id(category: Column, *parts: Column) -> Column:
    """Twelve hexadecimal digits of the SHA-1 of category|part|...; empty parts are left out."""
    kept = [F.when(p.cast("string") != "", p.cast("string")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", category, *kept)), 1, 12)


def slug(name: Column) -> Column:
    """A collection name: lower case, other signs as -, 3 to 63 characters."""
    s = F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "-")
    s = F.substring(F.regexp_replace(s, "^[-_]+|[-_]+$", ""), 1, 63)
    return F.when(F.length(s) < 3, F.concat(F.lit("repo-"), s)).otherwise(s)


def is_git_url(source: Column) -> Column:
    return source.rlike(r"^(https?://|git@)|\.git$")


def repo_of_url(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1), r"\.git$", "")


def location(path: Column, first: Column, last: Column) -> Column:
    """(no location), path, or path:first-last."""
    span = F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))
    return F.when(path.isNull(), F.lit("(no location)")).when(first.isNull() | last.isNull(), path).otherwise(span)


def source_or(source: Column, fallback: Column) -> Column:
    return F.coalesce(F.when(source != "", source), fallback)


def is_test_or_entry(name: Column, path: Column) -> Column:
    """Names and places that are called from outside: entry points, dunder names, tests."""
    short = short_name(name)
    named = short.isin("main", "__init__", "__main__") | short.rlike("^__.+__$") | short.startswith("test_")
    placed = F.exists(F.split(path, "/"), lambda p: p.isin("test", "tests") | p.startswith("test_"))
    return named | placed


def ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED_DIRS]))


def row_json(df: DataFrame) -> Column:
    """A row as a JSON object."""
    return F.to_json(F.struct(*df.columns))


def known_or(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def semantic_confidence(distance: Column) -> Column:
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), 1 - distance))
