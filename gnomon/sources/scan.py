"""Repositories on a file system to the source_files table."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions import text as T
from gnomon.session import spread

MAX_BYTES = 500_000


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, absolute_path, size) of all files below `root`, a path or URI every executor can read.

    Spark's own file sources pass over names that begin with an underscore, and with them every
    __init__.py; so the names are listed here and the files are read in the tasks.
    """
    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    rows = [(x.path[len(base) + 1 :], x.path, x.size) for x in found if x.type == fs.FileType.File]
    return spark.createDataFrame(rows, "path string, absolute_path string, size long")


class NothingTracked(Exception):
    """A git repository whose index lists no file: a broken index or an unfinished checkout, not an empty project."""


def tracked(spark: SparkSession, root: str) -> DataFrame | None:
    """(path) of the files that git tracks below `root`, a local path; None where it is no repository or git is missing."""
    try:
        out = subprocess.run(["git", "ls-files", "-z"], cwd=root, capture_output=True, text=True, check=True).stdout
    except (subprocess.CalledProcessError, FileNotFoundError, NotADirectoryError):
        return None
    names = [(x,) for x in out.split("\0") if x]
    if not names:
        raise NothingTracked(root)
    return spark.createDataFrame(names, "path string")


def scan(spark: SparkSession, root: str, repo: str, extension: str = ".py", most: int = MAX_BYTES, tracked: DataFrame | None = None) -> DataFrame:
    """(repo, path, absolute_path, content, line_count) of the readable text files below `root`.

    Left out: ignored directories, empty files, files over `most` bytes, text that is no UTF-8 or
    holds NUL.  `tracked` (path) keeps the listed files only.
    """
    scheme = root if "://" in root else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = fs.FileSystem.from_uri(scheme)[0] if scheme else fs.LocalFileSystem()
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64].copy()
                part["data"] = [system.open_input_stream(p).read() for p in part["absolute_path"]]
                yield part[["path", "absolute_path", "data"]]

    files = listing(spark, root).where(F.col("path").endswith(extension) & (F.col("size") >= 1) & (F.col("size") <= most) & ~T.ignored(F.col("path")))
    if tracked is not None:
        files = files.join(tracked.select("path").distinct(), "path", "left_semi")
    files = spread(files.select("path", "absolute_path")).mapInPandas(read, "path string, absolute_path string, data binary")
    files = files.where(F.is_valid_utf8("data")).withColumn("content", F.col("data").cast("string")).where(~F.contains("content", F.lit("\x00")))
    return files.select(F.lit(repo).alias("repo"), "path", "absolute_path", "content", T.line_count(F.col("content")).alias("line_count"))
