"""Cyclomatic complexity of a piece of Python."""

from __future__ import annotations

import ast
import textwrap
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: The nodes that add a path.
DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension)


def complexity(source: str | None) -> int | None:
    """1 + decisions + (operands - 1) of each boolean operation; None where the text does not parse."""
    if not source:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(textwrap.dedent(source))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    nodes = list(ast.walk(tree))
    return 1 + sum(isinstance(n, DECISIONS) for n in nodes) + sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))


def complexity_column(source: Column) -> Column:
    @F.pandas_udf(IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(complexity, na_action="ignore").astype("Int32")

    return run(source)
