"""SQL names for the functions that need Python."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import IntegerType

from gnomon.functions.complexity import complexity
from gnomon.operators.parse import FileReader


@udtf(returnType="qualified_name: string, kind: string, start_line: int, end_line: int, signature: string, docstring: string")
class ParsePython:
    """Rows of a file's symbols; none for text that does not parse."""

    def eval(self, path: str, content: str):  # noqa: ANN201
        try:
            found = FileReader(path or "", content or "").symbols
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        for s in found:
            yield s["qualified_name"], s["kind"], s["start_line"], s["end_line"], s["signature"], s["docstring"]


def register(spark: SparkSession) -> None:
    """cyclomatic_complexity(text) and the table function parse_python(path, text)."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(complexity, na_action="ignore").astype("Int32")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    spark.udf.register("cyclomatic_complexity", pandas_udf(run, IntegerType()))
    spark.udtf.register("parse_python", ParsePython)
