"""Prompts for a reasoner and checks of its answers, over all questions at once.

The reasoner itself is a callable that is given; without one the answers are extracts of the
evidence.  Answers come as JSON text: answer, confidence, evidence_sufficient, citations.
"""

from __future__ import annotations

from functools import reduce
from string import Template

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnomon.functions import text as T

ANSWER = "struct<answer: string, confidence: string, evidence_sufficient: boolean, citations: array<int>>"
LEVELS = ("low", "medium", "high")


def prompts(evidence: DataFrame) -> DataFrame:
    """(qid, evidence_text): numbered blocks with source, location, confidence, reason and content."""
    shown = F.coalesce(F.format_string("%.2f", "confidence"), F.lit("n/a"))
    shown = F.when(F.col("confidence").isNull(), F.lit("n/a")).otherwise(shown)
    block = F.concat(
        F.lit("["), F.col("item").cast("string"), F.lit("] source="), F.col("source"), F.lit(" location="), T.location(F.col("file_path"), F.col("start_line"), F.col("end_line")),
        F.lit(" confidence="), shown, F.lit("\nreason: "), F.col("explanation"), F.lit("\n"), F.coalesce("content", F.lit("")),
    )
    rows = F.array_sort(F.collect_list(F.struct("item", block.alias("block"))))
    return evidence.groupBy("qid").agg(F.array_join(F.transform(rows, lambda x: x["block"]), "\n\n---\n\n").alias("evidence_text"))


def filled(template: str, fields: dict[str, Column]) -> Column:
    """A template with `$name` and `${name}` filled in per row, `$$` for a dollar sign; KeyError for a name without a column, ValueError for a stray sign."""
    parts, at = [], 0
    for m in Template.pattern.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        name = m["named"] or m["braced"]
        if name is None and m["escaped"] is None:
            raise ValueError(f"stray $ at {m.start()}")
        parts.append(F.coalesce(fields[name].cast("string"), F.lit("")) if name else F.lit("$"))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def parse(answers: DataFrame, column: str = "output") -> DataFrame:
    """(qid, answer, confidence, evidence_sufficient, citations); text that is no JSON object gives an empty answer of low confidence."""
    a = F.from_json(column, ANSWER)
    out = answers.withColumn("_a", a)
    return out.select(
        "qid", F.coalesce("_a.answer", F.lit("")).alias("answer"), T.known_or(F.col("_a.confidence"), LEVELS, "low").alias("confidence"),
        F.coalesce("_a.evidence_sufficient", F.lit(False)).alias("evidence_sufficient"), F.filter(F.coalesce("_a.citations", F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("citations"),
    )


def citations(parsed: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, place, item, ...): each cited number with the evidence it means; numbers without one are left out."""
    cited = parsed.select("qid", F.posexplode("citations").alias("place", "item"))
    return cited.join(evidence.select("qid", "item", "source", "qualified_name", "file_path", "start_line", "end_line"), ["qid", "item"])


#: The messages are fixed values.
def issues(parsed: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, severity, message): numbers out of range, sufficiency without evidence, empty answers, answers that cite nothing."""
    n = evidence.groupBy("qid").agg(F.count("*").alias("n"))
    p = parsed.join(n, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = p.select("qid", "n", F.explode("citations").alias("c")).where((F.col("c") < 1) | (F.col("c") > F.col("n")))
    wrong = wrong.select("qid", F.lit("error").alias("severity"), F.concat(F.lit("Citation ["), F.col("c").cast("string"), F.lit("] does not correspond to any retrieved evidence item (only "), F.col("n").cast("string"), F.lit(" available)")).alias("message"))

    def when(condition: object, severity: str, message: str) -> DataFrame:
        return p.where(condition).select("qid", F.lit(severity).alias("severity"), F.lit(message).alias("message"))

    parts = [
        wrong,
        when(F.col("evidence_sufficient") & (F.col("n") == 0), "error", "Answer claims evidence was sufficient, but no evidence was retrieved"),
        when(F.regexp_replace("answer", r"(?U)\s", "") == "", "error", "Answer text is empty"),
        when(F.col("evidence_sufficient") & (F.col("n") > 0) & (F.size("citations") == 0), "warning", "Answer claims evidence was sufficient but cites no evidence items"),
    ]
    return reduce(DataFrame.unionByName, parts)


def extracts(evidence: DataFrame, most: int = 3) -> DataFrame:
    """(qid, output): the offline reasoner; names the first items and cites them."""
    top = evidence.where(F.col("item") <= most)
    rows = F.array_sort(F.collect_list(F.struct("item", "explanation")))
    text = F.array_join(F.transform(rows, lambda x: F.concat(x["explanation"], F.lit(" ["), x["item"].cast("string"), F.lit("]"))), "; ")
    body = F.struct(text.alias("answer"), F.lit("medium").alias("confidence"), F.lit(True).alias("evidence_sufficient"), F.transform(rows, lambda x: x["item"]).alias("citations"))
    return top.groupBy("qid").agg(F.to_json(body).alias("output"))
