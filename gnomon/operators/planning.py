"""Plans for questions by rules, as columns: the default planner, which needs no model.

A name in back quotes (else the first dotted or snake_case word) is the target.  What is asked
about it decides the steps: callers and impact, callees, imports, bases and subclasses, else a
lookup; questions without a name get a semantic search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"`([A-Za-z_][\w./]*)`"
PLAIN = r"\b([A-Za-z_]\w*(?:\.\w+)+|[a-z]+_\w+)\b"


def target(question: Column) -> Column:
    quoted = F.regexp_extract(question, NAME, 1)
    plain = F.regexp_extract(question, PLAIN, 1)
    return F.when(quoted != "", quoted).when(plain != "", plain)


def in_context(question: Column, active_symbol: Column | None = None, active_file: Column | None = None) -> Column:
    """A question with what its asker is looking at; without either it stays as it is.  The wording is a fixed value."""
    hints = [
        F.when(x != "", F.concat(F.lit(said), x, F.lit("`")))
        for x, said in ((active_symbol, "the user is currently viewing symbol `"), (active_file, "in file `")) if x is not None
    ]
    if not hints:
        return question
    text = F.array_join(F.array_compact(F.array(*hints)), " and ")
    return F.when(text != "", F.concat(question, F.lit("\n\n(Context: "), text, F.lit(".)"))).otherwise(question)


def _step(strategy: str, name: Column, query: Column, direction: str | None = None) -> Column:
    return F.struct(F.lit(strategy).alias("strategy"), name.cast("string").alias("target"), query.cast("string").alias("query"), F.lit(direction).cast("string").alias("direction"))


def plan(questions: DataFrame, max_results: int = 12) -> DataFrame:
    """`questions` (qid, repo, question) to plans (qid, repo, question, steps, intent, max_results)."""
    q = questions.withColumns({"_t": target(F.col("question")), "_l": F.lower("question")})
    low, name, null = F.col("_l"), F.col("_t"), F.lit(None)
    look = _step("symbol_lookup", name, null)
    is_file = F.col("_t").rlike(r"/|\.py$")
    intent = (
        F.when(name.isNull(), "explore")
        .when(low.rlike(r"\b(break|impact|affect|change[sd]?)\b"), "impact")
        .when(low.rlike(r"\b(subclass\w*|derive\w*|extends?)\b"), "subclasses")
        .when(low.rlike(r"\b(bases?|parents?|inherits?)\b"), "bases")
        .when(is_file | low.rlike(r"\bimport\w*\b"), "imports")
        .when(low.rlike(r"\b(who|what|which) calls\b|\bcallers?\b|\bused by\b"), "callers")
        .when(low.rlike(r"\bcalls?\b|\bcallees?\b|\buses\b"), "callees")
        .otherwise("lookup")
    )
    q = q.withColumn("intent", intent)
    steps = (
        F.when(F.col("intent") == "explore", F.array(_step("semantic_search", null, F.col("question"))))
        .when(F.col("intent").isin("impact", "callers"), F.array(look, _step("call_graph", name, null, "callers")))
        .when(F.col("intent") == "callees", F.array(look, _step("call_graph", name, null, "callees")))
        .when(F.col("intent") == "subclasses", F.array(look, _step("hierarchy", name, null, "subclasses")))
        .when(F.col("intent") == "bases", F.array(look, _step("hierarchy", name, null, "bases")))
        .when(F.col("intent") == "imports", F.array(_step("import_graph", name, null, "both")))
        .otherwise(F.array(look))
    )
    return q.select("qid", "repo", "question", steps.alias("steps"), "intent", F.lit(max_results).alias("max_results"))
