"""Registered queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import abuse, bpe, docpairs, leaks, origin, secrets, validity
from gnomon.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = secrets.found(table(spark, sf_dir, "source_files"), "file", "file_id")
    return files.unionByName(secrets.found(table(spark, sf_dir, "chunks"), "chunk", "chunk_ord"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that hold secrets, with the secrets replaced."""
    files = secrets.redact(table(spark, sf_dir, "source_files"), "file", "file_id")
    both = files.unionByName(secrets.redact(table(spark, sf_dir, "chunks"), "chunk", "chunk_ord"))
    return both.dropDuplicates(["record_kind", "record_id", "content"])  # repeated rows, of what holds secrets only


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pairs(spark, sf_dir).select("sym_ord", "chunk_ord")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their informative documentation."""
    return docpairs.pairs(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "chunks"))


def p3_javascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented JavaScript functions of the source files, with offsets."""
    return docpairs.javascript(table(spark, sf_dir, "source_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.classify(table(spark, sf_dir, "source_files")).where("reason <> ''").select("file_id").distinct()


def p4_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the reason why it is not hand-written, '' for those that are."""
    return origin.classify(table(spark, sf_dir, "source_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.judged(table(spark, sf_dir, "source_files")).where(~F.col("verdict").isin("ok", validity.NOT_JUDGED)).select("file_id").distinct()


def p5_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.judged(table(spark, sf_dir, "source_files"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.rates(validity.judged(table(spark, sf_dir, "source_files")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found(p7_leaks(spark, sf_dir))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked pair with the share of the item, the words that match, and the longer item whose passage it lies in."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), keep=("doc_id",)).where("flagged").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(abuse.scores(table(spark, sf_dir, "documents")))


QUERIES = {
    "p3_found": p3_found, "p3_pairs": p3_pairs, "p3_javascript": p3_javascript,
    "p4_found": p4_found, "p4_origin": p4_origin,
    "p5_found": p5_found, "p5_verdicts": p5_verdicts, "p5_rates": p5_rates,
    "p2_found": p2_found, "p2_redacted": p2_redacted, "p6_ids": p6_ids, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
ORACLE: dict[str, str] = {}
