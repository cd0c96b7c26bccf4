"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomegrid.llm import glyphs, leakage, ledger, partenum, quality, split, tokens, toxicity
from tomegrid.session import table, wide_table

#: TESTDATA.md states these for problem 2.
P2 = {"shingle": 3, "threshold": 0.6, "min_words": 20}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_oversized(wide_table(spark, sf_dir, "chunked"))
    return pieces.where(F.col("piece") == 0).select("row_id", "boundary")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(wide_table(spark, sf_dir, "chunked"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_rows(wide_table(spark, sf_dir, "chunked"), **P2)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicate_groups(wide_table(spark, sf_dir, "chunked"), **P2)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.collapse(wide_table(spark, sf_dir, "chunked")).where(F.col("copies") >= 2).select("kept_id", "copies")


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"paragraph": F.col("metadata.Paragraph"), "content": F.col("content")}
    return glyphs.with_forms(wide_table(spark, sf_dir, "chunked"), table(spark, sf_dir, "latin_codes"), fields)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _forms(spark, sf_dir).select("row_id", F.expr("stack(2, 'paragraph', paragraph_changed, 'content', content_changed) AS (field, changed)"))
    return got.where(F.col("changed") != 0).select("row_id", "field")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(wide_table(spark, sf_dir, "chunked")).where(F.col("kind") != "prose").select("row_id", "kind")


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(wide_table(spark, sf_dir, "chunked"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(wide_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leakage.leaked_items(wide_table(spark, sf_dir, "documents"), table(spark, sf_dir, "exam_items"))
    return hits.where(F.col("distance") == 0).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(wide_table(spark, sf_dir, "documents"), table(spark, sf_dir, "exam_items"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(wide_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labelled_texts"), carry=("source",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.kinds_held(_scores(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(_scores(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
    "p5_statistics": p5_statistics,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}
