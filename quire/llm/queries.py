"""Queries of the text operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quire.llm import leakage, lookalike, mix, pairs, scan_noise, split, truncation
from quire.session import cut, table


def _mixed(spark: SparkSession, d: str):
    sized = mix.sized_documents(table(spark, d, "documents"))
    targets = table(spark, d, "mix_targets")
    return sized, targets, mix.mix(sized, targets)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[2]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets, chosen = _mixed(spark, d)
    return mix.mix_report(sized, targets, chosen)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(table(spark, d, "documents"), "doc_id", "text")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "documents"), "doc_id", "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "mmlb_example_results"), "result_id", "question", "predicted_answer", "ground_truth", "status")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.with_verdict(table(spark, d, "mmlb_example_results"), "prediction", "run_source", "question", ["result_id", "run_source"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).filter("cut").select("result_id").distinct()


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.source_report(_judged(spark, d), "run_source")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "ocr_blocks").select(F.lit("ocr_blocks").alias("tbl"), "doc_id", F.col("block_id").cast("bigint").alias("row_no"), "text")
    samples = table(spark, d, "samples").select(F.lit("samples").alias("tbl"), "doc_id", F.col("sample_idx").cast("bigint").alias("row_no"),
                                                F.col("question").alias("text"))
    return blocks.unionByName(samples)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.changed(_texts(spark, d), "text").select("tbl", "doc_id", "row_no").distinct()


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical(_texts(spark, d), "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.noise(table(spark, d, "ocr_blocks")).selectExpr("doc_id", "cast(block_id as bigint) block_id", "noise")


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired(table(spark, d, "ocr_blocks"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_passages"), "item_id", "passage")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_spans(spark, d).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out item, how many documents it leaked into."""
    found = p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))
    return table(spark, d, "eval_passages").select("item_id", "split_name").join(found, "item_id", "left").na.fill(0, ["documents"])


QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans, "p7_items": p7_items, "p5_found": p5_found, "p5_repaired": p5_repaired, "p1_found": p1_found, "p2_found": p2_found, "p2_sources": p2_sources, "p3_found": p3_found, "p3_canonical": p3_canonical, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_pieces": p9_pieces}
SQL: dict[str, str] = {}
