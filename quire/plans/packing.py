"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators.nested import edge_children
from quire.operators.packed import split_packed
from quire.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = split_packed(table(spark, d, "samples"), "sample_idx", ["evidence_pages", "evidence_sources"])
    return out.selectExpr("cast(sample_idx as bigint) sample_idx", "field_name", "cast(item_no as bigint) item_no", "item_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return edge_children(table(spark, d, "hypergraphs"))


QUERIES = {"p4_found": p4_found, "p6_found": p6_found}
SQL: dict[str, str] = {}
