"""Token budgets: costs of units, nearest-rank percentiles, and how many units fit a context window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import box_tokens
from quire.functions.text import estimate_tokens, is_visual


def block_costs(blocks: DataFrame, width: float = 1224.0, height: float = 1584.0) -> DataFrame:
    """Visual tokens of visual blocks, text tokens of the others (``blocks`` as ``layout.layout`` gives them)."""
    v = is_visual(F.col("type"))
    return blocks.select("doc_id", "block_id", "type",
                         F.when(v, box_tokens(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), width, height)).otherwise(0).cast("bigint").alias("visual_tokens"),
                         F.when(v, 0).otherwise(estimate_tokens(F.col("text"))).cast("bigint").alias("text_tokens"))


def unit_costs(units: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost of each unit: its anchor's, caption's and title's tokens; units of no cost are left out."""
    parts = units.select("doc_id", F.col("block_id").alias("unit"), F.explode(F.array_distinct(F.array_compact(F.array("block_id", "caption_id", "title_id")))).alias("block_id"))
    c = parts.join(costs, ["doc_id", "block_id"]).groupBy("doc_id", "unit").agg(F.sum(F.col("visual_tokens") + F.col("text_tokens")).alias("cost"))
    return c.filter(F.col("cost") > 0)


def profile(costs: DataFrame, cost: str = "cost") -> DataFrame:
    """One row: count, mean, nearest-rank percentiles and maximum."""
    return costs.agg(F.count("*").alias("n"), F.round(F.avg(cost), 6).alias("mean"),
                     *[F.expr(f"percentile_disc({q / 100}) WITHIN GROUP (ORDER BY {cost})").alias(f"p{q}") for q in (50, 90, 95, 99)], F.max(cost).alias("max"))


def derive_k(profile_row: DataFrame, context: int, max_new: int, proxy: str = "p95", share: float = 0.9, reserve: int = 4096) -> DataFrame:
    """How many units of the proxy cost fit the context window."""
    usable = max(1, int(context * share) - reserve - max_new)
    cost = F.greatest(F.lit(1.0), F.col(proxy).cast("double"))
    return profile_row.select("*", F.lit(usable).cast("bigint").alias("usable"), F.greatest(F.lit(1), F.floor(F.lit(usable) / cost)).cast("bigint").alias("k"))
