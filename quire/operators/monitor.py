"""Monitoring rollups over stage records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_rollup(events: DataFrame, stage: str = "event_type", seconds: str = "value") -> DataFrame:
    """Totals and averages by stage; nulls are skipped, and a stage of nulls only has a null total."""
    tokens = F.get_json_object("props", "$.k").try_cast("bigint")
    return events.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum(seconds), 4).alias("seconds"), F.round(F.avg(seconds), 6).alias("mean_seconds"), F.sum(tokens).alias("tokens"))


def window_rollup(events: DataFrame, width: str = "1 hour", time: str = "ts", stage: str = "event_type", seconds: str = "value") -> DataFrame:
    """Totals by stage in tumbling windows of event time; the same plan on a batch and on a stream."""
    return events.groupBy(F.window(time, width).alias("w"), F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum(seconds), 4).alias("seconds")).select(
        F.col("w.start").alias("start"), "stage", "n", "seconds")
