"""Mix sources to target shares by systematic sampling.

Every document gets its expected number of copies; the copies are summed up
within the source in a fixed order, one random offset is added, and a document
is emitted once for each integer boundary its stretch of the sum crosses. The
prefix sum is taken in three levels (inside small buckets, over the totals of a
thousand buckets, and over the totals of these), so no source, however large, is
ordered by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tokens import TOKENIZER, with_tokens
from quire.session import cut, small, spread

BLOCK = 1000  # buckets whose totals are summed up in one task
ONE = 1 << 32  # fixed-point unit of expected copies; sums are exact integers


def source_name(col):
    """Canonical source: outer blanks off, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")


def _shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: size there is, expected copies of a record, both exact."""
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have_tokens"), F.count("*").alias("have_records"))
    total = have.agg(F.sum("have_tokens").alias("goal"))
    goal = F.coalesce("goal", F.lit(0)).cast("double")
    return (t.join(have, "source", "left").crossJoin(F.broadcast(total))  # one row: a scalar
            .withColumn("target_tokens", F.col("target_share") * goal)
            .withColumn("copies", F.when(F.col("have_tokens") > 0,
                                         F.least(F.col("target_tokens") / F.col("have_tokens"), F.col("max_repeats").cast("double")))
                        .otherwise(0.0))
            .withColumn("step", F.floor(F.coalesce("copies", F.lit(0.0)) * F.lit(float(ONE))).cast("bigint")))


def sized_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, source, tokens`` of every record, counted once and kept in the shared folder."""
    base = spread(docs.select(F.col(key), source_name(F.col(source)).alias("source"), F.col(text).alias("text")))
    return cut(with_tokens(base, "text", "tokens", tokenizer).select(key, "source", "tokens"))


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 17, bucket_rows: int = 50_000) -> DataFrame:
    """The chosen records: ``key, source, tokens, copies`` (copies >= 1).

    The size to aim at is the sum of all sizes. A source whose target needs
    more than ``max_repeats`` copies of each record gives ``max_repeats`` of
    each; its shortfall is reported, not filled from other sources. Records of
    null or untargeted sources and targets without records give no row. Target
    rows of one source under several spellings are added up.
    """
    goal = small(cut(_shares(sized, targets).select("source", "step")))
    rows = sized.join(goal, "source")
    n = rows.count()
    buckets = max(16, n // bucket_rows)
    # Records of like size stand together, so that each size is drawn in proportion and
    # the tokens drawn keep close to their expectation.
    size_class = F.floor(F.log2(F.col("tokens") + F.lit(1.0)) * 4).cast("bigint")
    spot = rows.withColumn("bucket", size_class * buckets + F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)))
    sums = spot.groupBy("source", "bucket").agg(F.sum("step").alias("s"))
    zero = F.lit(0)
    blocks = sums.withColumn("block", F.floor(F.col("bucket") / BLOCK).cast("bigint"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (blocks.groupBy("source", "block").agg(F.sum("s").alias("s"))
              .select("source", "block", F.coalesce(F.sum("s").over(before), zero).alias("first")))
    within = Window.partitionBy("source", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.withColumn("start", F.coalesce(F.sum("s").over(within), zero)).join(firsts, ["source", "block"])
              .select("source", "bucket", (F.col("start") + F.col("first")).alias("start")))
    inside = Window.partitionBy("source", "bucket").orderBy("tokens", F.xxhash64(key, F.lit(seed + 1)), key).rowsBetween(Window.unboundedPreceding, 0)
    offset = F.pmod(F.xxhash64("source", F.lit(seed + 2)), F.lit(ONE))
    top = F.col("start") + F.sum("step").over(inside) + offset
    return (spot.join(starts, ["source", "bucket"])
            .withColumn("top", top)
            .withColumn("copies", (F.shiftright("top", 32) - F.shiftright(F.col("top") - F.col("step"), 32)).cast("int"))
            .filter("copies > 0").select(key, "source", "tokens", "copies"))


def mix_report(sized: DataFrame, targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Target and actual share of every source that has a target or records."""
    want = _shares(sized, targets).select("source", "target_share", "max_repeats", "target_tokens")
    have = sized.groupBy("source").agg(F.count("*").alias("have_records"), F.sum("tokens").alias("have_tokens"))
    got = chosen.groupBy("source").agg(F.count("*").alias("used_records"), F.sum("copies").alias("copies"),
                                       F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"),
                                       F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("actual_tokens").alias("all"))
    zero = F.lit(0)
    return (have.join(want, "source", "full").join(got, "source", "left").crossJoin(F.broadcast(total))
            .select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats",
                    F.coalesce("have_records", zero).alias("have_records"), F.coalesce("have_tokens", zero).alias("have_tokens"),
                    F.coalesce("target_tokens", F.lit(0.0)).alias("target_tokens"),
                    F.coalesce("used_records", zero).alias("used_records"), F.coalesce("copies", zero).alias("copies"),
                    F.coalesce("most_copies", zero).alias("most_copies"),
                    F.coalesce("actual_tokens", zero).alias("actual_tokens"),
                    F.coalesce(F.col("actual_tokens") / F.col("all"), F.lit(0.0)).alias("actual_share")))
