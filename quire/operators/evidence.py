"""Coverage of constraints, evidence packing, rerank mixes, caption matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import caption_cue
from quire.operators.ranking import best_matching
from quire.schema import CAPTION_TYPES, VISUAL_TYPES


def coverage(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Share of a question's atomic constraints that its units satisfy; 1 where it has none.

    ``wanted``: sample_idx, constraint (null for a question without any);
    ``found``: sample_idx, constraint, as satisfied by any unit.
    """
    f = found.select("sample_idx", "constraint").distinct().withColumn("_hit", F.lit(1))
    j = wanted.distinct().join(f, ["sample_idx", "constraint"], "left")
    return j.groupBy("sample_idx").agg(F.count("constraint").alias("constraints"), F.count("_hit").alias("satisfied"), F.when(F.count("constraint") == 0, 1.0).otherwise(
        F.count("_hit") / F.count("constraint")).alias("coverage"))


def pack(units: DataFrame, group: str, k: int) -> DataFrame:
    """Units of each question packed by turns over their groups, labelled A, B, C... by group in
    order of arrival (numbers from the 27th on): ``sample_idx, label, place, unit``."""
    inner = Window.partitionBy("sample_idx", group).orderBy("seq")
    every = Window.partitionBy("sample_idx", group)
    u = units.withColumn("turn", F.row_number().over(inner)).withColumn("arrival", F.min("seq").over(every))
    w = Window.partitionBy("sample_idx")
    n = F.dense_rank().over(w.orderBy("arrival"))
    u = u.withColumn("number", n).withColumn("place", F.row_number().over(w.orderBy("turn", "arrival", "seq")))
    return u.filter(F.col("place") <= k).select("sample_idx", F.when(F.col("number") <= 26, F.char(F.col("number") + 64)).otherwise(F.col("number").cast("string")).alias("label"), "place", "unit")


def rerank(scores: DataFrame, first: str, second: str, share: float = 0.7, k: int = 5) -> DataFrame:
    """Mix of two scores, the missing one left out; top k of each query."""
    mix = F.when(F.col(second).isNull(), F.col(first)).when(F.col(first).isNull(), F.col(second)).otherwise(share * F.col(first) + (1 - share) * F.col(second))
    w = Window.partitionBy("query_id").orderBy(F.col("mixed").desc(), "unit")
    return scores.withColumn("mixed", F.round(mix, 9)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def neighbour_average(scores: DataFrame, arcs: DataFrame, by: list[str], share: float = 0.2) -> DataFrame:
    """Scores raised by a share of their neighbours' mean score (``scores``: by, block_id, score)."""
    both = arcs.select(*by, F.col("src").alias("block_id"), F.col("dst").alias("other")).unionByName(arcs.select(*by, F.col("dst").alias("block_id"), F.col("src").alias("other"))).distinct()
    near = both.join(scores.select(*by, F.col("block_id").alias("other"), F.col("score").alias("s")), [*by, "other"]).groupBy(*by, "block_id").agg(F.avg("s").alias("near"))
    return scores.join(near, [*by, "block_id"], "left").select(*by, "block_id", (F.col("score") + share * F.coalesce("near", F.lit(0.0))).alias("score"))


def match_captions(blocks: DataFrame, page_height: float = 1584.0, least: float = 0.3) -> DataFrame:
    """Heaviest matching of visuals and captions of each page, by nearness and caption cues:
    ``doc_id, page, visual, caption, weight``. Pages are small, so each is one kernel call."""
    v = blocks.filter(F.col("type").isin(*VISUAL_TYPES) & F.col("x1").isNotNull())
    c = blocks.filter(F.col("type").isin(*CAPTION_TYPES, "caption") & F.col("x1").isNotNull()).withColumn("cue", caption_cue(F.col("text")))
    vs = v.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_id", "x1", "y1", "x2", "y2"))).alias("vs"))
    cs = c.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_id", "x1", "y1", "x2", "y2", "cue"))).alias("cs"))

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                w = np.zeros((len(r.vs), len(r.cs)))
                for i, a in enumerate(r.vs):
                    for j, b in enumerate(r.cs):
                        gap = max(b["y1"] - a["y2"], a["y1"] - b["y2"], 0.0)
                        wide = max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])) / max(min(a["x2"] - a["x1"], b["x2"] - b["x1"]), 1e-9)
                        if gap <= 0.4 * page_height:
                            s = 0.6 * (1 - gap / (0.4 * page_height)) * wide + 0.4 * b["cue"]
                            w[i, j] = s if s >= least else 0.0
                rows += [(r.doc_id, r.page, int(r.vs[i]["block_id"]), int(r.cs[j]["block_id"]), round(0.9 * w[i, j], 6)) for i, j in best_matching(w)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "visual", "caption", "weight"])

    return vs.join(cs, ["doc_id", "page"]).mapInPandas(run, "doc_id string, page int, visual bigint, caption bigint, weight double")
