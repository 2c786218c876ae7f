"""Graphs of a page's blocks: personalised PageRank, hops, degrees, matching.

Graphs as small as a page are one grouped numpy kernel each; graphs of whole
documents are ranked by joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut


def pagerank_kernel(src, dst, weight, nodes, personal=None, damping=0.85, tol=1e-6, rounds=100) -> np.ndarray:
    """Weighted personalised PageRank; mass of nodes without arcs goes to the personalisation."""
    n = len(nodes)
    at = {x: i for i, x in enumerate(nodes)}
    p = np.full(n, 1.0 / n) if personal is None else np.asarray(personal, float) / np.sum(personal)
    a, b, w = np.array([at[x] for x in src], int), np.array([at[x] for x in dst], int), np.asarray(weight, float)
    out = np.bincount(a, w, n) if len(w) else np.zeros(n)
    share = w / out[a] if len(w) else w
    r = p.copy()
    for _ in range(rounds):
        flow = np.bincount(b, share * r[a], n) if len(w) else np.zeros(n)
        new = damping * (flow + r[out == 0].sum() * p) + (1 - damping) * p
        done = np.abs(new - r).sum() < n * tol
        r = new
        if done:
            break
    return r


def page_rank(nodes: DataFrame, arcs: DataFrame, by: list[str], damping: float = 0.85) -> DataFrame:
    """PageRank of each group's graph: ``by, block_id, rank``. ``nodes``: by, block_id,
    personal; ``arcs``: by, src, dst, weight. Nodes without arcs take part."""
    a = arcs.groupBy(*by).agg(F.collect_list(F.struct("src", "dst", "weight")).alias("arcs"))
    n = nodes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("block_id", "personal"))).alias("nodes"))
    g = n.join(a, by, "left")
    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in by)

    def run(frames):
        for pdf in frames:
            rows = []
            for row in pdf.itertuples(index=False):
                ids = [x["block_id"] for x in row.nodes]
                arcs_ = row.arcs if row.arcs is not None else []
                r = pagerank_kernel([x["src"] for x in arcs_], [x["dst"] for x in arcs_], [x["weight"] for x in arcs_], ids, [max(x["personal"], 1e-8) for x in row.nodes], damping)
                rows += [(*[getattr(row, c) for c in by], i, float(x)) for i, x in zip(ids, r)]
            yield pd.DataFrame(rows, columns=[*by, "block_id", "rank"])

    return g.mapInPandas(run, f"{kinds}, block_id bigint, rank double")


def document_rank(nodes: DataFrame, arcs: DataFrame, by: list[str], damping: float = 0.85, rounds: int = 20, tol: float = 1e-6) -> DataFrame:
    """PageRank of graphs of any size, as joins: ``by, block_id, rank``. ``nodes``: by, block_id, personal; ``arcs``: by, src, dst, weight.

    No graph is handled by one task; every round is kept in the shared folder.
    Ends when no node of any graph moves by more than ``tol``, or after ``rounds``.
    """
    n = cut(nodes.groupBy(*by, "block_id").agg(F.max(F.greatest("personal", F.lit(1e-8))).alias("p")))
    n = cut(n.join(n.groupBy(*by).agg(F.sum("p").alias("_all")), by).select(*by, "block_id", (F.col("p") / F.col("_all")).alias("p")))
    a = arcs.groupBy(*by, "src", "dst").agg(F.sum("weight").alias("w"))
    a = cut(a.join(a.groupBy(*by, "src").agg(F.sum("w").alias("_out")), [*by, "src"]).filter("_out > 0").select(*by, F.col("src").alias("block_id"), "dst", (F.col("w") / F.col("_out")).alias("share")))
    ends = cut(n.join(a.select(*by, "block_id").distinct(), [*by, "block_id"], "left_anti").select(*by, "block_id"))  # nodes without arcs out
    r = n.withColumn("r", F.col("p"))
    for _ in range(rounds):
        flow = r.join(a, [*by, "block_id"]).groupBy(*by, F.col("dst").alias("block_id")).agg(F.sum(F.col("r") * F.col("share")).alias("flow"))
        lost = r.join(ends, [*by, "block_id"], "left_semi").groupBy(*by).agg(F.sum("r").alias("lost"))
        new = r.join(flow, [*by, "block_id"], "left").join(lost, by, "left")
        rank = damping * (F.coalesce("flow", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) * F.col("p")) + (1 - damping) * F.col("p")
        new = cut(new.select(*by, "block_id", "p", rank.alias("new"), F.abs(rank - F.col("r")).alias("moved")))
        r = new.select(*by, "block_id", "p", F.col("new").alias("r"))
        if (new.agg(F.max("moved")).first()[0] or 0.0) < tol:
            break
    return r.select(*by, "block_id", F.col("r").alias("rank"))


def mix_ranks(ranks: DataFrame, scores: DataFrame, by: list[str], share: float = 0.7) -> DataFrame:
    """Ranks scaled to the largest of their graph, mixed with the blocks' own scores: ``by, block_id, score``."""
    top = ranks.groupBy(*by).agg(F.max("rank").alias("_top"))
    j = ranks.join(top, by).join(scores.select(*by, "block_id", F.col("score").alias("_s")), [*by, "block_id"], "left")
    return j.select(*by, "block_id", (share * F.when(F.col("_top") > 0, F.col("rank") / F.col("_top")).otherwise(0.0) + (1 - share) * F.coalesce("_s", F.lit(0.0))).alias("score"))


def degrees(nodes: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame:
    """Mean in- and out-degree of each graph, nodes without arcs included."""
    n = nodes.groupBy(*by).agg(F.count("*").alias("nodes"))
    e = arcs.groupBy(*by).agg(F.count("*").alias("arcs"))
    return n.join(e, by, "left").select(*by, "nodes", F.coalesce("arcs", F.lit(0)).alias("arcs"), F.round(F.coalesce("arcs", F.lit(0)) / F.col("nodes"), 6).alias("mean_degree"))


def hops(arcs: DataFrame, seeds: DataFrame, by: list[str]) -> DataFrame:
    """Nodes within two undirected hops of seed nodes, with the least number of hops."""
    both = arcs.select(*by, F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(arcs.select(*by, F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    zero = seeds.select(*by, F.col("block_id").alias("seed"), F.col("block_id").alias("node"), F.lit(0).alias("hop"))
    one = zero.join(both, [*[zero[c] == both[c] for c in by], zero.node == both.a]).select(*[zero[c] for c in by], "seed", F.col("b").alias("node"), F.lit(1).alias("hop")).distinct()
    two = one.join(both, [*[one[c] == both[c] for c in by], one.node == both.a]).select(*[one[c] for c in by], "seed", F.col("b").alias("node"), F.lit(2).alias("hop")).distinct()
    return zero.unionByName(one).unionByName(two).groupBy(*by, "seed", "node").agg(F.min("hop").alias("hop"))


def best_matching(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the heaviest bipartite matching, not necessarily the largest: shortest augmenting
    paths with potentials, one row after another, in cubic time. Weights not above 0 are no pairs."""
    w = np.asarray(weights, float)
    if not w.size:
        return []
    turned = w.shape[0] > w.shape[1]
    w = np.maximum(w.T if turned else w, 0.0)
    n, m = w.shape
    cost = w.max() - w
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # row of each column; column m is where a path starts
    for i in range(n):
        owner[m] = i
        here, least, back = m, np.full(m, np.inf), np.full(m, m)
        done = np.zeros(m + 1, bool)
        while owner[here] >= 0:
            done[here] = True
            r = owner[here]
            reach = cost[r] - row_price[r] - col_price[:m]
            better = ~done[:m] & (reach < least)
            least[better], back[better] = reach[better], here
            step = np.where(done[:m], np.inf, least)
            nearest = int(np.argmin(step))
            gain = step[nearest]
            row_price[owner[done]] += gain
            col_price[done] -= gain
            least[~done[:m]] -= gain
            here = nearest
        while here != m:
            owner[here] = owner[back[here]]
            here = back[here]
    out = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0 and w[owner[j], j] > 0]
    return sorted((j, i) for i, j in out) if turned else sorted(out)
