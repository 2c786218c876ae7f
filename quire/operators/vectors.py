"""Vector search and scores: exact cosine top-k of a stated query set, late interaction, ranks.

Queries are stated and met in blocks against all rows: every task scores its
rows against one block of queries with one matrix product and keeps the block's
local top k, so what is shuffled is queries x partitions x k, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either is missing or without length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def top_k(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest rows of each query by cosine, the query itself left out: ``query_id, key, score, rank``.

    Ties go to the smaller key. Null vectors match nothing. Queries are taken
    in blocks of ``block`` ids, so what is sent to the executors is bounded.
    """
    kind = rows.schema[key].dataType.simpleString()
    src = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    ids = queries.select(F.col(key).alias("k")).distinct()
    n_blocks = max(1, -(-ids.count() // block))
    parts = []
    for i in range(n_blocks):
        mine = queries.filter(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == i).select(F.col(key).alias("k"), F.col(vector).alias("v")).filter(F.col("v").isNotNull()).dropDuplicates(["k"])
        got = mine.toPandas()  # one block of the stated queries
        if not len(got):
            continue
        q_ids, q = got.k.to_numpy(), _unit(np.stack(got.v.to_numpy()).astype(np.float64))
        shared = rows.sparkSession.sparkContext.broadcast((q_ids, q))  # at most about `block` vectors

        def score(batches, shared=shared):
            q_ids, q = shared.value
            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False)
                s = _unit(np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)) @ q.T
                s = np.round(s, 9)
                s[keys[:, None] == q_ids[None, :]] = -np.inf
                n = min(k, len(keys))
                order = np.lexsort((np.broadcast_to(keys[:, None], s.shape), -s), axis=0)[:n]
                cols = np.broadcast_to(np.arange(len(q_ids)), order.shape)
                sc = s[order, cols].ravel()
                ok = np.isfinite(sc)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[cols.ravel()[ok]]), pa.array(keys[order.ravel()[ok]]), pa.array(sc[ok])], names=["query_id", "k", "score"])

        parts.append(src.mapInArrow(score, f"query_id {kind}, k {kind}, score double"))
    if not parts:
        return src.select(F.col("k").alias("query_id"), F.col("k").alias(key), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "k")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("k").alias(key), "score", "rank")


def maxsim(query_tokens: DataFrame, doc_tokens: DataFrame, k: int = 10, block: int = 256) -> DataFrame:
    """Late interaction of stated queries: the k documents with the best mean over the query's
    tokens of the best dot product in the document, with the sum: ``query_id, doc, mean_score, sum_score, rank``.

    ``query_tokens``: query_id, v; ``doc_tokens``: doc, v. Queries are met in
    blocks of about ``block`` against all documents; ties go to the smaller doc.
    """
    docs = cut(doc_tokens.filter(F.col("v").isNotNull()).groupBy("doc").agg(F.collect_list("v").alias("vs")))  # grouped once for all blocks
    q = cut(query_tokens.filter(F.col("v").isNotNull()).groupBy("query_id").agg(F.collect_list("v").alias("qs")))
    kind, qkind = docs.schema["doc"].dataType.simpleString(), q.schema["query_id"].dataType.simpleString()
    n_blocks = max(1, -(-q.count() // block))
    found = None
    for i in range(n_blocks):
        rows = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i).collect()  # one block of the stated queries
        starts = np.cumsum([0, *(len(r.qs) for r in rows)])[:-1]
        shared = docs.sparkSession.sparkContext.broadcast(([r.query_id for r in rows], starts, np.array([v for r in rows for v in r.qs], float)))

        def score(batches, shared=shared):
            names, starts, tokens = shared.value
            for b in batches:
                ids, texts = b.column(0), [np.array(vs, float) for vs in b.column(1).to_pylist()]
                if not names or not texts:
                    continue
                firsts = np.cumsum([0, *map(len, texts)])[:-1]
                best = np.maximum.reduceat(tokens @ np.concatenate(texts).T, firsts, axis=1)  # query tokens x documents
                sums = np.add.reduceat(best, starts, axis=0)  # queries x documents
                means = np.round(sums / np.diff([*starts, len(tokens)])[:, None], 9)
                keys = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object)))  # ties go to the smaller document
                order = np.lexsort((np.broadcast_to(keys, means.shape), -means), axis=1)[:, :k]
                at = np.arange(len(names))[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in np.repeat(np.arange(len(names)), order.shape[1])]), ids.take(pa.array(order.ravel())),
                                                  pa.array(means[at, order].ravel()), pa.array(sums[at, order].ravel())], names=["query_id", "doc", "mean_score", "sum_score"])

        part = docs.mapInArrow(score, f"query_id {qkind}, doc {kind}, mean_score double, sum_score double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.col("mean_score").desc(), "doc")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def min_max(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Values scaled to 0..1 within a group; 0 where the group is flat."""
    lim = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = df.join(lim, list(by)) if by else df.crossJoin(F.broadcast(lim))  # without a group: one row
    return j.withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def contrastive(positive: Column, negatives: Column, temperature: float = 0.07) -> Column:
    """Log score of a positive similarity against an array of negatives."""
    top = F.greatest(positive, F.coalesce(F.array_max(negatives), positive)) / temperature
    rest = F.aggregate(negatives, F.lit(0.0), lambda s, x: s + F.exp(x / temperature - top))
    return positive / temperature - top - F.ln(F.exp(positive / temperature - top) + rest)
