"""Vector, ranking, budget, monitoring, adapter and relational queries, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire import models as M
from quire.operators import budget as Bd
from quire.operators import layout as L
from quire.operators import monitor as Mo
from quire.operators import ranking as Rk
from quire.operators import vectors as Ve
from quire.plans.graph import _UNITS, _units
from quire.plans.layout import _DIST, B, B1, VIS
from quire.session import table


def _e(spark, d):
    return table(spark, d, "embeddings")


def cosine_rank(spark, d):
    e = _e(spark, d)
    return Ve.top_k(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def maxsim(spark, d):
    e = _e(spark, d).select("vec_id", F.floor(F.col("vec_id") / 10).cast("bigint").alias("doc"), F.col("embedding").cast("array<double>").alias("v"))
    q = e.filter("doc % 20 = 0").select(F.col("doc").alias("query_id"), "v")
    return Ve.maxsim(q, e).select("query_id", "doc", "rank", F.round("mean_score", 6).alias("mean_score"), F.round("sum_score", 6).alias("sum_score"))


def label_norms(spark, d):
    v = F.col("embedding").cast("array<double>")
    n = _e(spark, d).select("vec_id", "label", F.sqrt(Ve.dot(v, v)).alias("norm"))
    return Ve.min_max(n, "norm", "label").select("vec_id", "label", F.round("norm", 6).alias("norm"), F.round("scaled", 6).alias("scaled"))


def _arcs(spark, d):
    b = L.layout(table(spark, d, "ocr_blocks")).filter("x1 is not null")
    return b, L.page_knn(b)


def pagerank_ppr(spark, d):
    b, arcs = _arcs(spark, d)
    n = b.select("doc_id", "page", "block_id", F.when(F.col("type") == "title", 2.0).otherwise(1.0).alias("personal"))
    return Rk.page_rank(n, arcs.withColumn("weight", 1.0 / (1.0 + F.col("distance") / 300.0)), ["doc_id", "page"]).withColumn("rank", F.round("rank", 6))


def degree_stats(spark, d):
    b, arcs = _arcs(spark, d)
    return Rk.degrees(b, arcs, ["doc_id", "page"])


def two_hop(spark, d):
    b = L.layout(table(spark, d, "ocr_blocks"))
    arcs = L.reading_order(b).filter("next_id is not null").select("doc_id", "page", F.col("block_id").alias("src"), F.col("next_id").alias("dst"))
    return Rk.hops(arcs, b.filter("type = 'title' and x1 is not null"), ["doc_id", "page"])


def token_estimate(spark, d):
    return Bd.block_costs(L.layout(table(spark, d, "ocr_blocks"))).groupBy("doc_id", "type").agg(F.sum("visual_tokens").alias("visual_tokens"), F.sum("text_tokens").alias("text_tokens"))


def edge_cost_profile(spark, d):
    return Bd.profile(Bd.unit_costs(_units(spark, d), Bd.block_costs(L.layout(table(spark, d, "ocr_blocks")))))


def derive_k(spark, d):
    return Bd.derive_k(edge_cost_profile(spark, d), 32768, 2048).select("n", "usable", "k")


def stage_rollup(spark, d):
    return Mo.stage_rollup(table(spark, d, "events"))


def window_rollup(spark, d):
    w = Mo.window_rollup(table(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "stage", "n", "seconds")


def image_monitor(spark, d):
    r = table(spark, d, "mmlb_example_results").distinct()
    return r.groupBy("run_source", F.lower(F.trim("status")).alias("state")).agg(F.count("*").alias("n"), F.sum("images_count").alias("images"), F.round(F.avg("images_count"), 6).alias("mean_images"))


def message_build(spark, d):
    s = table(spark, d, "samples").distinct().select("sample_idx", "question", "retrieval_query")
    m = M.messages(F.coalesce("question", F.lit("")), F.when(F.col("sample_idx") % 2 == 0, F.array(F.coalesce("retrieval_query", F.lit("")))).otherwise(F.array().cast("array<string>")), F.array().cast("array<string>"))
    p = M.predict(s.withColumn("messages", m).select("sample_idx", "messages"), M.ModelConfig())
    return p.select("sample_idx", "status", F.length("answer").alias("n"))


def revenue_by_region(spark, d):
    o, li, c, n, r = (table(spark, d, t) for t in ("orders", "lineitem", "customer", "nation", "region"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("revenue"), F.count("*").alias("n"))


def price_percentiles(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY l_extendedprice)").cast("double").alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)])


def top_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    o = table(spark, d, "orders")
    return o.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select("o_custkey", "o_orderkey", "rank")


QUERIES = {f.__name__: f for f in (cosine_rank, maxsim, label_norms, pagerank_ppr, degree_stats, two_hop, token_estimate, edge_cost_profile, derive_k, stage_rollup, window_rollup, image_monitor, message_build,
                                   revenue_by_region, price_percentiles, top_orders)}

_W = "greatest(least(1224.0, x2+10.0) - greatest(0.0, x1-10.0), 1.0)"
_H = "greatest(least(1584.0, y2+10.0) - greatest(0.0, y1-10.0), 1.0)"
_F = "(CASE WHEN w*h > 1003520 THEN sqrt(1003520.0::DOUBLE/(w*h)) WHEN w*h < 3136 THEN sqrt(3136.0::DOUBLE/(w*h)) ELSE 1.0 END)"
_COST = f"""wh AS (SELECT *, {_W} AS w, {_H} AS h FROM b),
 co AS (SELECT doc_id, block_id, type, CASE WHEN coalesce({VIS}, false) THEN coalesce(CAST(ceil(ceil(w*{_F}/14)*ceil(h*{_F}/14)/4) AS BIGINT), 0) ELSE 0 END AS visual_tokens,
   CASE WHEN coalesce({VIS}, false) THEN 0 ELSE CAST(ceil(greatest(length(coalesce(text,''))/4.0::DOUBLE, len(regexp_extract_all(coalesce(text,''), '\\S+'))*1.3::DOUBLE)) AS BIGINT) END AS text_tokens FROM wh)"""
_PROFILE = _UNITS + ", " + _COST + """, pa AS (SELECT DISTINCT doc_id, block_id AS unit, unnest([block_id, caption_id, title_id]) AS block_id FROM u),
 uc AS (SELECT pa.doc_id, unit, sum(visual_tokens + text_tokens) AS cost FROM pa JOIN co USING (doc_id, block_id) GROUP BY ALL HAVING sum(visual_tokens + text_tokens) > 0),
 pf AS (SELECT count(*) AS n, round(avg(cost), 6) AS mean, quantile_disc(cost, 0.5) AS p50, quantile_disc(cost, 0.9) AS p90, quantile_disc(cost, 0.95) AS p95, quantile_disc(cost, 0.99) AS p99, max(cost) AS max FROM uc)"""
_KNN = B + f"""p AS (SELECT a.doc_id, a.page, a.block_id AS src, c.block_id AS dst, {_DIST} AS distance FROM b a JOIN b c USING (doc_id, page) WHERE a.block_id <> c.block_id AND a.x1 IS NOT NULL AND c.x1 IS NOT NULL),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, src ORDER BY distance, dst) AS rank FROM p) WHERE rank <= 6 AND src < dst)"""
SQL = {
    "cosine_rank": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p QUALIFY rank <= 10",
    "maxsim": "WITH e AS (SELECT vec_id, CAST(floor(vec_id/10) AS BIGINT) AS doc, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT q.doc AS query_id, q.vec_id, e.doc, max(list_dot_product(q.v, e.v)) AS s FROM e q, e WHERE q.doc % 20 = 0 GROUP BY ALL) SELECT query_id, doc, round(avg(s), 6) AS mean_score, round(sum(s), 6) AS sum_score, row_number() OVER (PARTITION BY query_id ORDER BY round(avg(s), 9) DESC, doc) AS rank FROM m GROUP BY query_id, doc QUALIFY rank <= 10",
    "label_norms": "WITH n AS (SELECT vec_id, label, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings), w AS (SELECT *, min(norm) OVER (PARTITION BY label) AS lo, max(norm) OVER (PARTITION BY label) AS hi FROM n) SELECT vec_id, label, round(norm, 6) AS norm, round(CASE WHEN hi > lo THEN (norm-lo)/(hi-lo) ELSE 0.0 END, 6) AS scaled FROM w",
    "degree_stats": _KNN + " SELECT doc_id, page, n AS nodes, coalesce(a, 0) AS arcs, round(coalesce(a,0)/n::DOUBLE, 6) AS mean_degree FROM (SELECT doc_id, page, count(*) AS n FROM b WHERE x1 IS NOT NULL GROUP BY ALL) LEFT JOIN (SELECT doc_id, page, count(*) AS a FROM k GROUP BY ALL) USING (doc_id, page)",
    "two_hop": B + """o AS (SELECT doc_id, page, block_id AS src, lead(block_id) OVER (PARTITION BY doc_id, page ORDER BY round_even(y1/8, 0), x1, block_id) AS dst FROM b WHERE x1 IS NOT NULL),
 g AS (SELECT doc_id, page, src AS a, dst AS z FROM o WHERE dst IS NOT NULL UNION SELECT doc_id, page, dst, src FROM o WHERE dst IS NOT NULL),
 h0 AS (SELECT doc_id, page, block_id AS seed, block_id AS node, 0 AS hop FROM b WHERE type = 'title' AND x1 IS NOT NULL),
 h1 AS (SELECT DISTINCT h0.doc_id, h0.page, seed, g.z AS node, 1 AS hop FROM h0 JOIN g ON g.doc_id = h0.doc_id AND g.page = h0.page AND g.a = h0.node),
 h2 AS (SELECT DISTINCT h1.doc_id, h1.page, seed, g.z AS node, 2 AS hop FROM h1 JOIN g ON g.doc_id = h1.doc_id AND g.page = h1.page AND g.a = h1.node)
 SELECT doc_id, page, seed, node, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL""",
    "token_estimate": B + _COST + " SELECT doc_id, type, CAST(sum(visual_tokens) AS BIGINT) AS visual_tokens, CAST(sum(text_tokens) AS BIGINT) AS text_tokens FROM co GROUP BY ALL",
    "edge_cost_profile": _PROFILE + " SELECT * FROM pf",
    "derive_k": _PROFILE + " SELECT n, CAST(23347 AS BIGINT) AS usable, CAST(greatest(1, floor(23347/greatest(1.0, p95::DOUBLE))) AS BIGINT) AS k FROM pf",
    "stage_rollup": "SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS seconds, round(avg(value), 6) AS mean_seconds, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS tokens FROM events GROUP BY event_type",
    "window_rollup": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS stage, count(*) AS n, round(sum(value), 4) AS seconds FROM events GROUP BY ALL",
    "image_monitor": "WITH r AS (SELECT DISTINCT * FROM mmlb_example_results) SELECT run_source, lower(trim(status)) AS state, count(*) AS n, sum(images_count) AS images, round(avg(images_count), 6) AS mean_images FROM r GROUP BY ALL",
    "message_build": "WITH s AS (SELECT DISTINCT * FROM samples) SELECT sample_idx, 'success' AS status, CAST(17 + length(coalesce(question,'')) + CASE WHEN sample_idx % 2 = 0 THEN length(coalesce(retrieval_query,'')) + 1 ELSE 0 END AS INTEGER) AS n FROM s",
    "revenue_by_region": "SELECT r_name, round(sum(l_extendedprice*(1-l_discount)), 2)::DOUBLE AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "price_percentiles": "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5)::DOUBLE AS p50, quantile_disc(l_extendedprice, 0.9)::DOUBLE AS p90, quantile_disc(l_extendedprice, 0.99)::DOUBLE AS p99 FROM lineitem GROUP BY l_returnflag",
    "top_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 2",
}
