from itertools import permutations

import numpy as np

from quire.functions import geometry as G
from quire.operators import graph as H
from quire.operators import layout as L
from quire.operators.ranking import best_matching, document_rank, mix_ranks, page_rank
from pyspark.sql import functions as F

COLS = "doc_id string, block_id bigint, page int, bbox array<double>, block_type string, text string, rec_conf double"


def blocks(spark, rows):
    return L.layout(spark.createDataFrame(rows, COLS))


def test_visuals_merge_at_small_gaps_only(spark):
    rows = [("d", 0, 0, [0.0, 0.0, 100.0, 50.0], "figure", None, None), ("d", 1, 0, [0.0, 69.0, 100.0, 120.0], "figure", None, None), ("d", 2, 0, [0.0, 140.0, 100.0, 150.0], "figure", None, None),
            ("d", 3, 0, None, "figure", None, None), ("d", 0, 0, [0.0, 0.0, 100.0, 50.0], "figure", None, None), ("d", 4, 1, [0.0, 0.0, 9.0, 9.0], "table", None, None)]
    got = sorted((r.page, r.block_id, r.y2, r.merged) for r in L.merge_adjacent(blocks(spark, rows)).collect())
    assert got == [(0, 0, 120.0, 2), (0, 2, 150.0, 1), (1, 4, 9.0, 1)]
    assert L.merge_adjacent(blocks(spark, [])).count() == 0


def test_typed_caption_below_wins(spark):
    rows = [("d", 0, 0, [0.0, 100.0, 100.0, 200.0], "figure", None, None), ("d", 1, 0, [0.0, 205.0, 100.0, 220.0], "text", "near", 1.0), ("d", 2, 0, [0.0, 280.0, 100.0, 300.0], "figure_caption", "below", 1.0),
            ("d", 3, 0, [0.0, 80.0, 100.0, 95.0], "figure_caption", "above", 1.0), ("d", 4, 0, [500.0, 205.0, 600.0, 220.0], "figure_caption", "beside", 1.0)]
    b = blocks(spark, rows)
    assert [(r.block_id, r.caption_id) for r in L.captions(L.merge_adjacent(b), b).collect()] == [(0, 2)]


def test_titles_reach_three_pages_back(spark):
    rows = [("d", 0, 0, [0.0, 0.0, 100.0, 10.0], "title", "t0", 1.0), ("d", 1, 3, [0.0, 50.0, 100.0, 99.0], "figure", None, None), ("d", 2, 4, [0.0, 50.0, 100.0, 99.0], "figure", None, None),
            ("d", 3, 3, [0.0, 10.0, 100.0, 20.0], "title", "t3", 1.0)]
    b = blocks(spark, rows)
    got = {r.block_id: r.title_id for r in L.nearest_titles(L.merge_adjacent(b), b).collect()}
    assert got == {1: 3, 2: 3}


def test_units_and_edges(spark):
    rows = [("d", 0, 0, [0.0, 100.0, 100.0, 200.0], "map", None, None), ("d", 2, 0, [0.0, 210.0, 100.0, 230.0], "map_caption", "Map 1", 1.0)]
    b = blocks(spark, rows)
    v = L.merge_adjacent(b)
    e = H.build_edges(H.build_units(v, L.captions(v, b), L.nearest_titles(v, b))).collect()
    assert sorted(r.relation for r in e) == ["contextual", "page_contains_visual"]
    assert next(r.members for r in e if r.relation == "contextual") == ["d_block_0_anchor", "d_block_0_caption"]


def test_directions(spark):
    a = dict(zip(("x1", "y1", "x2", "y2"), map(F.lit, (0.0, 0.0, 10.0, 10.0))))
    b = dict(zip(("x1", "y1", "x2", "y2"), map(F.lit, (100.0, 0.0, 110.0, 10.0))))
    r = spark.range(1).select(G.direction(a, b).alias("d"), G.iou(a, a).alias("i"), G.centre_distance(a, b).alias("c")).first()
    assert (r.d, r.i, r.c) == ("right", 1.0, 100.0)


def power_iteration(src, dst, w, nodes, personal, damping=0.85):
    """The stationary distribution of the dense matrix of the walk."""
    n = len(nodes)
    p = np.array(personal, float) / sum(personal)
    m = np.tile(p[:, None], (1, n))  # nodes without arcs jump to the personalisation
    for x in nodes:
        out = [(b, c) for a, b, c in zip(src, dst, w) if a == x]
        if out:
            m[:, nodes.index(x)] = 0
            for b, c in out:
                m[nodes.index(b), nodes.index(x)] += c / sum(v for _, v in out)
    r = np.linalg.matrix_power(damping * m + (1 - damping) * np.tile(p[:, None], (1, n)), 300) @ p
    return dict(zip(nodes, r))


def test_page_rank_against_power_iteration(spark):
    src, dst, w, nodes, own = [1, 2, 3, 3], [2, 3, 1, 2], [1.0, 2.0, 1.0, 1.0], [1, 2, 3, 4], [1.0, 1.0, 2.0, 1.0]
    n = spark.createDataFrame([("d", i, p) for i, p in zip(nodes, own)] + [("e", 1, 1.0)], "doc_id string, block_id bigint, personal double")
    arcs = spark.createDataFrame([("d", a, b, c) for a, b, c in zip(src, dst, w)], "doc_id string, src bigint, dst bigint, weight double")
    want = power_iteration(src, dst, w, nodes, own)
    for rank in (page_rank(n, arcs, ["doc_id"]), document_rank(n, arcs, ["doc_id"], rounds=40, tol=1e-4)):
        got = {(r.doc_id, r.block_id): r["rank"] for r in rank.collect()}
        assert all(abs(got["d", k] - want[k]) < 1e-3 for k in want) and abs(got["e", 1] - 1) < 1e-9
    mixed = {r.block_id: r.score for r in mix_ranks(page_rank(n, arcs, ["doc_id"]).filter("doc_id = 'd'"), spark.createDataFrame([("d", 1, 1.0)], "doc_id string, block_id bigint, score double"), ["doc_id"]).collect()}
    assert abs(max(mixed.values()) - max(0.7, 0.7 * want[1] / max(want.values()) + 0.3)) < 1e-2


def test_matching_is_heaviest():
    w = np.array([[5, 6, 0], [6, 1, 0], [0, 0, 2]])
    assert sum(w[i, j] for i, j in best_matching(w)) == 14
    assert best_matching(np.zeros((2, 3))) == []
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 5), (5, 3), (4, 4)):
        for _ in range(20):
            w = rng.random((n, m)) * (rng.random((n, m)) > 0.3)
            a = w if n <= m else w.T
            want = max(sum(a[i, p[i]] for i in range(a.shape[0])) for p in permutations(range(a.shape[1]), a.shape[0]))
            assert abs(sum(w[i, j] for i, j in best_matching(w)) - want) < 1e-9
    assert len(best_matching(rng.random((40, 60)))) == 40


def test_hints(spark):
    one = spark.createDataFrame([("The chart below Figure 3 in the upper left",), (None,)], "t string").select(L.spatial_hint(F.col("t")).alias("h")).collect()
    assert (one[0].h.relation, one[0].h.unit, one[0].h.top, one[0].h.bottom, one[0].h.left, one[0].h.right) == ("below", "figure 3", True, True, True, False)
    assert one[1].h.relation is None and not one[1].h.left
