import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.text import normalize_ocr, unit_pattern
from quire.operators import retrieval as Rt
from quire.operators import similarity as Si
from quire.operators import tools as T

UNIT = "doc_id string, edge_id string, seq int, anchor_id string, type string, page int, top double, caption string, text string, clash string"


def units(spark, rows):
    return spark.createDataFrame([("d", f"e{i}", i, f"a{i}", kind, page, top, caption, caption, "x") for i, (kind, page, top, caption) in enumerate(rows)], UNIT)


def questions(spark, *texts):
    return T.asks(spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)], "sample_idx int, doc_id string, question string"))


def test_numbers_of_captions(spark):
    captions = ["Figure 12: x", "F1gure l2", "Fig. 1O shows", "figs 3", "Table 3", "T@b. 5a", "table", "Chart 8B", "map2 and Map 4", None, "", "Graph 100", "figure twelve"]
    u = units(spark, [("figure", 0, 0.0, c) for c in captions])
    got = {(r.edge_id, r.noun, r.id) for r in T.caption_numbers(u).collect()}
    want = {(f"e{i}", noun, str(n)) for i, c in enumerate(captions) if c for noun in ("figure", "table", "chart", "map", "graph") for n in range(130) if re.search(unit_pattern(str(n), noun), c.lower())}
    assert {x for x in got if len(x[2]) < 3 or int(x[2]) < 130} == want and ("e0", "figure", "12") in got and ("e0", "figure", "1") not in got


def test_find_by_number(spark):
    u = units(spark, [("figure", 0, 10.0, "Figure 1"), ("figure", 1, 10.0, None), ("figure", 2, 10.0, "Figure 3"), ("figure", 3, 0.0, None), ("figure", 4, 0.0, None), ("figure", 5, 0.0, "Figure 9"), ("table", 1, 0.0, "Table 7")])
    w = questions(spark, "See Figure 1 and figure 3", "What is in Figure 2?", "And Figure 6?", "And map 7?", "And Table 7?", "nothing named", None)
    got = {(r.sample_idx, r.id, r.edge_id, r.score) for r in T.find_by_id(u, w).collect()}
    assert got == {(0, "1", "e0", 1.0), (0, "3", "e2", 1.0), (1, "2", "e1", 0.75), (2, "6", "e3", 0.65), (4, "7", "e6", 1.0)}
    assert T.find_by_id(u.limit(0), w).count() == 0 and T.find_by_id(u, w.limit(0)).count() == 0


def test_find_by_page(spark):
    u = units(spark, [("figure", 0, 0.0, "a"), ("table", 1, 0.0, "b"), ("figure", 9, 0.0, "c")])
    totals = spark.createDataFrame([("d", 10)], "doc_id string, total_pages int")
    w = questions(spark, "Which table on page 1?", "What map is on page 1?", "What is on the last page?", "On page 77?")
    got = {(r.sample_idx, r.edge_id, r.score) for r in T.find_by_page(u, w, totals).collect()}
    assert got == {(0, "e1", 0.95), (1, "e0", 0.75), (1, "e1", 0.75), (2, "e2", 0.95)}


def test_sections(spark):
    edges = spark.createDataFrame([("d", "c0", "containment", "section_contains_visual", 0, ["t", "v0"]), ("d", "c1", "containment", "section_contains_visual", 1, ["t2", "v1"]), ("d", "x0", "contextual", "contextual", 2, ["v0"])],
                                  "doc_id string, edge_id string, edge_type string, relation string, seq int, members array<string>")
    nodes = spark.createDataFrame([("d", "t", "title", 0, "Water management", None), ("d", "t2", "title", 0, "Roads", None), ("d", "v0", "figure", 0, None, [0.0, 1.0]), ("d", "v1", "table", 1, None, None)],
                                  "doc_id string, block_id string, type string, page int, text string, bbox array<double>")
    u = T.units(edges, nodes)
    s = T.section_units(edges, nodes, u)
    assert {(r.title, r.edge_id, r.type) for r in s.collect()} == {("Water management", "x0", "figure"), ("Roads", "v1_section_synthetic", "table")}
    got = {(r.sample_idx, r.edge_id, r.fell_back) for r in T.find_by_section(s, u, questions(spark, "In the section on water, what?", "In the section on roads, what?", "In the section on bees, what?", "What?")).collect()}
    assert got == {(0, "x0", False), (1, "v1_section_synthetic", False), (2, "x0", True)}


def test_enumerate_and_count(spark):
    rows = [("figure", i, 0.0, f"Figure {i + 1} of boats" if i % 2 else "boats and mills") for i in range(50)] + [("table", 60, 0.0, "Table 2 of boats")]
    u = units(spark, rows)
    w = questions(spark, "List all boats", "List all boats of the table", "How many boats are there?", "How many mills in the table?", "How much is the total cost?")
    kw = spark.createDataFrame([(0, "d", "boats"), (1, "d", "boats"), (2, "d", "boats"), (3, "d", "geese")], "sample_idx int, doc_id string, keyword string")
    c = T.candidates(u, w, kw, Rt.matches(kw, u, "edge_id", "text")).cache()
    items = {(r.sample_idx, r.item_no): r.item for r in T.enumerate_items(c).collect()}
    assert [items[0, k] for k in (1, 2, 40)] == ["Item 1", "Figure 2", "Figure 40"] and (0, 41) not in items  # the first forty by rule
    counts = {r.sample_idx: (r.path, r.n) for r in T.global_count(w, c, kw.selectExpr("sample_idx", "1 as times"), spark.createDataFrame([("d", 9)], "doc_id string, total_pages int")).collect()}
    assert counts[2] == ("units", 40) and counts[3] == ("none", None) and counts[4][0] == "value"


@pytest.mark.parametrize("seed", range(3))
def test_keywords_against_brute_force(spark, seed):
    rng = random.Random(seed)
    alphabet = ["bridge", "bridges", "ostmühl", "brévent", "港口", "旧港口城", "12", "m0dern", "modern", "short-term", "a", "of", "new york"]
    texts = [("d" if i % 3 else "e", i, " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) or None) for i in range(40)]
    keys = [(i, rng.choice(["d", "e"]), k) for i, k in enumerate(["bridge", "ridge", "ostmühl", "港口", "12", "modern", "short-term", "new york", "york of", "zzz", "BRÉVENT", "a"] * 2)]
    u = spark.createDataFrame(texts, "doc_id string, block_id int, text string")
    kw = spark.createDataFrame([(i, d, k.lower()) for i, d, k in keys], "sample_idx int, doc_id string, k string").select("sample_idx", "doc_id", normalize_ocr(F.col("k")).alias("keyword"))
    fold = lambda t: (t or "").lower().replace("0", "o").replace("1", "l").replace("|", "l").replace("rn", "m")
    got = {(r.doc_id, r.keyword, r.block_id) for r in Rt.matches(kw, u, "block_id", "text").collect()}
    assert got == {(d, fold(k), i) for _, d, k in keys for e, i, t in texts if d == e and fold(k) in fold(t)}


def test_like_words_against_brute_force(spark):
    import difflib

    words = ["harbour", "harb0ur", "harbuor", "arbour", "bridge", "bridqe", "brid", "management", "managment", "abc", "abd", "zoo"]
    index = spark.createDataFrame([(w,) for w in words], "word string")
    keys = ["harbour", "bridge", "management", "abc"]
    got = {(r.keyword, r.word): round(r.likeness, 6) for r in Rt.like_words(spark.createDataFrame([(k,) for k in keys], "keyword string"), index).collect()}
    want = {}
    for k in keys:
        for w in words:
            r = 1.0 if k in w else difflib.SequenceMatcher(None, k, w).ratio() if len(k) > 3 else 0.0
            if r >= Rt.FUZZY:
                want[k, w] = round(r, 6)
    assert got == want


def test_likeness_arcs(spark):
    rows = [("d", 0, 0, "text", "the old bridge of the harbour", 0.0), ("d", 0, 1, "text", "the old bridge of the harbour", 10.0), ("d", 0, 2, "text", "zz", 20.0), ("d", 1, 3, "text", "the old bridge", 0.0), ("d", 0, 4, "text", None, 30.0)]
    b = spark.createDataFrame([(d, p, i, k, t, 0.0, y, 9.0, y + 5, 0.95) for d, p, i, k, t, y in rows], "doc_id string, page int, block_id int, type string, text string, x1 double, y1 double, x2 double, y2 double, rec_conf double")
    arcs = {(r.src, r.dst): r.weight for r in Si.similar_next(b).collect()}
    assert abs(arcs[0, 1] - 0.6) < 1e-9 and (0, 3) not in arcs and all(a < b for a, b in arcs)
    assert (0, 1) not in {(r.src, r.dst) for r in Si.similar_next(b, spark.createDataFrame([("d", 0, 0, 1)], "doc_id string, page int, src int, dst int")).collect()}
    titles = spark.createDataFrame([], "doc_id string, page int, block_id int, title_id int")
    assert {(r.src, r.dst) for r in Si.co_occurrence(b, titles).collect()} == {(0, 1)}
