import unicodedata

from quire.llm.lookalike import canonical, changed, one_form

KEPT = ["plain", "", "Этот порт важнее, чем сад.", "根据图6，有道路。", "β = 0.7", "37 m²", "½", "“quoted” – so", "Sandö é", "a\r\nb", "№ 5", "со", "x" * 20000]
FIXED = {"ｗｉｄｅ １２": "wide 12", "été": "été", "in​visible": "invisible", "a b　c": "a b c", "Ѕandö ѕold": "Sandö sold", "The соѕt": "The cost",
         "Kelvin": "Kelvin", "ofﬁce": "office", "Über": "Über", "﻿x": "x"}


def test_forms(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*KEPT, *FIXED, *FIXED, None])]
    df = spark.createDataFrame(rows, "id int, text string, _class string")
    got = {r.id: r.canonical for r in canonical(df, "text").collect()}
    for i, t, _ in rows:
        assert got[i] == FIXED.get(t, t), ascii(t)
    assert sorted(r.id for r in changed(df, "text").collect()) == [i for i, t, _ in rows if t in FIXED]
    assert canonical(df.limit(0), "text").count() == 0


def test_running_twice_changes_nothing(spark):
    df = spark.createDataFrame([(t,) for t in [*KEPT, *FIXED]], "text string")
    once = canonical(df, "text").selectExpr("canonical as text")
    assert changed(once, "text").count() == 0


def test_equal_texts_get_equal_forms(spark):
    df = spark.createDataFrame([("Brévent",), ("Brévent",), ("Bre​́vent",), ("Brévent",), ("Brevent",)], "text string")
    assert sorted({r.canonical for r in canonical(df, "text").collect()}) == ["Brevent", "Brévent"]


def test_kernel_form():
    assert one_form("Ѕandö") == "Sandö" and one_form("Этот сад") == "Этот сад" and one_form(unicodedata.normalize("NFD", "é")) == "é"


def test_the_class_gives_the_form(spark):
    """A regular member is chosen over the class, where the text alone would not tell: an accent below that is not composed by rule."""
    df = spark.createDataFrame([(1, "\u1e96azar"), (2, "h\u0331azar"), (3, "h\u200b\u0331azar")], "id int, text string")
    got = {r.id: r.canonical for r in canonical(df, "text").collect()}
    assert got[1] == got[2] == got[3] == "\u1e96azar"
    alone = {r.id: r.canonical for r in canonical(df.filter("id > 1"), "text").collect()}
    assert alone[2] == alone[3] == "h\u0331azar"


def test_regular_texts_equal_under_the_collation(spark):
    df = spark.createDataFrame([(1, "a\x01b"), (2, "ab"), (3, "a\u200bb"), (4, None), (5, "")], "id int, text string")
    got = {r.id: r.canonical for r in canonical(df, "text").collect()}
    assert got[1] == got[2] == got[3] and got[4] is None and got[5] == ""
    assert sorted(r.id for r in changed(df, "text").collect()) == sorted(i for i, t in ((1, "a\x01b"), (2, "ab"), (3, "a\u200bb")) if got[i] != t)
