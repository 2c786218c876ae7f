import random

from quire.llm import leakage as L

RNG = random.Random(9)
VOCAB = [f"{a}{b}" for a in ("ba", "co", "du", "fi", "gor", "hel", "jin", "ka", "lo", "mer") for b in ("ton", "rix", "vale", "mond", "sky", "tal", "wen", "dor", "lin", "pas")]


def passage(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n)).capitalize() + "."


ITEMS = [(i, passage(45) + (" Choose the best answer." if i % 2 else "")) for i in range(40)] + [(99, None), (98, "")]


def noisy(text, every=7):
    w = text.split()
    return " ".join("qqq" if i % every == 3 else x for i, x in enumerate(w))


def test_cases(spark):
    p = dict(ITEMS)
    words = p[1].rstrip(".").split()
    half = p[2].split()
    docs = [(0, passage(300)), (1, passage(50) + " " + p[0] + " " + passage(50)), (2, passage(9) + noisy(p[1]).upper()), (3, "> " + "\n> ".join(" ".join(words[5:24][i:i + 4]) for i in range(0, 19, 4))),
            (4, " ".join(words[:9])), (5, "Choose the best answer. " + passage(60)), (6, " ".join(half[:11]) + " " + passage(20) + " " + " ".join(half[11:23]) + " " + passage(15) + " " + " ".join(half[23:34]) + " zz " + " ".join(half[34:])),
            (7, None), (8, ""), (9, passage(30) + " " + p[0].replace(" ", " ").replace("o", "о")), (10, (passage(4000) + " ") * 3 + p[4]), (10, (p[4]))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, item_id string").withColumnRenamed("item_id", "note")
    items = spark.createDataFrame(ITEMS, "item_id bigint, passage string")
    rows = L.find_leaks(df, "doc_id", "text", items, "item_id", "passage").collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 0), (2, 1), (3, 1), (6, 2), (9, 0), (10, 4)}
    one = next(r for r in rows if r.doc_id == 1)
    assert dict(docs)[1][one.start_char:one.end_char] == p[0].rstrip(".")
    assert L.find_leaks(df.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert L.find_leaks(df, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_against_brute_force():
    items = [(i, L.words_of(t)) for i, t in ITEMS if t]
    auto, bits = L._automaton(items), L.information(items)
    for _ in range(60):
        k = RNG.randrange(len(items))
        n = RNG.choice([6, 8, 10, 18, 20, 30])
        at = RNG.randrange(len(items[k][1]) - n)
        w = L.words_of(passage(80)) + items[k][1][at:at + n] + L.words_of(passage(80))
        want = {k} if n >= 16 else set()
        assert {x[0] for x in L.leaks(w, items, auto, bits)} == want


def test_short_passages_leak_whole_or_not_at_all(spark):
    items = spark.createDataFrame([(1, "quarterly yields"), (2, "Zurbaran"), (3, None), (4, " ")], "item_id bigint, passage string")
    docs = spark.createDataFrame([(10, "The quarterly, yields rose."), (11, "quarterly rose yields"), (12, "By ZURBARAN.")], "doc_id bigint, text string")
    rows = L.find_leaks(docs, "doc_id", "text", items, "item_id", "passage").collect()
    assert {(r.doc_id, r.item_id, r.matched_words) for r in rows} == {(10, 1, 2), (12, 2, 1)}


def test_passages_without_stock_sentences(spark):
    items = spark.createDataFrame([(1, "One of its own. Stock here."), (2, "Another one. Stock here."), (3, "Shared by both. Whole."), (4, "Shared by both. Whole."), (5, "Stock here.")], "item_id bigint, passage string")
    got = {r.i: r.words for r in L.passages(items, "item_id", "passage").collect()}
    assert got == {1: ["one", "of", "its", "own"], 2: ["another", "one"], 3: ["shared", "by", "both", "whole"], 4: ["shared", "by", "both", "whole"]}


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ITEMS", 3)
    items = spark.createDataFrame([(i, f"{passage(24)} ") for i in range(8)], "item_id bigint, passage string")
    docs = items.selectExpr("item_id + 100 as doc_id", "passage as text")
    assert {(r.doc_id - 100, r.item_id) for r in L.find_leaks(docs, "doc_id", "text", items, "item_id", "passage").collect()} == {(i, i) for i in range(8)}


def test_word_offsets_agree():
    text = "Exam-\nple of “Sand​ö”, 12.5 km — 漢字 and more"
    assert len(L.word_offsets(text)) == len(L.words_of(text))


def replaced(words, k):
    """``words`` with ``k`` of the inner ones replaced."""
    out = list(words)
    for i in RNG.sample(range(1, len(words) - 1), k):
        out[i] = "qqq"
    return out


def test_short_quotations_with_replaced_words():
    items = [(i, L.words_of(t)) for i, t in ITEMS if t]
    auto, bits = L._automaton(items), L.information(items)
    for n in (16, 17, 18, 19, 20, 21):
        for k in range(40):
            for _ in range(3):
                at = RNG.randrange(1, 20)
                body = items[k][1][at:at + n]
                body = body[:5] + replaced(body[5:], n // 7)  # a matching run for the automaton
                w = L.words_of(passage(30)) + body + L.words_of(passage(30))
                assert k in {x[0] for x in L.leaks(w, items, auto, bits)}, (n, k)


def test_stock_frames_are_no_quotations():
    frame = "when the {} was not yet {} all of the {} had to wait for the next turn".split()
    fill = lambda: [RNG.choice(VOCAB) if x == "{}" else x for x in frame]
    items = [(i, L.words_of(passage(20)) + fill() + L.words_of(passage(20))) for i in range(30)]
    auto, bits = L._automaton(items), L.information(items)
    for i in range(30):
        w = L.words_of(passage(30)) + fill() + L.words_of(passage(30))
        assert not L.leaks(w, items, auto, bits)
        body = items[i][1][14:32]
        w = L.words_of(passage(30)) + body[:4] + replaced(body[4:], 2) + L.words_of(passage(30))
        assert i in {x[0] for x in L.leaks(w, items, auto, bits)}


def test_pieces_far_apart_with_replaced_words():
    items = [(i, L.words_of(passage(40))) for i in range(30)]
    auto, bits = L._automaton(items), L.information(items)
    for k in range(10):
        w = L.words_of(passage(50))
        for at in (20, 0, 30, 10):
            piece = list(items[k][1][at:at + 10])
            piece[4] = "qqq"
            w += piece + L.words_of(passage(150))
        assert [x[0] for x in L.leaks(w, items, auto, bits)] == [k]
    assert not L.leaks(w[:w.index("qqq") + 300], items, auto, bits)


def test_chains_of_many_runs():
    p = [f"w{i}" for i in range(30)]
    # Every word of the frame stands on many diagonals before the quotation.
    runs = [(a, a + 1, d) for a in range(0, 12) for d in range(100, 700, 3)] + [(0, 4, 7), (6, 10, 7), (12, 16, 7)]
    sums = [float(i) for i in range(31)]
    assert any(c[:5] == (0, 16, 15, 7, 23) for c in L._chains(runs, sums, [0.0] * 31))
    # More runs than a small fixed number, in a text of many repetitions.
    w = (p[:5] + ["x"]) * 800 + p[:7] + ["x"] + p[8:12] + ["y"] + p[13:18] + ["x"] * 9
    items = [(0, p)]
    assert L.leaks(w, items, L._automaton(items), L.information(items))
