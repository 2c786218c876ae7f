from quire.llm import scan_noise as S

BODY = "The northern bridge was opened before the harbour closed. Several boats carried timber along the canal without permits."
COLS = "doc_id string, block_id bigint, page int, bbox array<double>, block_type string, text string, rec_conf double, noise string"


def corpus():
    rows, k = [], 0
    for p in range(12):
        for i in range(4):
            rows.append(("d", k, p, [100.0, 200.0 + 100 * i, 1100.0, 280.0 + 100 * i], "text", BODY, 0.99, "clash"))
            k += 1
        rows.append(("d", k, p, [100.0, 40.0, 900.0, 70.0], "header" if p % 2 else "text", "Harbour Review 2004" if p != 5 else "Harb0ur Rcview 2004", 0.9, "clash"))
        rows.append(("d", k + 1, p, [100.0, 1550.0, 200.0, 1570.0], "footer", f"Page {p + 1}", 0.9, "clash"))
        k += 2
    rows.append(("d", 500, 0, [100.0, 300.0, 1000.0, 350.0], "title", "Harbour Review 2004", 0.9, "clash"))
    rows.append(("d", 501, 3, [100.0, 600.0, 1000.0, 650.0], "text", "The northern bri-\ndge was 0pened before\nHarbour Review 2004\nthe harbour closed.", 0.6, "clash"))
    rows.append(("d", 502, 3, [100.0, 700.0, 1000.0, 750.0], "text", "short- and long boats carried\nPage 4\ntimber along the canal.", 0.9, "clash"))
    rows += [("d", 503, 3, [600.0, 700.0, 640.0, 750.0], "text", "264", 0.9, "clash"), ("d", 504, 3, None, None, None, None, "clash"), ("d", 505, 3, None, "text", "", None, "clash"), ("d", 506, 2, None, "text", BODY, None, "clash")]
    return rows + rows[:3]


def test_kinds(spark):
    df = spark.createDataFrame(corpus(), COLS)
    got = {(r.block_id, r.noise) for r in S.noise(df).collect()}
    assert {x for x in got if x[0] >= 500} == {(501, "hyphen"), (501, "misread"), (501, "running_line"), (502, "page_number")}
    heads = {b for b, n in got if n == "running_line" and b < 500}
    assert len(heads) == 12 and len({b for b, n in got if n == "page_number" and b < 500}) == 12
    assert {b for b, n in got if n == "misread" and b < 500} <= heads
    assert S.noise(df.limit(0)).count() == 0


def test_repair(spark):
    got = {(r.block_id, r.paragraph_no): r.paragraph for r in S.repaired(spark.createDataFrame(corpus(), COLS)).collect()}
    assert got[(501, 0)] == "The northern bridge was opened before the harbour closed."
    assert got[(502, 0)] == "short- and long boats carried timber along the canal."
    assert (503, 0) in got and (504, 0) not in got


def test_decoder_and_paragraphs():
    dec = S.Decoder({"despite": 400, "bridge": 300, "modern": 90, "hafen": 60, "turm": 50, "cable": 40, "table": 45, "winner": 30})
    for seen, meant in (("clespite", "despite"), ("bridqe", "bridge"), ("rnodern", "modern"), ("br!dge", "bridge"), ("hafentunn", None), ("cable", None), ("b133", None), ("hafenturrn", "hafenturm"), ("wirmer", "winner")):
        assert dec.read(seen) == meant, seen
    assert S.paragraphs(["One line that goes", "on to its end.", "", "Another one."]) == ["One line that goes on to its end.", "Another one."]
    assert S.paragraphs([]) == [] and len(S.paragraphs(["word"] * 3000)) >= 1


def test_counts_grow_with_the_input():
    for times in (1, 100, 10_000):
        dec = S.Decoder({"percent": 2000 * times, "percenf": 22 * times, "short": 900 * times, "shortand": 3 * times, "and": 9000 * times, "thousand": 800 * times})
        assert S.decode("ten percenf more", 0.9, dec) == ("ten percent more", False, True), times
        assert not S.decode("short- and long", 0.9, dec)[1] and S.decode("thous- and", 0.9, dec)[1], times


def test_many_confusions():
    dec = S.Decoder({"modernization": 400, "dismemberment": 90, "bridge": 300})
    for seen, meant in (("rn0derni2ati0n", "modernization"), ("clisrnernberrnent", "dismemberment"), ("mast", None)):
        assert dec.read(seen) == meant, seen


def test_split_and_merged_words():
    words = {"the": 60000, "of": 30000, "was": 9000, "bridge": 300, "harbour": 200, "opened": 150, "modern": 90, "hafen": 60, "turm": 50, "in": 20000, "inhabitants": 40, "a": 30000, "long": 400, "along": 500, "quick": 300, "brown": 200, "annual": 150, "report": 400}
    dec = S.Decoder(words)
    for seen, meant, broken, misread in (
            ("thebridge was opened", "the bridge was opened", False, False), ("the bri dge was opened", "the bridge was opened", False, False),
            ("The har\nbour was opened", "The harbour was opened", True, False), ("ofthe har bour", "of the harbour", False, False),
            ("Thebr1dge was opened", "The bridge was opened", False, True), ("the rnod ern bridge", "the modern bridge", False, True),
            ("the in habitants", "the inhabitants", False, False), ("a long bridge in the harbour", None, False, False),
            ("annual re-\nport of the br1-\ndge", "annual report of the bridge", True, True), ("har-\nb our was opened", "harbour was opened", True, False), ("thequick brown", "the quick brown", False, False),
            ("ann ual report", "annual report", False, False), ("a long-\nharbour", "a long-harbour", True, False), ("long- harbour", None, False, False),
            ("hafenturm was opened", None, False, False), ("the bridge\nwas opened", None, False, False), ("the bridge's harbour", None, False, False)):
        assert S.decode(seen, 0.9, dec) == (meant or seen, broken, misread), seen


def test_the_path_decides():
    """Without joins, splits and confusions the stream stays as it is."""
    dec = S.Decoder({"the": 60000, "bridge": 300, "harbour": 200, "was": 900})
    seen = "thebridge was har bour br1dge bri-\ndge"
    assert S.decode(seen, 0.9, dec)[0] == "the bridge was harbour bridge bridge"
    dec.token, dec.joined, dec.hyphened = (lambda low, doubt: (dec.bits(low), None)), (lambda parts, doubt: None), (lambda a, b, line_end, doubt: None)
    assert S.decode(seen, 0.9, dec) == (seen, False, False)


def test_long_furniture_and_many_lines(spark):
    long = "Proceedings of the northern harbour review " * 6
    rows = [("d", p, p, [100.0, 40.0, 900.0, 70.0], "text", long, 0.9) for p in range(4)] + [("d", 90, 2, [100.0, 300.0, 900.0, 400.0], "text", "Boats carried timber.\n" + long + "\nalong the canal.", 0.9)]
    df = spark.createDataFrame(rows, "doc_id string, block_id bigint, page int, bbox array<double>, block_type string, text string, rec_conf double")
    assert {(r.block_id, r.noise) for r in S.noise(df).collect()} == {(k, "running_line") for k in (0, 1, 2, 3, 90)}
    assert S.paragraphs(["some words"] * 5000) == [" ".join(["some words"] * 5000)]
