import pandas as pd
import pytest

from quire.llm import pairs

SOUND = ["12", "Merrow Harbour Trust", "The bridge was opened in 1974.", "['a', 'b']", "The section “Le vieux port” of Corvane.", "63.0 percent", "It was unable to recover after the mill closed.",
         "The crews cannot enter the yard without a permit.", "Sorry Lane, next to the mill.", "Many boats left the harbour before noon, and few came back."]
QUESTIONS = ["Which bridge of Corvane shows the largest change between 1977 and 2003?", "According to Chart 12, what share of boats in Sandö use the canal?", "Welche Brücke in Corvane wurde zuerst geöffnet und später verkauft?",
             "How many boats did the harbour record in 2004 for the old mill?"]


@pytest.fixture(scope="module")
def model():
    german = ["Die Brücke in Corvane wurde im Jahr 1974 geöffnet und später verkauft.", "Insgesamt haben 12 Boote den Hafen noch nicht verlassen.", "Der alte Hafen ist für die Boote wichtiger als der Kanal."]
    rows = [(q, a) for i in range(60) for q in QUESTIONS[:2] + QUESTIONS[3:] for a in SOUND] + [(QUESTIONS[2], g) for g in german * 60]
    return pairs.fit(pd.DataFrame(rows, columns=["question", "answer"]))


def test_held_out_accuracy(model):
    assert all(f > 0.9 for f in model["held_out_f1"].values()), model["held_out_f1"]


@pytest.mark.parametrize("question, answer, truth, want", [
    (QUESTIONS[0], None, "x", "empty"), (QUESTIONS[0], " ​ ", "x", "empty"), (QUESTIONS[0], "N/A", "x", "empty"), (QUESTIONS[0], "<answer></answer>", "x", "empty"),
    (QUESTIONS[0], QUESTIONS[0], "x", "copy"), (QUESTIONS[0], QUESTIONS[0].upper(), "x", "copy"), (QUESTIONS[1], "what share of boats in Sandö use the canal?", "x", "copy"),
    (QUESTIONS[0], QUESTIONS[0] + "\nAnswer:", "x", "copy"), (QUESTIONS[1], QUESTIONS[1][:-1] + " is 12.", "x", None),
    (QUESTIONS[0], "I'm sorry, but I cannot determine this from the given images.", "x", "refusal"), (QUESTIONS[0], "I do not know.", None, "refusal"),
    (QUESTIONS[0], "The question cannot be answered from the document.", "Not answerable", None), (QUESTIONS[0], "Many boats left the harbour before noon, and few cam", "x", "truncated"),
    (QUESTIONS[0], "Die Brücke in Corvane wurde im Jahr 1974 geöffnet und später verkauft.", "x", "other_language"), (QUESTIONS[2], "The bridge was opened in 1974 before the mill closed.", "x", "other_language"),
    *[(QUESTIONS[0], a, "x", None) for a in SOUND]])
def test_decisions(model, question, answer, truth, want):
    assert pairs.decide(model, [question], [answer], [truth]) == [want]


def test_frames(spark):
    cols = "result_id bigint, question string, predicted_answer string, ground_truth string, status string, defect string"
    rows = [(i, QUESTIONS[i % 2], SOUND[i % len(SOUND)], "x", "success", "clash") for i in range(200)]
    rows += [(900, QUESTIONS[0], "", "x", " SUCCESS ", "c"), (900, QUESTIONS[0], "", "x", " SUCCESS ", "c"), (901, QUESTIONS[0], None, None, None, "c"), (902, QUESTIONS[0], "", "x", "error", "c"), (903, None, "", "x", "success", "c"),
             (904, QUESTIONS[0], "The boats " * 5000, "x", "success", "c")]
    df = spark.createDataFrame(rows, cols)
    got = {(r.result_id, r.defect) for r in pairs.defects(df, "result_id", "question", "predicted_answer", "ground_truth", "status").collect()}
    assert {(900, "empty"), (901, "empty"), (903, "empty")} <= got and not any(k == 902 for k, _ in got)
    assert pairs.defects(df.limit(0), "result_id", "question", "predicted_answer", "ground_truth", "status").count() == 0


def test_grams_of_the_whole_answer():
    from quire.llm.pairs import describe
    long = " ".join(["the harbour was opened"] * 20)
    grams = describe("What happened?", f"{long} and I cannot determine this from the pages. The end.")[0]
    other = describe("What happened?", f"{long} and boats carried timber along the canal. The end.")[0]
    assert sorted(grams) != sorted(other)


def test_the_classifier_decides(model):
    """Without its weights no pair is defective, and the n-grams take part: unseen wording of a refusal is weighed by them."""
    import numpy as np

    asked = [QUESTIONS[0]] * 4
    answers = ["I am unable to determine this from the images.", QUESTIONS[0], "Many boats left the harbour before noon, and few cam", "N/A"]
    assert pairs.decide(model, asked, answers, [None] * 4) == ["refusal", "copy", "truncated", "empty"]
    off = dict(model, dense=np.zeros_like(model["dense"]), grams=np.zeros_like(model["grams"]), threshold=np.ones(len(pairs.LABELS)))
    assert pairs.decide(off, asked, answers, [None] * 4) == [None] * 4
    bare = dict(model, grams=np.zeros_like(model["grams"]))
    full, less = (pairs.logits(m, *pairs.features(asked, answers)) for m in (model, bare))
    assert np.abs(full - less).max() > 0.1
