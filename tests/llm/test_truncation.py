from pyspark.sql import functions as F

from quire.llm.truncation import open_marks, source_report, with_verdict

WHOLE = ["<think>\nlook at (image 2) first.\n</think>\n<answer>12</answer>", "Some reasoning.\nFinal answer: Sandö", "Reasoning.\n\nAnswer: ['a', 'b', 'c', 'd', 'e', 'f']", "<answer></answer>",
         "x\nAnswer: The bridge was opened in 1974.", "x\nAnswer: Which bridge of Corvane shows the largest change"]
CUT = ["<think>\nlook at (image 2) fi", "<think>a</think>\n<answer>The bridge was op", "Reasoning that never comes to an answer part.", "x\nAnswer: The bridge was opened in the year of", "x\nAnswer:", "<answer>The bridge was op...",
       "<answer>The bridge …", "x <answer>исче�", "x\nFinal answer: ['a', 'b"]


def frame(spark, texts):
    return spark.createDataFrame([(i, "s", t, "Which bridge of Corvane shows the largest change?", "clash") for i, t in enumerate(texts)], "id int, run_source string, prediction string, question string, n string")


def test_verdicts(spark):
    df = frame(spark, WHOLE * 3 + CUT + [None])
    got = {r.id: r.cut for r in with_verdict(df, "prediction", "run_source", "question").collect()}
    for i, t in enumerate(WHOLE * 3 + CUT + [None]):
        assert got[i] == (None if t is None else t in CUT), repr(t)
    rep = source_report(with_verdict(df, "prediction", "run_source", "question"), "run_source").first()
    assert (rep.predictions, rep.cut_predictions) == (len(WHOLE) * 3 + len(CUT), len(CUT))
    assert with_verdict(df.limit(0), "prediction", "run_source").count() == 0


def test_limits_are_learned_by_source(spark):
    texts = ["<answer>ok " + "a" * k + "</answer>" for k in range(60, 400)] + [("reasoning " * 40)[:280] + "\nAnswer: Sand" for _ in range(30)]
    got = [r.cut for r in with_verdict(frame(spark, texts), "prediction", "run_source").orderBy("id").collect()]
    assert not any(got[:340]) and all(got[340:])


def test_automaton(spark):
    for text, left in (("(a [b] c", "("), ("<think>(x", "T("), ("<think>(x</think>", ""), ('say "so', '"'), ("a) b", ""), ("", ""), ("“ [ ”", ""), ("(x\nAnswer: (y", "L("), ("<answer>(x</answer>", "C"), ("<think>(\nAnswer: y", "TL"), ("Answer: a\n**Final answer:** [b]", "L"), ("no answer: here", "")):
        assert spark.createDataFrame([(text,)], "t string").select(open_marks(F.col("t")).alias("o")).first().o == left


def test_the_automaton_decides(spark, monkeypatch):
    """With an empty stack in its place the verdicts differ, on cut and on whole texts."""
    from quire.llm import truncation

    df = frame(spark, WHOLE * 3 + CUT)
    want = [r.cut for r in with_verdict(df, "prediction", "run_source", "question").orderBy("id").collect()]
    monkeypatch.setattr(truncation, "open_marks", lambda text: F.when(text.isNotNull(), F.lit("")))
    got = [r.cut for r in with_verdict(df, "prediction", "run_source", "question").orderBy("id").collect()]
    assert sum(a != b for a, b in zip(want, got)) >= 5
