"""Evaluation: results joined with gold samples, accuracies by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import scores as S
from quire.functions.text import answer_after_thinking, first_text, is_oom, normalize_answer


def compact_results(runs: DataFrame) -> DataFrame:
    """Compact result rows; the prediction is the first text that is neither null nor empty."""
    return runs.select("result_id", "sample_idx", "q_uid", "doc_id", "question", "ground_truth",
                       first_text(F.col("predicted_answer"), F.col("prediction")).alias("answer"), "images_count", "status", "error", "run_source").distinct()


def _document(c: str = "doc_id") -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _exact(c: str = "question") -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _normal(c: str = "question") -> Column:
    return normalize_answer(F.coalesce(c, F.lit("")))


def sidecar(samples: DataFrame, key=_exact, blank: bool = True) -> DataFrame:
    """Gold samples by document and question (``key`` makes it comparable): ``_doc, _key, side_sample,
    side_answer, answer_format, n_samples``. Of several the last by number wins; ``blank=False``
    leaves out empty documents and questions."""
    s = samples.select(_document().alias("_doc"), key("question").alias("_key"), "sample_idx", "answer", "answer_format")
    s = s if blank else s.filter("_doc <> '' and _key <> ''")
    last = F.max(F.struct("sample_idx", "answer", "answer_format")).alias("s")
    return s.groupBy("_doc", "_key").agg(last, F.count_distinct("sample_idx").alias("n_samples")).select(
        "_doc", "_key", F.col("s.sample_idx").alias("side_sample"), F.col("s.answer").alias("side_answer"), F.col("s.answer_format").alias("answer_format"), "n_samples")


def with_sidecar(results: DataFrame, samples: DataFrame, normal: bool = False) -> DataFrame:
    """Results with their sample's columns, found by the exact trimmed question, or by its normal
    form (then empty ones match nothing); nulls where there is none."""
    key = _normal if normal else _exact
    r = results.withColumn("_doc", _document()).withColumn("_key", key("question"))
    return r.join(sidecar(samples, key, blank=not normal), ["_doc", "_key"], "left").drop("_doc", "_key")


def contains_accuracy(runs: DataFrame, samples: DataFrame, *by: str) -> DataFrame:
    """Share of results whose answer, behind its thinking, holds the gold answer, by the rule of ``smart_match``.

    Memory failures are told by the prediction and left out of the valid ones;
    rows without an answer or a gold answer are valid but not evaluated, hence
    no matches. The result's own gold answer wins over the sample's; a null
    prediction is replaced by the extracted answer.
    """
    j = with_sidecar(runs, samples, normal=True)
    raw = F.coalesce("prediction", "predicted_answer", F.lit(""))
    gold, answer = F.coalesce("ground_truth", "side_answer", F.lit("")), answer_after_thinking(raw)
    oom = is_oom(raw)
    done = ~oom & (S.strip(gold) != "") & (answer != "")
    hit = done & S.smart_match(gold, answer)
    out = j.groupBy(*by).agg(F.count("*").alias("records"), F.count_if(done).alias("evaluated"), F.count_if(oom).alias("oom_errors"), F.count_if(hit).alias("matches"))
    valid = F.col("records") - F.col("oom_errors")
    return out.withColumn("valid", valid).withColumn("accuracy", F.round(F.when(valid > 0, F.col("matches") / valid).otherwise(0.0), 6))


def typed_accuracy(runs: DataFrame, samples: DataFrame, *by: str) -> DataFrame:
    """Mean typed score of the results of status null or ``success`` that have a format; the others are skipped.
    The sample's gold answer wins over the result's own."""
    j = with_sidecar(runs, samples)
    gold = F.coalesce("side_answer", "ground_truth", F.lit(""))
    done = F.coalesce(F.col("status") == "success", F.lit(True)) & (F.coalesce("answer_format", F.lit("")) != "")
    s = F.when(done, S.typed_score(gold, F.coalesce("predicted_answer", "prediction", F.lit("")), F.col("answer_format")))
    return j.groupBy(*by).agg(F.count("*").alias("records"), F.count(s).alias("evaluated"), F.round(F.coalesce(F.avg(s), F.lit(0.0)), 6).alias("score"))


def judge_accuracy(judged: DataFrame, score: str, *by: str) -> DataFrame:
    """Mean of whole-number judge scores; anything else is skipped."""
    s = F.col(score).cast("string").try_cast("int")
    return judged.groupBy(*by).agg(F.count(s).alias("n"), F.round(F.coalesce(F.avg(s), F.lit(0.0)), 6).alias("accuracy"))


def metric_mode(dataset: str, has_samples: bool, has_judge: bool) -> str:
    """Which accuracy a set of results is measured by; raises where none can be inferred."""
    if dataset == "mmlb" and has_samples:
        return "contains"
    if dataset == "docbench" and has_judge:
        return "judge"
    if dataset == "ldu" and has_samples:
        return "typed"
    raise ValueError("no metric: contains and typed scores need samples, judge scores need judged results")


def evaluate(dataset: str, runs: DataFrame, samples: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """One summary row of a data set's results, by the metric inferred or named."""
    mode = metric_mode(dataset, samples is not None, "judge_score" in runs.columns) if mode == "auto" else mode
    out = (contains_accuracy(runs, samples) if mode == "contains" else typed_accuracy(runs, samples) if mode == "typed" else judge_accuracy(runs, "judge_score"))
    return out.withColumn("dataset", F.lit(dataset)).withColumn("metric", F.lit(mode))
