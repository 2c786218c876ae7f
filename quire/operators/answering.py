"""From questions to answers: prompts, page caps, supplements, subgraphs, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import models
from quire.functions.text import answer_after_thinking, asks_arithmetic, asks_count, asks_pages, query_scope

PROMPTS = {
    "answer": "Use only the evidence below. Put the answer between <answer> and </answer>.\nEvidence:\n%s\nQuestion: %s",
    "count": "Count what the question asks for in the evidence below and give one number between <answer> and </answer>.\nEvidence:\n%s\nQuestion: %s",
    "enumerate": "List every item the question asks for, as a JSON array between <answer> and </answer>.\nEvidence:\n%s\nQuestion: %s",
    "judge": "Does the second answer say the same as the first? Reply 1 or 0.\nFirst: %s\nSecond: %s",
}


def prompt(kind: str, *parts: Column) -> Column:
    return F.format_string(PROMPTS[kind], *[F.coalesce(p, F.lit("")) for p in parts])


def intents(samples: DataFrame) -> DataFrame:
    """Intent of each question by its cues: type, scope, whether it wants wider input."""
    q = F.col("question")
    kind = F.when(F.lower(q).rlike("^list"), "enumerate").when(F.coalesce(asks_count(q), F.lit(False)) | F.coalesce(asks_pages(q), F.lit(False)), "count").when(
        F.lower(q).rlike("differ|change between|compare"), "compare").otherwise("locate")
    widen = kind.isin("count", "compare") & F.coalesce(asks_arithmetic(q), F.lit(False))
    return samples.select("sample_idx", "doc_id", "question", kind.alias("intent_type"), query_scope(q).alias("scope"), widen.alias("widen"))


def intent_summary(kind: Column, scope: Column, keywords: Column) -> Column:
    """One line: intent, scope, first three keywords."""
    shown = F.array_join(F.slice(keywords, 1, 3), ", ")
    return F.concat_ws(" | ", kind, scope, F.when(F.size(keywords) > 3, F.concat(shown, F.lit("..."))).otherwise(shown))


def pages_by_keywords(keywords: DataFrame, found: DataFrame, blocks: DataFrame, k: int = 3) -> DataFrame:
    """Best pages of each question: one point for each keyword a block holds, two more in titles and
    short texts. ``found``: doc_id, keyword, block_id; ``blocks``: doc_id, block_id, page, type, text."""
    strong = F.coalesce(F.col("type") == "title", F.lit(False)) | (F.length("text") < 100)
    points = found.join(blocks.select("doc_id", "block_id", "page", F.when(strong, 3).otherwise(1).alias("points")), ["doc_id", "block_id"])
    a_page = points.groupBy("doc_id", "keyword", "page").agg(F.sum("points").alias("points"))
    s = keywords.join(a_page, ["doc_id", "keyword"]).groupBy("sample_idx", "page").agg(F.sum("points").alias("points"))
    w = Window.partitionBy("sample_idx").orderBy(F.col("points").desc(), "page")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def image_caps(images: DataFrame, a_page: int, overall: int) -> DataFrame:
    """At most ``a_page`` images of a page and ``overall`` of a question, in rank order."""
    p = Window.partitionBy("sample_idx", "page").orderBy("rank")
    x = images.withColumn("_p", F.row_number().over(p)).filter(F.col("_p") <= a_page)
    o = Window.partitionBy("sample_idx").orderBy("rank", "page")
    return x.withColumn("place", F.row_number().over(o)).filter(F.col("place") <= overall).drop("_p")


def supplement_pages(retrieved: DataFrame, chosen: DataFrame, k: int = 3) -> DataFrame:
    """The first k retrieved pages of each question that no chosen unit shows."""
    new = retrieved.join(chosen.select("sample_idx", "page").distinct(), ["sample_idx", "page"], "left_anti")
    w = Window.partitionBy("sample_idx").orderBy("place", "page")
    return new.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("sample_idx", "page", "place")


def by_anchor(candidates: DataFrame) -> DataFrame:
    """Candidates clustered by anchor: best first inside a cluster, clusters in order of arrival."""
    c = candidates.withColumn("arrival", F.min("seq").over(Window.partitionBy("sample_idx", "anchor")))
    w = Window.partitionBy("sample_idx").orderBy("arrival", F.col("score").desc(), "seq")
    return c.withColumn("place", F.row_number().over(w)).drop("arrival")


def supporting_subgraph(scores: DataFrame, arcs: DataFrame, by: list[str], k: int = 3, least: float = 0.2) -> DataFrame:
    """Top k nodes of each graph by score, grown by one hop, pruned of nodes under ``least``."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "block_id")
    seeds = scores.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select(*by, "block_id")
    both = arcs.select(*by, F.col("src").alias("block_id"), F.col("dst").alias("other")).unionByName(arcs.select(*by, F.col("dst").alias("block_id"), F.col("src").alias("other")))
    grown = both.join(seeds, [*by, "block_id"]).select(*by, F.col("other").alias("block_id"))
    kept = seeds.withColumn("seed", F.lit(True)).unionByName(grown.withColumn("seed", F.lit(False))).groupBy(*by, "block_id").agg(F.max("seed").alias("seed"))
    return kept.join(scores, [*by, "block_id"]).filter(F.col("seed") | (F.col("score") >= least)).select(*by, "block_id", "seed", "score")


def answer(samples: DataFrame, packed: DataFrame, texts: DataFrame, config: models.ModelConfig | None = None) -> DataFrame:
    """One answer a question: its packed units' texts become the evidence of a prompt by intent.

    ``packed``: sample_idx, place, unit; ``texts``: sample_idx, unit, text. A question
    without units is asked without evidence. All questions are one DataFrame.
    """
    ev = packed.join(texts, ["sample_idx", "unit"]).groupBy("sample_idx").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("e"))
    ev = ev.select("sample_idx", F.array_join(F.transform("e", lambda x: x["text"]), "\n").alias("evidence"))
    i = intents(samples).join(ev, "sample_idx", "left")
    text = F.when(F.col("intent_type") == "count", prompt("count", F.col("evidence"), F.col("question"))).when(
        F.col("intent_type") == "enumerate", prompt("enumerate", F.col("evidence"), F.col("question"))).otherwise(prompt("answer", F.col("evidence"), F.col("question")))
    none = F.array().cast("array<string>")
    asked = i.withColumn("messages", models.messages(text, none, none)).select("sample_idx", "intent_type", "messages")
    return models.predict(asked, config or models.ModelConfig()).select("sample_idx", "intent_type", "status", answer_after_thinking(F.col("answer")).alias("answer"), "prompt_tokens")
