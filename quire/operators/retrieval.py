"""Retrieval over document units: keyword scores with document frequencies, filters that fall
back, routing, page scores, result caps.

Keywords meet units through an inverted index of their words: a keyword is first
matched with the vocabulary (by runs of three characters), and only the units
that have a matching word are met, never all units of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import Likeness, normalize_ocr
from quire.session import cut

WORD = r"[\p{L}\p{M}\p{N}]+"
GRAM = 3  # characters by which keywords find words
FUZZY = 0.85


def keywords(samples: DataFrame, fold=normalize_ocr) -> DataFrame:
    """``sample_idx, doc_id, keyword`` of each question: its key list, else the words of its query,
    folded as texts are, without signs around them."""
    raw = F.coalesce(F.nullif(F.trim("retrieval_key"), F.lit("")), F.translate(F.col("question"), " ", ","))
    s = samples.select("sample_idx", "doc_id", F.explode(F.split(raw, ",")).alias("k"))
    s = s.select("sample_idx", "doc_id", F.regexp_replace(fold(F.col("k")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("keyword"))
    return s.filter(F.length("keyword") > 1).distinct()


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _grams(word: Column) -> Column:
    """All runs of one to three characters."""
    n = F.length(word)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.array(*[word.substr(i, F.lit(k)) for k in range(1, GRAM + 1)]))))


def index_words(units: DataFrame, key: str, text: str, fold=normalize_ocr) -> DataFrame:
    """Inverted index ``doc_id, word, key`` of the units' folded texts."""
    return units.select("doc_id", key, F.explode(_words(fold(F.coalesce(text, F.lit(""))))).alias("word")).distinct()


def held_in(probes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``probe, word``: the words of a vocabulary that hold each probe (distinct on both sides)."""
    p = probes.withColumn("gram", F.substring("probe", 1, GRAM))
    v = vocabulary.select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    return p.join(v, "gram").filter(F.contains("word", F.col("probe"))).select("probe", "word")


def matches(kw: DataFrame, units: DataFrame, key: str, text: str, fold=normalize_ocr) -> DataFrame:
    """``doc_id, keyword, key`` of the units whose folded text holds a keyword of a question on their document.

    A keyword of several words, or with signs inside, is looked for by its
    longest word and then compared with the text. Null documents, keywords and
    texts match nothing; a unit counts once a keyword.
    """
    asked = kw.select("doc_id", "keyword").distinct()
    longest = F.element_at(F.array_sort(F.transform(_words(F.col("keyword")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    asked = cut(asked.withColumn("probe", longest).filter("probe is not null"))
    index = cut(index_words(units, key, text, fold))
    words = held_in(asked.select("probe").distinct(), index.select("word").distinct())
    hit = asked.join(words, "probe").join(index, ["doc_id", "word"]).select("doc_id", "keyword", "probe", key).distinct()
    whole = hit.filter("keyword = probe").select("doc_id", "keyword", key)
    texts = units.select("doc_id", key, fold(F.coalesce(text, F.lit(""))).alias("_text"))
    part = hit.filter("keyword <> probe").join(texts, ["doc_id", key]).filter(F.contains("_text", F.col("keyword"))).select("doc_id", "keyword", key).distinct()
    return cut(whole.unionByName(part))


def like_words(kw: DataFrame, index: DataFrame, least: float = FUZZY) -> DataFrame:
    """``keyword, word, likeness``: words of the index like a keyword of one word, or holding it (likeness 1).

    Candidates share a run of three characters and have lengths and an edit
    distance that allow the likeness; what they share is then measured. Words
    of three characters or fewer must be equal or held.
    """
    k = kw.select("keyword").distinct().filter(F.size(_words(F.col("keyword"))) == 1)
    v = index.select("word").distinct()
    held = held_in(k.select(F.col("keyword").alias("probe")), v).select(F.col("probe").alias("keyword"), "word", F.lit(1.0).alias("likeness"))
    n = F.length("keyword")
    # 2 * shorter / (sum of lengths) bounds the likeness: only words of fitting length are met.
    sizes = F.sequence(F.ceil(n * least / (2 - least)).cast("int"), F.floor(n * (2 - least) / least).cast("int"))
    a = k.filter(n > 3).withColumn("size", F.explode(sizes)).withColumn("gram", F.explode(F.filter(_grams(F.col("keyword")), lambda g: F.length(g) == GRAM)))
    b = v.withColumn("size", F.length("word")).withColumn("gram", F.explode(F.filter(_grams(F.col("word")), lambda g: F.length(g) == GRAM)))
    near = a.join(b, ["size", "gram"]).select("keyword", "word").distinct().filter(~F.contains("word", F.col("keyword")))
    near = near.filter(F.levenshtein("keyword", "word") <= (1 - least) * (n + F.length("word")))

    def measure(batches):
        import pyarrow as pa

        alike = Likeness()
        for x in batches:
            ratio = pa.array([alike(p, q) for p, q in zip(x.column(0).to_pylist(), x.column(1).to_pylist())], pa.float64())
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), ratio], names=["keyword", "word", "likeness"])

    found = near.mapInArrow(measure, "keyword string, word string, likeness double").filter(F.col("likeness") >= least)
    return held.unionByName(found)


def idf(kw: DataFrame, found: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Weight of each keyword of a question: ln((N+1)/(df+1)) over its document's units, ln(N+1)
    where no unit has it, 1 where there are no units; then divided by the question's largest.
    ``found``: doc_id, keyword and unit, as ``matches`` gives them."""
    df = found.groupBy("doc_id", "keyword").agg(F.count_distinct(key).alias("df"))
    n = units.select("doc_id", key).distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    j = kw.join(n, "doc_id", "left").join(df, ["doc_id", "keyword"], "left")
    w = F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).when(F.col("df").isNull(), F.ln(F.col("n") + 1)).otherwise(F.ln((F.col("n") + 1) / (F.col("df") + 1)))
    j = j.withColumn("w", w)
    top = F.max("w").over(Window.partitionBy("sample_idx"))
    return j.select("sample_idx", "doc_id", "keyword", F.coalesce("n", F.lit(0)).alias("units"), F.coalesce("df", F.lit(0)).alias("df"), F.when(top > 0, F.col("w") / top).otherwise(F.col("w")).alias("idf"))


def keyword_scores(weights: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Score of each unit that holds a keyword: share of the question's weight it covers, and of its
    keywords. ``found`` may have a ``strength`` from 0 to 1 of each match."""
    total = weights.groupBy("sample_idx").agg(F.sum("idf").alias("all_idf"), F.count("*").alias("all_keywords"))
    strength = F.col("strength") if "strength" in found.columns else F.lit(1.0)
    hit = weights.join(found.withColumn("_s", strength), ["doc_id", "keyword"])
    s = hit.groupBy("sample_idx", "doc_id", key).agg(F.sum(F.col("idf") * F.col("_s")).alias("got"), F.count("*").alias("matched"))
    return s.join(total, "sample_idx").select("sample_idx", "doc_id", key, F.round(F.when(F.col("all_idf") > 0, F.col("got") / F.col("all_idf")).otherwise(0.0), 9).alias("score"), "matched",
                                              F.round(F.col("matched") / F.col("all_keywords"), 9).alias("coverage"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keep_or_all(candidates: DataFrame, by: list[str], keep: Column) -> DataFrame:
    """Filter with fallback: the candidates of each group that ``keep`` allows, or all of them where
    it allows none; ``fell_back`` tells which. Null counts as not allowed."""
    c = candidates.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    c = c.withColumn("fell_back", ~F.max("_keep").over(Window.partitionBy(*by)))
    return c.filter(F.col("_keep") | F.col("fell_back")).drop("_keep")


def page_scores(samples: DataFrame) -> DataFrame:
    """Retrieved pages with rank-decayed scores: 1 for the first, never under 0.1."""
    p = samples.select("sample_idx", F.size("image_top_10_question").alias("n"), F.posexplode("image_top_10_question").alias("place", "page"))
    return p.select("sample_idx", "page", "place", F.greatest(F.lit(0.1), 1.0 - F.col("place") / F.col("n")).alias("score"))


def user_pages(samples: DataFrame) -> DataFrame:
    """``sample_idx, doc_id, page``: 0-based pages named in the evidence field."""
    nums = F.regexp_extract_all(F.coalesce("evidence_pages", F.lit("")), F.lit(r"[0-9]{1,6}"), F.lit(0))
    return samples.select("sample_idx", "doc_id", F.explode(F.array_distinct(nums)).alias("p")).select("sample_idx", "doc_id", (F.col("p").cast("int") - 1).alias("page")).filter("page >= 0").distinct()


def merge_tools(results: DataFrame) -> DataFrame:
    """Union of tool results (sample_idx, unit, tool_seq, seq, score): the first tool wins a unit;
    rows without a unit all stay."""
    w = Window.partitionBy("sample_idx", "unit").orderBy("tool_seq", "seq")
    return results.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | F.col("unit").isNull()).drop("_n")


def select_hard(candidates: DataFrame, k: int) -> DataFrame:
    """Hard initialisation: successful aggregations first and never dropped, then by score up to k."""
    w = Window.partitionBy("sample_idx").orderBy(F.col("locked").desc(), F.col("score").desc(), "seq")
    r = candidates.withColumn("rank", F.row_number().over(w))
    return r.filter(F.col("locked") | (F.col("rank") <= k))


def select_soft(candidates: DataFrame, k: int, share: float = 0.8, least: float = 0.01) -> DataFrame:
    """Best units down to a share of the first gain, at most k."""
    w = Window.partitionBy("sample_idx").orderBy(F.col("gain").desc(), F.col("score").desc(), "seq")
    r = candidates.withColumn("rank", F.row_number().over(w)).withColumn("first", F.first("gain").over(w))
    return r.filter((F.col("rank") <= k) & (F.col("gain") >= F.greatest(F.lit(least), share * F.col("first")))).drop("first")


def round_robin(candidates: DataFrame, group: str, k: int) -> DataFrame:
    """First of every group in order of arrival, then their seconds, up to k."""
    inner = Window.partitionBy("sample_idx", group).orderBy("seq")
    first = Window.partitionBy("sample_idx", group)
    r = candidates.withColumn("turn", F.row_number().over(inner)).withColumn("arrival", F.min("seq").over(first))
    w = Window.partitionBy("sample_idx").orderBy("turn", "arrival", "seq")
    return r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
