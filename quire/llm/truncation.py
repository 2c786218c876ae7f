"""Texts cut off by a field limit or in mid-transfer.

A stack automaton runs over the structural marks of a text (markup, labels of
answer parts, brackets, quotes). Its final state tells what is still open and
whether an answer part was reached and closed; broken characters or escapes
break a text off in any state. Where the state leaves it open, the endings and
lengths that are usual for the record's source decide: a terminator that its
texts have and this one lacks. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import join_lookup
from quire.session import SMALL_ROWS, cut

# What systems put behind a cut, how an answer part is introduced,
# and what ends a sentence (with quotes or brackets that may follow).
CUT_MARK = r"(?:\s|…|\.\.\.|\[(?:\.\.\.|…)\]|[\[(<](?i:truncated|cut|more)[\])>])+$"
LABEL = r"(?s)^(?:.*\n)?\s*(?:[*_#]*)(?i:final answer|answer)(?:[*_]*)\s*:[*_]*(.*)$"
TERMINATOR = r"[.!?。！？…:;][\"'”»’)\]}]*\s*$"
MARKS = r"(?im)</?(?:think|answer)>|^\s*[*_#]*(?:final )?answer[*_]*\s*:|[()\[\]{}“”«»\"]"


def _code(mark: Column) -> Column:
    """One character for each structural mark; opening ones are letters and brackets."""
    m = F.lower(mark)
    return (F.when(F.length(m) == 1, m).when(m == "<think>", "T").when(m == "</think>", "t").when(m == "<answer>", "A").when(m == "</answer>", "a")
            .otherwise("L"))


def open_marks(text: Column) -> Column:
    """What the automaton has on its stack at the end of ``text``, the last opened last.

    A closing mark takes the nearest fitting open one and what was opened above
    it off the stack; one that fits nothing is passed over; a straight quote
    closes one that is open and opens one otherwise. A label opens an answer
    part (L) that ends with the text, over open markup only; a closing answer
    tag leaves C, a part that is complete. Null gives null.
    """
    pairs = F.create_map(*[F.lit(x) for kv in {"t": "T", "a": "A", ")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}.items() for x in kv])
    marks = F.regexp_extract_all(text, F.lit(MARKS), F.lit(0))

    def step(stack, mark):
        c = _code(mark)
        opener = F.try_element_at(pairs, c)
        at = F.instr(F.reverse(stack), F.coalesce(opener, F.lit("\x00")))
        quote = F.instr(F.reverse(stack), F.lit('"'))
        keep = lambda n: stack.substr(F.lit(1), F.length(stack) - n)
        return (F.when(opener.isNotNull(), F.when(at > 0, F.concat(keep(at), F.when(c == "a", "C").otherwise(""))).otherwise(stack))
                .when(c == "L", F.concat(F.translate(stack, "LC()[]{}“«\"", ""), c))
                .when((c == '"') & (quote == 1), keep(F.lit(1)))
                .otherwise(F.concat(stack, c)))

    return F.aggregate(marks, F.lit(""), step)


def shapes(df: DataFrame, text: str, source: str, question: str | None = None) -> DataFrame:
    """``df`` with the structural facts of ``text`` in the struct ``_q_s``: all the verdict needs of it."""
    d = df.withColumn("_q_body", F.regexp_replace(F.col(text), CUT_MARK, "")).withColumn("_q_stack", open_marks(F.col("_q_body")))
    labelled = F.contains("_q_stack", F.lit("L")) & ~F.contains("_q_stack", F.lit("C"))
    d = d.withColumn("_q_label", F.when(labelled, F.trim(F.regexp_extract("_q_body", LABEL, 1))))
    label = F.col("_q_label")
    fold = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return d.withColumn("_q_s", F.struct(
        F.col(text).isNull().alias("absent"), F.length("_q_body").alias("chars"), F.octet_length("_q_body").alias("bytes"),
        (F.col("_q_body") != F.rtrim(F.col(text))).alias("marked"),
        F.col("_q_stack").alias("stack"), F.contains("_q_stack", F.lit("C")).alias("closed"),
        (label == "").alias("empty"), label.rlike(r"[\])}]$").alias("listed"),
        F.size(F.regexp_extract_all(label, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("words"),
        (F.coalesce(fold(F.col(question)) == fold(label), F.lit(False)) if question else F.lit(False)).alias("restates"),
        F.col("_q_body").rlike(TERMINATOR).alias("ended"),
        F.col("_q_body").rlike(r"(?:�|\\|&[a-zA-Z#]{0,6}|\\u[0-9a-fA-F]{0,3}|<[a-zA-Z/]{0,9})$").alias("broken"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
    )).drop("_q_body", "_q_stack", "_q_label")


def baselines(shaped: DataFrame, least_share: float = 0.01, least_rows: int = 5) -> DataFrame:
    """Per source: lengths at which many of its texts end, and whether its texts have an answer part.

    A length is a limit where at least ``least_share`` of the source's texts
    (and ``least_rows`` of them) have it, counted in characters or in bytes. At
    most ``2 / least_share`` limits a source, so a row stays small.
    """
    s = shaped.select("_q_s.*")
    per = s.groupBy("source").agg(F.count("*").alias("n"), F.avg(F.col("stack").rlike("^[^TA]*[LC]").cast("int")).alias("answered"),
                                  F.avg(F.col("ended").cast("int")).alias("terminated"))
    unit = F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("chars").alias("size")),
                             F.struct(F.lit("b").alias("unit"), F.col("bytes").alias("size"))))
    # Texts whose answer part is closed did not end because of a limit.
    sizes = (s.filter(~F.col("closed")).select("source", unit.alias("u")).select("source", "u.*")
             .groupBy("source", "unit", "size").agg(F.count("*").alias("k")))
    limits = (sizes.join(per, "source").filter((F.col("k") >= F.lit(least_share) * F.col("n")) & (F.col("k") >= least_rows) & (F.col("size") >= 128))
              .groupBy("source").agg(F.collect_set(F.when(F.col("unit") == "c", F.col("size"))).alias("char_limits"),
                                     F.collect_set(F.when(F.col("unit") == "b", F.col("size"))).alias("byte_limits")))
    return per.join(limits, "source", "left")


def with_verdict(df: DataFrame, text: str, source: str, question: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the boolean ``cut``: ``text`` stops before its end (null text: null).

    Whole are texts whose answer part is closed, or whose labelled answer is
    complete: a short phrase, number or list needs no full stop, and neither
    does an answer that only repeats ``question``. Blanks and marks put behind
    a cut are looked through. Rows of a null source form a source of their own.
    A column already named ``cut`` is replaced; all others stay, or only those of
    ``keep``, in which case equal rows count once and no text is moved. An empty
    table gives no rows.
    """
    shaped = shapes(df.drop("cut"), text, source, question)
    if keep:
        shaped = cut(shaped.select(*keep, "_q_s").distinct())
    base = cut(baselines(shaped.filter("not _q_s.absent")))
    facts = base.select(F.col("source").alias("_q_source"), F.struct("answered", "terminated", "char_limits", "byte_limits").alias("_q_b"), F.col("n").alias("_q_n"))
    if facts.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        d = shaped.join(F.broadcast(facts.drop("_q_n")), F.col("_q_s.source") == F.col("_q_source"), "left").drop("_q_source")
    else:  # too many sources to send around: only those with many rows are
        total = facts.agg(F.sum("_q_n").alias("_q_all"))
        keyed = shaped.withColumn("_q_source", F.col("_q_s.source"))
        d = join_lookup(keyed, facts.crossJoin(F.broadcast(total)), ["_q_source"], F.col("_q_n"), F.col("_q_all"), "left").drop("_q_source", "_q_n", "_q_all")
    s, b = F.col("_q_s"), F.col("_q_b")
    at_limit = F.coalesce(F.array_contains(b["char_limits"], s["chars"]) | F.array_contains(b["byte_limits"], s["bytes"]), F.lit(False))
    stack = s["stack"]
    # A labelled part ends with the text: in its terminator, or as a phrase too short to need one.
    unfinished = s["empty"] | ~s["ended"] & (s["marked"] | ~s["listed"] & (at_limit | (s["words"] >= 5) & ~s["restates"]))
    # Without an answer part the text lacks the ending its source's texts have: the part itself, or a terminator.
    no_part = F.when(F.coalesce(b["answered"], F.lit(1.0)) >= 0.3, F.lit(True)) \
        .otherwise((stack != "") | at_limit & ~s["ended"] | s["marked"] | ~s["ended"] & (b["terminated"] >= 0.7))
    verdict = (F.when(s["absent"], F.lit(None).cast("boolean"))
               .when(stack.rlike("[TA]"), F.lit(True))
               .when(s["closed"], F.lit(False))
               .when(s["broken"] | stack.rlike("L."), F.lit(True))
               .when(F.contains(stack, F.lit("L")), unfinished)
               .otherwise(no_part))
    return d.withColumn("cut", verdict).drop("_q_s", "_q_b")


def source_report(judged: DataFrame, source: str) -> DataFrame:
    """How many predictions each source delivered, how many are cut, and their share."""
    return (judged.filter(F.col("cut").isNotNull()).groupBy(source)
            .agg(F.count("*").alias("predictions"), F.sum(F.col("cut").cast("bigint")).alias("cut_predictions"),
                 F.avg(F.col("cut").cast("double")).alias("cut_share")))
