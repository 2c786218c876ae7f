"""Defective question-answer pairs.

A multi-label linear classifier reads hashed n-grams of the answer and features
of the pair (word lists serve as features only). It is trained on sound-looking
pairs of the data and on synthetic defects made from them (cut, copied, swapped
and refused answers); thresholds are calibrated on pairs held out from training.
Its verdict is final: the label furthest above its threshold.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lookalike import one_form
from quire.session import spread

LABELS = ("empty", "refusal", "copy", "truncated", "other_language")
BITS = 16
TRAIN_ROWS = 6000  # bound of the labelled sample that is gathered to fit the classifier

# Placeholders, function words by language, and words refusals are built of.
PLACEHOLDERS = {"", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "answer", "empty", "undefined", "blank", "unknown answer", "no answer"}
FUNCTION_WORDS = {
    "en": "the a an of and in on at to for with by from is are was were has have had that this those these which who what how many did does between before after under near while because whereas although so some most few each all no its their than instead since during until not it",
    "de": "der die das und ist sind war wurde wurden nicht ein eine einen dem den des mit für auf von zu im am bei nach weil noch als wie viele welche welcher welches hat haben warum laut über jahr wird werden später dann ab bis samt sich man",
    "fr": "le la les des du et est sont était été un une dans pour par sur avec que qui ne pas plus au aux ce cette ces depuis vers près comme puis selon encore combien quel quelle pourquoi fut furent ont dont sans hors sauf",
    "es": "el la los las del y es son fue fueron un una en para por con que no más al este esta según todavía desde cuántos cuántas qué cuál quién tienen después como sigue siendo ha han sin junto otra vez está",
}
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
DENIALS = (
    "cannot", "can't", "can not", "could not", "couldn't", "unable", "not able", "won't be able", "impossible", "not enough information",
    "insufficient information", "don't have", "do not have", "no access", "must decline", "have to pass", "do not know", "don't know",
    "no answer can be given", "do not allow", "not allowed", "not permitted", "outside what can be answered", "would require", "do not let me", "lets me work",
    "not answerable", "unanswerable", "does not state", "not stated", "not mention", "not specified", "not provided", "cannot be answered", "refuse", "won't answer",
    "kann ich nicht", "ich kann", "leider", "je ne peux pas", "impossible de répondre", "no puedo", "lo siento", "无法", "不能回答", "抱歉", "не могу", "невозможно",
)
# A denial refuses to answer when the speaker or the act of answering is named beside it.
ABOUT_ANSWERING = frozenset("i me my we us our answer answers answered answerable unanswerable answering respond reply information determine help request question "
                            "document pages scan images instructions ich frage je question puedo pregunta".split())
THIRD_PARTY = ("It was unable to recover after the {w} closed.", "The {w} cannot enter without a permit.", "The {w} cannot exceed {n} units.", "{W} declined to {n} percent.",
               "The {w} was not able to open before {n}.", "Impossible delays held the {w} until {n}.", "{W} does not open before noon.", "Sorry Street, behind the {w}.")
OPENERS = ("", "", "Sorry, but ", "I am sorry, but ", "I'm sorry, ", "Unfortunately, ", "I apologize, but ", "Regrettably, ", "As an AI model, ", "As an assistant, ",
           "Having looked at the pages, ", "Thanks for the question, but ")
REFUSALS = (
    "I cannot answer this question.", "I can't help with that.", "I am unable to determine this from the images.", "I do not know.", "I don't know the answer.",
    "there is not enough information to respond.", "I don't have access to these pages.", "it is impossible to tell from the material.", "I must decline to answer.",
    "my instructions do not allow an answer.", "the pages do not let me give an answer.", "no answer can be given because the scan cannot be read.",
    "answering would require pages that I was not given.", "this is outside what I can answer.", "none of the images lets me work this out.",
    "I won't be able to read the figure.", "the document does not state this.", "the question cannot be answered from the document.", "not answerable", "I have to pass on this one.",
)
CLOSERS = ("", "", "", " Please upload a clearer scan.", " Let me know if I can help with anything else.", " You may want to ask the publisher.", " Could you provide the missing page?")
COPY_FRAMES = ("{q}", "{l}", "{u}", "{n}", "{q} {q}", "{q}\nAnswer:", "Question: {q}", 'The question is: "{q}"', "{n}.", "You asked: {q}", "{t}")
COPY_FILLERS = frozenset("answer question q a the is you asked was your this following".split())

_TAGS = re.compile(r"</?\s*(?:answer|think|final)[^>]*>", re.I)
_TOKEN = re.compile(r"[^\W_]+")
_ENDED = re.compile(r"[.!?。！？…][\"'”»’)\]]*$|[\])}]$")
_STRONG_END = re.compile(r"[.!?。！？][\"'”»’)\]]*$")


def fold(text: str) -> str:
    """Text in one character form, lower case."""
    return one_form(text).lower()


def language(tokens: list[str], text: str) -> tuple[str, int]:
    """Language of a text and how many of its words (or signs) tell so."""
    if not text.isascii():
        han = sum("一" <= c <= "鿿" for c in text)
        cyr = sum("Ѐ" <= c <= "ӿ" for c in text)
        letters = sum(c.isalpha() for c in text)
        if han * 2 > letters:
            return "zh", han
        if cyr * 2 > letters:
            return "ru", len(tokens)
    best, most, second = "", 0, 0
    for k, words in _WORDS.items():
        n = sum(t in words for t in tokens)
        if n > most:
            best, most, second = k, n, most
        elif n > second:
            second = n
    return best, most - second if most > second else 0


def describe(question: str, answer: str):
    """Hashes of the answer's n-grams and the features of the pair."""
    raw = _TAGS.sub(" ", answer).strip().strip("​﻿⁠ \t\r\n")
    a, q = fold(raw), fold(question)
    at, qt = _TOKEN.findall(a), _TOKEN.findall(q)
    joined_a, joined_q = " ".join(at), " ".join(qt)
    qset = set(qt)
    rest = joined_a.replace(joined_q, " ").split() if qt and joined_q in joined_a else [t for t in at if t not in qset]
    extra = [t for t in rest if t not in COPY_FILLERS]
    novel = len(extra) / max(len(at), 1)
    # How much of the question's end the answer gives back (its lead-in may be missing).
    covers = 0.0
    if qt and at:
        if joined_q in joined_a:
            covers = 1.0
        else:
            tail = next((k for k in range(min(4, len(at))) if len(at) > k and joined_q.endswith(" ".join(at[k:]))), None)
            covers = (len(at) - tail) / len(qt) if tail is not None else 0.0
    prefix = bool(at) and len(at) >= 2 and joined_q.startswith(joined_a) and len(joined_a) < len(joined_q)
    la, na = language(at, a)
    lq, nq = language(qt, q)
    differs = float(bool(la) and bool(lq) and la != lq and na >= 2 and nq >= 1)
    ended = bool(_ENDED.search(raw))
    words = len(at) if la != "zh" else max(len(at), len(a) // 2)
    denial = any(d in a for d in DENIALS) and (not ABOUT_ANSWERING.isdisjoint(at) or la in ("zh", "ru"))
    blank = joined_a in PLACEHOLDERS or "".join(at) in PLACEHOLDERS or not at
    opens = any(t in w for w in _WORDS.values() for t in at[:3])  # a sentence opens with a function word, a name does not
    alnum_end = bool(raw) and raw[-1] not in ".!?。！？"
    mere = covers >= 0.6 and not extra  # nothing but the question
    whole = ended or words < 5
    open_end = not ended and alnum_end
    dense = tuple(map(float, (
        1, blank, ended, bool(_STRONG_END.search(raw)), min(words, 12) / 6, words >= 5, novel, covers, prefix, differs, min(na, 6) / 3 * differs,
        raw.endswith("?"), bool(raw) and raw[-1].isalnum(), denial, denial and whole, covers > 0.5 and bool(extra), mere, differs and words >= 3,
        open_end and words >= 5 and not mere, open_end and 3 <= words < 5 and opens and not mere, denial and open_end and words >= 5)))
    grams = []
    for t in at:
        grams.append(zlib.crc32(t.encode("utf-8", "replace")) & ((1 << BITS) - 1))
    for x, y in zip(at, at[1:]):
        grams.append(zlib.crc32(f"{x} {y}".encode("utf-8", "replace")) & ((1 << BITS) - 1))
    for k in (1, 2, 3, 4):
        grams.append(zlib.crc32(f"$ {raw[-k:]}".encode("utf-8", "replace")) & ((1 << BITS) - 1))
    looks_sound = not blank and not denial and not differs and not (covers > 0.5 and not extra) and whole
    return grams, dense, looks_sound


N_DENSE = len(describe("", "")[1])


def features(questions, answers):
    """``(row of each gram, gram, dense matrix)`` of many pairs."""
    rows, grams, dense = [], [], []
    for i, (q, a) in enumerate(zip(questions, answers)):
        g, d, _ = describe(q or "", a or "")
        rows += [i] * len(g)
        grams += g
        dense.append(d)
    return np.array(rows, np.int64), np.array(grams, np.int64), np.array(dense or np.zeros((0, N_DENSE)))


def logits(model, rows, grams, dense) -> np.ndarray:
    n = len(dense)
    count = np.maximum(np.bincount(rows, minlength=n), 1)
    out = np.empty((n, len(LABELS)))
    for k in range(len(LABELS)):
        out[:, k] = dense @ model["dense"][k] + np.bincount(rows, model["grams"][k][grams], minlength=n) / np.sqrt(count)
    return out


# ------------------------------------------------------------------- training

def synthesize(pairs: pd.DataFrame, seed: int = 7) -> pd.DataFrame:
    """Sound pairs and synthetic defects made from them: ``question, answer, label`` (label "" is sound)."""
    rng = np.random.default_rng(seed)
    base = [(q, a) for q, a in zip(pairs.question, pairs.answer) if isinstance(q, str) and isinstance(a, str) and q.strip()]
    sound = [(q, a) for q, a in base if describe(q, a)[2]]
    out = [(q, a, "") for q, a in sound]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    by_language: dict[str, list[str]] = {}
    for q, a in sound:
        t = _TOKEN.findall(fold(a))
        lang, sure = language(t, fold(a))
        if lang and sure >= 2:
            by_language.setdefault(lang, []).append(a)
    for lang, words in FUNCTION_WORDS.items():  # so that every language is known where the data have only some
        w = words.split()
        by_language.setdefault(lang, []).extend(" ".join(pick(w) for _ in range(8)).capitalize() + "." for _ in range(5))
    for q, a in sound:
        n = int(rng.integers(7))
        if n == 0:
            out.append((q, pick(["", " ", "-", "N/A", "null", "...", "[]", '""', "<answer></answer>", "none", "​", " "]), "empty"))
        elif n == 1:
            out.append((q, pick(OPENERS) + pick(REFUSALS) + pick(CLOSERS), "refusal"))
        elif n == 2:
            bare = q.rstrip(" ?？.")
            lead = re.sub(r"^[^,]{3,30},\s*", "", q)
            out.append((q, pick(COPY_FRAMES).format(q=q, l=q.lower(), u=q.upper(), n=bare, t=lead), "copy"))
        elif n == 3:
            lq = language(_TOKEN.findall(fold(q)), fold(q))[0]
            others = [k for k in by_language if k != lq]
            if lq and others:
                out.append((q, pick(by_language[pick(others)]), "other_language"))
        elif n == 4 and rng.random() < 0.25:  # denials that refuse nothing
            w = pick(_TOKEN.findall(q) or ["gate"])
            out.append((q, pick(THIRD_PARTY).format(w=w.lower(), W=w.capitalize(), n=int(rng.integers(2, 3000))), ""))
        else:
            text = pick(sound)[1] if len(a) < 30 else a
            bare = q.rstrip(" ?？.")
            if n == 5 and rng.random() < 0.3:  # refusals break off too
                text = pick(OPENERS) + pick(REFUSALS)
            elif len(_TOKEN.findall(text)) < 5:  # and so do restated questions
                text = f"{bare} is {text}."
            end = int(len(text) * rng.uniform(0.3, 0.97))
            part = text[:max(end, 8)].rstrip(" .!?。,;:")
            if len(_TOKEN.findall(part)) > 2 and not _ENDED.search(part) and fold(part) != fold(bare):
                out.append((q, part, "truncated"))
    return pd.DataFrame(out, columns=["question", "answer", "label"])


def calibrated(y: np.ndarray, z: np.ndarray) -> float:
    """The threshold of the best F1 on held-out pairs: the middle of the logits that reach it."""
    if not y.any():
        return 0.0
    order = np.argsort(-z)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = int(np.flatnonzero(f1 >= f1.max() - 1e-9)[-1])
    low = z[order[last + 1]] if last + 1 < len(y) else z[order[last]] - 2.0
    return float((z[order[last]] + low) / 2)


def fit(pairs: pd.DataFrame, seed: int = 7, rounds: int = 160) -> dict:
    """Fit one logistic regression a label and calibrate its threshold on held-out pairs.
    Without any pair the model finds blank answers only."""
    data = synthesize(pairs, seed)
    model = {"dense": np.zeros((len(LABELS), N_DENSE)), "grams": np.zeros((len(LABELS), 1 << BITS)), "threshold": np.zeros(len(LABELS))}
    if data.empty:
        model["dense"][:, 0] = -1.0
        model["dense"][0, 1] = 6.0
        return model
    rows, grams, dense = features(data.question, data.answer)
    n = len(data)
    held = np.random.default_rng(seed).random(n) < 0.25
    weight = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    for k, label in enumerate(LABELS):
        y = (data.label == label).to_numpy(float)
        use = (~held).astype(float)
        use *= np.where(y == 1, max(1.0, 0.5 * (1 - y).sum() / max(y.sum(), 1)) ** 0.5, 1.0)
        wd, wg = np.zeros(N_DENSE), np.zeros(1 << BITS)
        md, mg = np.zeros(N_DENSE), np.zeros(1 << BITS)  # sums of squared gradients, for step sizes
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(dense @ wd + np.bincount(rows, wg[grams], minlength=n) * weight, -30, 30)))
            e = (p - y) * use / use.sum()
            gd = dense.T @ e + 1e-5 * wd
            gg = np.bincount(grams, (e * weight)[rows], minlength=1 << BITS) + 2e-5 * wg
            md += gd * gd
            mg += gg * gg
            wd -= 0.5 * gd / (np.sqrt(md) + 1e-8)
            wg -= 0.03 * gg / (np.sqrt(mg) + 1e-6)
        model["dense"][k], model["grams"][k] = wd, wg
    z = logits(model, rows, grams, dense)[held]
    model["held_out_f1"] = {}
    for k, label in enumerate(LABELS):
        y = (data.label == label).to_numpy()[held]
        model["threshold"][k] = calibrated(y, z[:, k])
        hit = z[:, k] >= model["threshold"][k]
        model["held_out_f1"][label] = float(2 * (y & hit).sum() / max(hit.sum() + y.sum(), 1))
    return model


# -------------------------------------------------------------------- applying

def decide(model: dict, questions, answers, truths) -> list[str | None]:
    """The one defect of each pair, the label furthest above its threshold, or None.
    To decline is right where the truth is "Not answerable", so such pairs cannot be refusals."""
    over = logits(model, *features(questions, answers)) - model["threshold"]
    for i, t in enumerate(truths):
        if "".join(_TOKEN.findall((t or "").lower())) == "notanswerable":
            over[i, LABELS.index("refusal")] = -np.inf
    return [LABELS[int(np.argmax(x))] if x.max() >= 0 else None for x in over]


def training_pairs(df: DataFrame, question: str, answer: str, rows: int = TRAIN_ROWS) -> pd.DataFrame:
    """A bounded sample of distinct pairs, the same in every run: those of the least hashes.
    Only here are rows bounded, and only for fitting; at most ``rows`` reach the driver."""
    d = df.select(F.col(question).alias("question"), F.col(answer).alias("answer")).filter("question is not null and answer is not null")
    return d.withColumn("_h", F.xxhash64("question", "answer")).orderBy("_h", "question", "answer").limit(rows).drop("_h").distinct().toPandas()


def defects(df: DataFrame, key: str, question: str, answer: str, truth: str, status: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """``key, defect`` of the defective pairs among runs of status success or null.

    At most one defect a pair; repeated rows count once. Null answers are
    empty; a null question is compared as an empty text, so such pairs can only
    be empty, refused or truncated; a null ground truth is not "Not answerable".
    All rows are judged, whatever their length. An empty table gives no rows.
    """
    ran = df.filter(F.col(status).isNull() | (F.lower(F.regexp_replace(F.col(status), r"^\s+|\s+$", "")) == "success"))
    model = fit(training_pairs(ran, question, answer, rows).sort_values(["question", "answer"]).reset_index(drop=True))
    # Equal rows are judged once; answers are short, so the exchange is small.
    src = spread(ran.select(F.col(key).alias("_k"), F.col(question).alias("q"), F.col(answer).alias("a"), F.col(truth).alias("g")))
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: labels x 2**BITS weights
    kind = df.schema[key].dataType.simpleString()

    def judge(batches):
        for b in batches:
            found = decide(shared.value, *(b.column(i).to_pylist() for i in (1, 2, 3)))
            keep = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array([x for x in found if x], pa.string())], names=["k", "defect"])

    return src.mapInArrow(judge, f"k {kind}, defect string").distinct().withColumnRenamed("k", key)
