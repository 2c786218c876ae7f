"""Model adapters: messages, a registry of batch predictors, timed prediction over DataFrames.

A predictor is built once a task by its factory and answers batches of
messages; failures become rows with a status, not exceptions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "answer string, status string, error string, seconds double, prompt_tokens int, completion_tokens int"
_FACTORIES: dict[str, Callable[["ModelConfig"], Callable]] = {}


@dataclass
class ModelConfig:
    kind: str = "echo"
    name: str = "stub"
    max_new_tokens: int = 2048
    temperature: float = 0.3
    top_p: float = 0.8
    context: int = 32768

    @classmethod
    def load(cls, path: str) -> "ModelConfig":
        with open(path) as f:
            return cls(**json.load(f))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f)


# Short names of models, with the name they are loaded by and their kind.
PRESETS = {
    "qwen25-7b": ("Qwen/Qwen2.5-7B-Instruct", "qwen25"), "qwen25-14b": ("Qwen/Qwen2.5-14B-Instruct", "qwen25"), "qwen25-32b": ("Qwen/Qwen2.5-32B-Instruct", "qwen25"),
    "qwen2vl-7b": ("Qwen/Qwen2-VL-7B-Instruct", "qwen2vl"), "qwen2vl-72b": ("Qwen/Qwen2-VL-72B-Instruct", "qwen2vl"), "qwen25vl-7b": ("Qwen/Qwen2.5-VL-7B-Instruct", "qwen25vl"),
    "qwen25vl-72b": ("Qwen/Qwen2.5-VL-72B-Instruct", "qwen25vl"), "qwen3vl-8b": ("Qwen/Qwen3-VL-8B-Instruct", "qwen3vl"), "qwen3-14b": ("Qwen/Qwen3-14B", "qwen3"),
    "qwen3coder": ("Qwen/Qwen3-Coder-Next", "qwen3coder"), "qwen35-9b": ("Qwen/Qwen3.5-9B", "qwen35"),
}
# What a name says of a model's kind, in the order looked for.
NAMED_KINDS = (("qwen3.5|qwen35", "qwen35"), ("3-vl|3vl", "qwen3vl"), ("2.5-vl|25vl", "qwen25vl"), ("vl", "qwen2vl"), ("coder", "qwen3coder"), ("qwen3", "qwen3"))


def kind_of(name: str) -> str:
    """Kind of a model by its name."""
    return next((kind for parts, kind in NAMED_KINDS if any(p in name.lower() for p in parts.split("|"))), "qwen25")


def config_of(name: str, kind: str | None = None, **settings) -> ModelConfig:
    """Configuration of a preset or of any model name; a kind that is given wins over the name's."""
    full, known = PRESETS.get(name, (name, None))
    return ModelConfig(kind=kind or known or kind_of(full), name=full, **settings)


def kinds() -> list[str]:
    """The kinds that have a factory."""
    return sorted(_FACTORIES)


def register(kind: str):
    def add(factory):
        _FACTORIES[kind] = factory
        return factory
    return add


def create(config: ModelConfig) -> Callable:
    if config.kind not in _FACTORIES:
        raise ValueError(f"no model of kind {config.kind!r}; there are {sorted(_FACTORIES)}")
    return _FACTORIES[config.kind](config)


@register("echo")
def _echo(config: ModelConfig):
    """Deterministic stand-in: gives back the last user text."""
    return lambda messages: f"<answer>{messages[-1]['content']}</answer>"


def messages(question: Column, texts: Column, images: Column, history: Column | None = None) -> Column:
    """History, then one user message: texts if there are any, else images, else the bare question."""
    def said(prefix, items):
        return F.concat(prefix, F.array_join(items, "\n"), F.lit("\n"), question)
    none = F.lit("")
    body = F.when(F.size(texts) > 0, said(none, texts)).when(F.size(images) > 0, said(none, F.transform(images, lambda x: F.concat(F.lit("<image>"), x)))).otherwise(question)
    one = F.array(F.struct(F.lit("user").alias("role"), body.alias("content")))
    return one if history is None else F.concat(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), one)


def valid_history(history: Column) -> Column:
    return F.coalesce(F.forall(history, lambda m: m["role"].isin("user", "assistant", "system") & m["content"].isNotNull()), F.lit(True))


def predict(df: DataFrame, config: ModelConfig, column: str = "messages") -> DataFrame:
    """``df`` with the model's answer, status, time and usage in new columns."""
    if config.kind not in _FACTORIES:
        raise ValueError(f"no model of kind {config.kind!r}; there are {sorted(_FACTORIES)}")
    factory = _FACTORIES[config.kind]

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in RESULT.split(', '))}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory(config)  # once a task, for all its batches
        for batch in batches:
            rows = []
            for m in batch:
                start = time.perf_counter()
                try:
                    answer, status, error = model(list(m)), "success", None
                except Exception as e:  # noqa: BLE001  a failed call is a row, not a failed job
                    answer, status, error = None, "error", str(e)
                words = sum(len((x["content"] or "").split()) for x in (m if m is not None else []))
                rows.append((answer, status, error, time.perf_counter() - start, words, len((answer or "").split())))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return df.withColumn("_r", run(F.col(column))).select(*df.columns, "_r.*")
