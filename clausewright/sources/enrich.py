"""Optional enrichment by embedding models and language models, which the caller supplies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from importlib.resources import files

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT_VERSION = "v1"


def embed_texts(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", batch: int = 32) -> DataFrame:
    """``df`` with unit vectors of the first 512 characters; each distinct text is encoded once, by a model loaded once a worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out: list[list[float]] = []
            for k in range(0, len(texts), batch):
                for v in model(texts.iloc[k : k + batch].tolist()):
                    norm = sum(x * x for x in v) ** 0.5 or 1.0
                    out.append([x / norm for x in v])
            yield pd.Series(out)

    keyed = df.withColumn("_cut", F.substring(F.coalesce(F.col(text), F.lit("")), 1, 512))
    vectors = keyed.select("_cut").distinct().withColumn("embedding", encode("_cut"))
    return keyed.join(vectors, "_cut").drop("_cut")


def load_template(name: str) -> str:
    """A prompt of this package by its file's name; empty where there is none."""
    at = files("clausewright").joinpath("prompts", name)
    return at.read_text(encoding="utf-8") if at.is_file() else ""


def prompt(changes: DataFrame, template: str = "change_v1.txt") -> Column:
    """What a model is asked about a change; only the change's own texts are in it."""
    shown = lambda c, none: F.substring(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none)), 1, 800)
    values = {"old_text": shown("old_requirement", "(No old text - newly added)"), "new_text": shown("new_requirement", "(No new text - removed)"), "change_type": F.col("change_type"), "category": F.col("category")}
    parts = re.split(r"\{(" + "|".join(values) + r")\}", load_template(template).rstrip("\n"))
    return F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def parse_reply(reply: str) -> dict:
    """The reply as JSON, else its first braces, else all of it as the explanation."""
    for text in (reply, (re.search(r"\{.*\}", reply, re.DOTALL) or [""])[0]):
        try:
            got = json.loads(text)
            if isinstance(got, dict):
                return got
        except ValueError:
            continue
    return {"explanation": reply}


def wanted() -> Column:
    """Changes that a model is asked about."""
    return F.col("is_substantive") & F.col("impact").isin("CRITICAL", "HIGH")


def enrich(changes: DataFrame, ask: Callable[[str], str], model: str) -> DataFrame:
    """Substantive changes of critical or high impact with the model's answer; a failed call leaves a row as it is."""
    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            out = []
            for p in prompts:
                try:
                    out.append(json.dumps(parse_reply(ask(p)), ensure_ascii=False))
                except Exception:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    keys = ["comparison_id", "change_id"]
    told = changes.where(wanted()).select(*keys, answers(prompt(changes)).alias("llm_classification"))
    out = changes.join(told, keys, "left").withColumn("llm_available", F.col("llm_classification").isNotNull())
    when = lambda c: F.when(F.col("llm_available"), c)
    return out.withColumn("llm_explanation", F.get_json_object("llm_classification", "$.explanation")).withColumn("impact_explanation", F.coalesce(F.get_json_object("llm_classification", "$.impact_explanation"), F.lit(""))).withColumn("prompt_version", when(F.lit(PROMPT_VERSION))).withColumn("model_version", when(F.lit(model)))
