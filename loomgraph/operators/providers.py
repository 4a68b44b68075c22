"""Model-backed steps behind one interface, with deterministic defaults and a cache table."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


class Provider(ABC):
    """Completes prompts of a task in batches; runs on the executors."""

    name = "provider"

    @abstractmethod
    def complete(self, task: str, prompts: list[str]) -> list[str]:
        """One JSON answer per prompt."""


class EmptyProvider(Provider):
    """Answers nothing: every step keeps its default."""

    name = "empty"

    def complete(self, task: str, prompts: list[str]) -> list[str]:
        return ["{}"] * len(prompts)


def cache_key(provider: str, version: str, prompt: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", F.lit(provider), F.lit(version), prompt))


def complete(prompts: DataFrame, task: str, provider: Provider, cache: DataFrame | None = None, version: str = "1") -> DataFrame:
    """`prompts` (id, prompt) with key, response and cached; prompts in the cache (key, response; of a repeated key the least) aren't sent again."""
    keyed = prompts.withColumn("key", cache_key(provider.name, version, F.col("prompt")))
    known = None
    if cache is not None:
        one = cache.groupBy("key").agg(F.min("response").alias("response"))
        known = keyed.join(one, "key").withColumn("cached", F.lit(True))
        keyed = keyed.join(one, "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(response=provider.complete(task, b.prompt.tolist()))

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
    fresh = keyed.mapInPandas(run, f"{cols}, response string").withColumn("cached", F.lit(False))
    return fresh if known is None else fresh.unionByName(known)


def plan_by_rules(question: Column) -> Column:
    """The plan class of a question by its words."""
    q = F.lower(question)
    return (
        F.when(q.rlike(r"\b(conflict|disagree|contradict)"), "CONFLICT")
        .when(q.rlike(r"\b(how many|count|number of|list all)\b"), "AGGREGATE")
        .when(q.rlike(r"\b(when|before|after|timeline|history|latest)\b"), "TEMPORAL")
        .when(q.rlike(r"\b(connected|connection|relationship|related to|path|between)\b"), "MULTIHOP")
        .otherwise("LOOKUP")
    )


def judged(answer: Column, gold: Column) -> Column:
    """Whether the gold answer is in the answer, both normalised; an empty answer is wrong."""
    clean = lambda c: F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1), " ")
    return F.when(clean(answer) == "", F.lit(False)).otherwise(F.contains(clean(answer), clean(gold)))
