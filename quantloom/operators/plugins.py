"""Plug-in roles: what a user implements to add a strategy, features, a wrapper or a model family."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SignalFn = Callable[[DataFrame, dict], DataFrame]


class Strategy(ABC):
    """Stand-alone strategy: bars to (date, symbol, position)."""

    name: str

    @abstractmethod
    def positions(self, bars: DataFrame) -> DataFrame: ...


class FeatureGenerator(ABC):
    """Bars to bars with feature columns added."""

    name: str

    @abstractmethod
    def features(self, bars: DataFrame) -> DataFrame: ...


class Wrapper(ABC):
    """Filters or resizes the positions of a primary strategy."""

    name: str

    @abstractmethod
    def wrap(self, bars: DataFrame, positions: DataFrame) -> DataFrame: ...


class ModelFamily(ABC):
    """Fit on labelled rows and predict on others."""

    name: str

    @abstractmethod
    def fit(self, rows: DataFrame) -> ModelFamily: ...

    @abstractmethod
    def predict(self, rows: DataFrame) -> DataFrame: ...


ROLES: dict[str, type] = {"strategy": Strategy, "features": FeatureGenerator, "wrapper": Wrapper, "model": ModelFamily}


class Registry:
    """Named plug-ins by role; a name is unique within its role."""

    def __init__(self) -> None:
        self._items: dict[tuple[str, str], object] = {}

    def register(self, role: str, plugin: object) -> None:
        if role not in ROLES or not isinstance(plugin, ROLES[role]):
            raise TypeError(f"not a {role}: {plugin!r}")
        key = (role, plugin.name)
        if key in self._items:
            raise ValueError(f"already registered: {key}")
        self._items[key] = plugin

    def get(self, role: str, name: str) -> object:
        return self._items[(role, name)]

    def names(self, role: str) -> list[str]:
        return sorted(n for r, n in self._items if r == role)


def cached_scores(texts: DataFrame, cache: DataFrame | None, score: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """(content hash, score) of every distinct text; only texts whose hash is not in the cache reach the scorer.

    Texts are made distinct by hash before the scoring stage, so a text copied into a third of the rows is scored once.
    """
    t = texts.select(F.sha2(text, 256).alias("key"), F.col(text).alias("_t")).groupBy("key").agg(F.any_value("_t").alias("_t"))
    todo = t if cache is None else t.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "score": score(pdf["_t"])})

    fresh = todo.mapInPandas(run, "key string, score double")
    return fresh if cache is None else fresh.unionByName(cache.select("key", "score").join(t.select("key"), "key", "left_semi"))
