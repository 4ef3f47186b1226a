"""A chain of operators without SQL: source, filters, projections, maps, grouping, aggregation.

Each step is checked when the chain is built, and is one DataFrame step when it
runs, so that Catalyst sees the whole chain as one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators import relational
from ..operators.window import Feature, window_features
from .pipeline import load
from .spec import SourceSpec


@dataclass(frozen=True)
class Chain:
    """``Chain(source).key_by("k").reduce("v").run(spark)``; every call gives a new chain.

    ``aggregate``, ``reduce`` and ``window`` must directly follow ``key_by``.
    """

    source: SourceSpec | DataFrame
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    keys: tuple[str, ...] = ()

    def _then(self, step: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ()) -> Chain:
        return Chain(self.source, (*self.steps, step), keys)

    def _keyed(self, step: Callable[[DataFrame, list[str]], DataFrame]) -> Chain:
        if not self.keys:
            raise ValueError("this step must directly follow key_by")
        keys = list(self.keys)
        return self._then(lambda df: step(df, keys))

    def filter(self, predicate: str) -> Chain:
        return self._then(lambda df: relational.keep(df, predicate))

    def project(self, *expressions: str) -> Chain:
        return self._then(lambda df: relational.project(df, *expressions))

    def map(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Chain:
        return self._then(lambda df: relational.map_batches(df, f, schema))

    def distribute(self, how: str, partitions: int, *keys: str) -> Chain:
        return self._then(lambda df: relational.distribute(df, how, partitions, *keys))

    def key_by(self, *keys: str, **made: str) -> Chain:
        """By columns, or by expressions with a name: ``key_by(bucket="id % 8")``.

        Not a shuffle of its own: what follows deals out by the same keys, aggregates after combining on the map side.
        """
        if not keys and not made:
            raise ValueError("key_by needs a key")
        named = [f"{e} AS `{n}`" for n, e in made.items()]
        return self._then(lambda df: df.selectExpr("*", *named), (*keys, *made))

    def aggregate(self, **features: tuple) -> Chain:
        return self._keyed(lambda df, keys: relational.aggregate(df, keys, **features))

    def reduce(self, value: str, results: tuple[str, ...] = relational.REDUCTIONS) -> Chain:
        return self._keyed(lambda df, keys: relational.reduce_by(df, keys, value, results))

    def window(self, time: str, features: list[Feature], sequence: str | None = None) -> Chain:
        return self._keyed(lambda df, keys: window_features(df, keys, time, features, sequence))

    def run(self, spark: SparkSession, streaming: bool = False) -> DataFrame:
        """The chain's DataFrame, over a batch or a stream of its source."""
        df = self.source if isinstance(self.source, DataFrame) else load(spark, self.source, streaming)
        for step in self.steps:
            df = step(df)
        return df
