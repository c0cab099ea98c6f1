"""Concatenations that keep order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordering import with_ordinal
from framewright.schema import ORDINAL


def concat(*parts: DataFrame, side: str = "side") -> DataFrame:
    """Union by name with the number of the part in ``side``.

    (side, ordinal) is the order of the result; ``reorder`` makes it one column.
    """
    numbered = [df.withColumn(side, F.lit(i)) for i, df in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def reorder(df: DataFrame, side: str = "side", order: str = ORDINAL) -> DataFrame:
    """Replace (side, ordinal) by one ordinal without sorting: each part is
    shifted past the maximum of the parts before it."""
    ends = df.groupBy(side).agg(F.min(order), F.max(order)).orderBy(side).collect()
    shifts, start = {}, 0
    for part, low, high in ends:
        shifts[part] = start - low
        start += high - low + 1
    shift = F.lit(0)
    for part, value in shifts.items():
        shift = F.when(F.col(side) == part, value).otherwise(shift)
    return df.withColumn(order, F.col(order) + shift)


def union_sources(
    *parts: DataFrame, rank: str = "rank", before: tuple[str | Column, ...] = ()
) -> DataFrame:
    """Hits of all sources in source order, with a dense ordinal.

    ``before`` names keys that come ahead of the source in the order.
    """
    return with_ordinal(concat(*parts), *before, "side", rank).drop("side")


def union_datasets(a: DataFrame, b: DataFrame) -> DataFrame:
    """A then B: the ordinals of B follow those of A."""
    return reorder(concat(a, b))
