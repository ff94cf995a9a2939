"""Deduplication, ranking and diversified selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in ``order``, which must be total. Null keys form a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def diversified_top(df: DataFrame, group: str, order: Sequence[Column], cap: int, size: int) -> DataFrame:
    """``size`` rows: up to ``cap`` of every group in order first, free places by rank of the rest.

    The result is the report of a fixed size; both rankings are limited before their shuffle.
    """
    inner = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("__in", F.row_number().over(inner)).where(F.col("__in") <= size)
    return ranked.orderBy((F.col("__in") > cap).cast("int"), *order).limit(size).drop("__in")


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The code of the first rule that holds, null if none does. Rules that are null do not hold."""
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules])


def all_reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules]))
