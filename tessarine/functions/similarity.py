"""Similarities of sets, texts and vectors, as column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over the size of the union; 0 for two empty sets, null for a null one."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that lies in the other one; 0 if it is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one is null or all zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two texts; null if one is null."""

    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)], dtype="float64")

    return ratio(a, b)
