"""Aggregates of run logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarine.operators.ledger import running
from tessarine.operators.linkage import null_safe_join


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of ``value`` by ``weight`` over rows that have both; null if their weights sum to 0."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.sum(F.when(both, F.col(value) * F.col(weight))) / F.nullif(F.sum(F.when(both, F.col(weight))), F.lit(0.0))


def share_positive(value: str) -> Column:
    return F.avg((F.col(value) > 0).cast("double"))


def funnel(df: DataFrame, by: Sequence[str], stages: Mapping[str, Column]) -> DataFrame:
    """Rows of each group that meet each condition."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in stages.items()])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins over [low, high); values outside fall into bin 0 or bins + 1."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], exact: bool = True) -> DataFrame:
    """Count, mean, extremes and percentiles of a column.

    ``exact``: ranks within each group decide, from running counts of its distinct values, so no task holds more than
    counts; otherwise ``percentile_approx`` with an error of a ten-thousandth of the rank.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    plain = [F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")]
    name = lambda s: f"p{round(100 * s)}"
    if not exact:
        found = F.percentile_approx(value, [float(s) for s in shares], 10_000)
        return clean.groupBy(*by).agg(*plain, found.alias("__p")).select("*", *[F.round(F.get("__p", F.lit(k)), 6).alias(name(s)) for k, s in enumerate(shares)]).drop("__p")
    counts = clean.groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    totals = clean.groupBy(*by).agg(*plain)
    ranked = running(counts, by, ["__v"], "__v", "__c", "__upto")
    held = null_safe_join(ranked, totals.select(*by, F.col("n").alias("__n")), by)
    # The value at rank k (from 0) is the one whose running count first exceeds k.
    at = lambda k: F.max(F.when((F.col("__upto") > k) & (F.col("__upto") - F.col("__c") <= k), F.col("__v")))
    found = []
    for k, s in enumerate(shares):
        rank = F.lit(float(s)) * (F.col("__n") - 1)
        found += [at(F.floor(rank)).alias(f"__lo{k}"), at(F.ceil(rank)).alias(f"__hi{k}"), F.first(rank - F.floor(rank)).alias(f"__w{k}")]
    values = held.groupBy(*by).agg(*found)
    mixed = [F.round(F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * F.col(f"__w{k}"), 6).alias(name(s)) for k, s in enumerate(shares)]
    return null_safe_join(totals, values.select(*by, *mixed), by)
