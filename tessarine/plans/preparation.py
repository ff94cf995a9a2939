"""Queries of the data-preparation operators: common units and UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.operators import timestamps, units
from tessarine.session import table

TIME_FIELDS = ["kalshi_close_time", "kalshi_settlement_time", "polymarket_end_date"]


#: Fields of a signature that tell something about the unit of its numbers.
NEIGHBOURS = ["domain", "proposition", "threshold_op", "resolution_source"]


def _thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["sig_id", "metric", "threshold_low", "threshold_high", "unit", *NEIGHBOURS]
    left = table(spark, sf_dir, "kalshi_signature").select(*columns, F.col("kalshi_title").alias("title"), F.lit("left").alias("side"))
    right = table(spark, sf_dir, "poly_signature").select(*columns, F.col("polymarket_question").alias("title"), F.lit("right").alias("side"))
    return left.unionByName(right)


def converted_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of both signature tables in the common unit of their metric, each unit held against the prediction."""
    return units.common_units(_thresholds(spark, sf_dir), "sig_id", "title", source="side", fields=NEIGHBOURS, check=True)


def p4_hidden_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ensemble makes of units that are hidden from it: those of one row in five.

    Counts by metric and outcome ('predicted' or 'review'), and how many of the guesses are right.
    """
    rows = _thresholds(spark, sf_dir)
    truth = units.common_units(rows, "sig_id", "title", source="side").where("unit_from in ('column', 'title')").select("sig_id", F.col("unit_found").alias("truth")).distinct()
    hide = F.pmod(F.xxhash64("sig_id"), F.lit(5)) == 0
    hidden = rows.withColumns({c: F.when(~hide, F.col(c)) for c in ("unit", "title")})
    told = units.common_units(hidden, "sig_id", "title", source="side", fields=NEIGHBOURS).where("unit_from in ('predicted', 'review')")
    return told.join(truth, "sig_id").groupBy("metric", "unit_from").agg(F.count("*").alias("n"), F.count_if(F.col("unit_found") == F.col("truth")).alias("right_guesses"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs of the ladder that a signature's converted bounds lie on."""
    rungs = table(spark, sf_dir, "strike_ladder").select("rung_id", F.lower("metric").alias("metric"), "low", "high", "tolerance")
    rows = converted_thresholds(spark, sf_dir).select("sig_id", "metric", "common_low", "common_high")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col("tolerance") * (1 + 1e-9)
    on = (near("common_low", "low")) & (near("common_high", "high") | (F.col("high").isNull() & F.col("common_high").isNull()))
    return rows.join(rungs, "metric").where(on).select("rung_id", "sig_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time texts that denote the instant of a settlement slot."""
    rules = table(spark, sf_dir, "raw_settlement_rules").select("rule_id", "source_tz", *TIME_FIELDS)
    times = timestamps.melt_instants(rules, "rule_id", TIME_FIELDS, "source_tz").where("utc_ts is not null")
    whole = times.select("rule_id", "field_name", F.floor(F.unix_micros("utc_ts") / 1_000_000).alias("second"))
    slots = table(spark, sf_dir, "settlement_slot").select("slot_id", F.unix_seconds(F.col("slot_ts").cast("timestamp")).alias("second"))
    return whole.join(slots, "second").select("slot_id", "rule_id", "field_name").distinct()


QUERIES = {"p4_found": p4_found, "p4_hidden_units": p4_hidden_units, "p6_found": p6_found}
