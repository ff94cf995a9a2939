"""Queries that run as streams over all of a table, each beside the SQL of the finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.plans.relational import ORACLE_SQL, QUERIES
from tessarine.streaming import state


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream reads folders


def cycle_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every hour and kind, kept as a running aggregate."""
    events = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    totals = state.drain(state.cycle_totals(events, "at", "1 hour", "10 minutes", ["event_type"], "value"), "complete")
    return totals.select(F.date_format("cycle_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 3).alias("total"), F.round("most", 4).alias("most"))


def once_per_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows without second deliveries that come within a year of the first."""
    audits = _stream(spark, sf_dir, "match_audit").where("audit_id is not null and audited_at is not null").select("audit_id", "verdict", F.col("audited_at").cast("timestamp").alias("at"))
    return state.drain(state.once_per_key(audits, ["audit_id"], "at", "366 days"), "append").select("audit_id", "verdict")


def stream_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event at which the values of a user have filled an order of 500, kept as keyed state."""
    trades = _stream(spark, sf_dir, "events").where("value > 0 and not isnan(value)")
    tape = trades.select(F.col("user_id").cast("string").alias("order_id"), F.col("ts").cast("timestamp").alias("trade_at"), F.col("value").alias("size"), F.lit(500.0).alias("needed")).withWatermark("trade_at", "1 day")
    filled = state.drain(state.fills(tape, 10 * 366 * 86_400_000), "append").where("status = 'FILLED'")
    return filled.select("order_id", F.unix_micros("filled_at").alias("filled_us"), F.round("filled", 3).alias("filled"))


QUERIES |= {"m15_stream_cycles": cycle_totals, "m14_stream_once": once_per_audit, "m14_stream_fills": stream_fills}
ORACLE_SQL |= {
    "m15_stream_cycles": "select strftime(ts, '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 3) as total, round(max(value), 4) as most from events group by 1, 2",
    "m14_stream_fills": """
        with r as (select user_id, ts, value, sum(value) over (partition by user_id order by ts, value rows unbounded preceding) as run from events where value > 0 and not isnan(value)),
        f as (select *, row_number() over (partition by user_id order by ts, value) as k from r where run >= 500)
        select user_id::varchar as order_id, epoch_us(ts) as filled_us, round(run, 3) as filled from f where k = 1""",
    "m14_stream_once": "select distinct audit_id, verdict from match_audit where audit_id is not null and audited_at is not null",
}
