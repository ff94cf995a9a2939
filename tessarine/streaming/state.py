"""Streams: deduplication, cycle aggregates, and per-key state with time-outs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessarine.session import checkpoint_dir

FILL_OUT = "order_id string, filled double, filled_at timestamp, status string"
FILL_STATE = "needed double, filled double, done boolean"


def once_per_key(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each key once, as long as its repeats are at most ``late`` apart."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def cycle_totals(stream: DataFrame, at: str, cycle: str, late: str, by: list[str], value: str) -> DataFrame:
    """Count, sum and maximum of ``value`` for every cycle of event time and group."""
    held = stream.withWatermark(at, late).groupBy(F.window(at, cycle), *by)
    return held.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")).select(F.col("window.start").alias("cycle_start"), *by, "n", "total", "most")


def fills(trades: DataFrame, ttl_ms: int) -> DataFrame:
    """Orders filled by a tape of trades: (order_id, trade_at, size, needed) with a watermark on trade_at.

    The state of an order is how much of it has been met. It ends with status FILLED at the trade that
    completes it, or EXPIRED when ``ttl_ms`` of event time pass without one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        needed, filled, done = state.get if state.exists else (None, 0.0, False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame({"order_id": [key[0]], "filled": [filled], "filled_at": [pd.NaT], "status": ["EXPIRED"]})
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["trade_at", "size"])
        for r in rows.itertuples():
            needed = r.needed if needed is None else needed
            if done:
                break
            filled += r.size
            if filled >= needed:
                done = True
                yield pd.DataFrame({"order_id": [key[0]], "filled": [filled], "filled_at": [r.trade_at], "status": ["FILLED"]})
        state.update((needed, filled, done))
        state.setTimeoutTimestamp(max(int(rows["trade_at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_ms)

    return trades.groupBy("order_id").applyInPandasWithState(step, FILL_OUT, FILL_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def fills_batch(trades: DataFrame) -> DataFrame:
    """The filled orders of a finished tape, for comparison with the stream."""
    from pyspark.sql import Window

    w = Window.partitionBy("order_id").orderBy("trade_at", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = trades.withColumn("filled", F.sum("size").over(w)).where(F.col("filled") >= F.col("needed"))
    return run.groupBy("order_id").agg(F.min_by("filled", "filled").alias("filled"), F.min("trade_at").alias("filled_at"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is and read what it has written to the shared folder.

    In complete mode each batch replaces the table, so the last one is the result; in append mode the
    file sink adds to it exactly once.
    """
    spark = stream.sparkSession
    place = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{place}/table"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
