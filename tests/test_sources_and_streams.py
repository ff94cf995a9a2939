import json

import pytest
from pyspark.sql import functions as F

from tessarine.sources import readers
from tessarine.streaming import state


def pages(folder, n):
    for k in range(n):
        rows = [{"trade_id": f"t{k}-{i}", "ticker": "A", "created_time": None, "yes_price_dollars": "0.5" if i else "bad", "count_fp": i, "is_block_trade": False, "extra": 1} for i in range(3)]
        (folder / f"page-{k:03}.json").write_text(json.dumps({"trades": rows, "cursor": str(k)}))


def test_paged_feed_batch_and_stream(spark, tmp_path):
    readers.register(spark)
    (tmp_path / "feed").mkdir()
    pages(tmp_path / "feed", 4)
    options = {"path": str(tmp_path / "feed"), "items": "trades"}
    df = spark.read.format("paged_feed").options(**options).schema(readers.TRADE).load()
    assert df.count() == 12 and df.where("yes_price_dollars is null").count() == 4
    stream = spark.readStream.format("paged_feed").options(**options).schema(readers.TRADE).load()
    q = stream.writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("feed").count() == 12
    # A page that comes later under a smaller name is read once, and no other page again.
    (tmp_path / "feed" / "page-000-late.json").write_text(json.dumps({"trades": [{"trade_id": "late"}]}))
    (tmp_path / "feed" / "a-first-name.json").write_text(json.dumps([{"trade_id": "first"}]))
    out = str(tmp_path / "out")
    for _ in range(2):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination(120)
        (tmp_path / "feed" / "0.json").write_text(json.dumps([{"trade_id": "zero"}]))
    assert sorted(r.trade_id for r in spark.read.parquet(out).collect() if "-" not in r.trade_id) == ["first", "late", "zero"]
    assert spark.read.parquet(out).count() == 15


def test_cache_refuses_a_downgrade(spark, tmp_path):
    cache = readers.Cache(spark, str(tmp_path / "cache"))
    df = spark.range(20).selectExpr("id % 10 as k", "id as v")
    assert cache.read() is None
    assert cache.refresh(df, "k", [F.col("v").desc()])
    assert not cache.refresh(df.where("k < 2"), "k", [F.col("v").desc()])
    assert not cache.refresh(df.limit(0), "k", [F.col("v").desc()])
    assert {r.v for r in cache.read().collect()} == set(range(10, 20))
    assert cache.read(ttl_seconds=-1) is None and cache.read(ttl_seconds=-1, allow_stale=True) is not None


def test_lines_tables_and_watchlist(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"trade_id": "a", "count_fp": 2}\nnot json\n')
    got = readers.read_lines(spark, str(tmp_path / "rows.jsonl"), readers.TRADE).collect()
    assert sorted(str(r._corrupt) for r in got) == ["None", "not json"]
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "ticker string, net double")
    assert readers.write_watchlist(df, str(tmp_path / "w.json"), [F.col("net").desc()], 2, "v1") == 2
    assert [r["ticker"] for r in json.loads((tmp_path / "w.json").read_text())["rows"]] == ["b", "c"]
    assert readers.write_watchlist(df, "file://" + str(tmp_path / "w.json"), [F.col("net").desc()], 1, "v1") == 1
    schema = "ticker string, net double"
    held = readers.read_watchlist(spark, str(tmp_path / "w.json"), spark.createDataFrame([], schema).schema, "v1")
    assert [tuple(r) for r in held.collect()] == [("b", 3.0)]
    with pytest.raises(ValueError, match="v2"):
        readers.read_watchlist(spark, str(tmp_path / "w.json"), held.schema, "v2")
    for kind in ("csv", "json"):
        readers.append_rows(df, str(tmp_path / kind), ["net", "missing"], kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["net", "missing"] and spark.read.json(str(tmp_path / "json")).count() == 3
    assert readers.write_run_tables({"trades": (df, ["ticker"]), "equity": (df, ["net"])}, str(tmp_path / "many"), "r2") == ["equity", "trades"]
    assert spark.read.parquet(str(tmp_path / "many" / "equity")).columns == ["net", "run_id"]
    readers.append_run(df, str(tmp_path / "runs"), "r1", ["ticker", "missing"])
    assert spark.read.parquet(str(tmp_path / "runs")).columns == ["ticker", "missing", "run_id"]


def test_ladder_and_token_columns(spark):
    df = spark.createDataFrame([([(0.4, 1.0), (0.3, 2.0), (0.0, 5.0)], '["n","y"]', '["No","Yes"]'), ([], '["a"]', None)], "asks array<struct<price:double,size:double>>, ids string, outs string")
    got = df.select(readers.tidy_quotes("asks", "ask").alias("best"), readers.ordered_tokens("ids", "outs").alias("ids")).collect()
    assert (got[0].best.price, got[0].ids, got[1].best, got[1].ids) == (0.3, ["y", "n"], None, ["a"])


def test_stream_fills_equal_the_batch(spark, tmp_path):
    rows = [(f"o{k % 7}", f"2026-01-01 00:0{k % 10}:00", float(k % 4 + 1), 9.0) for k in range(60)]
    df = spark.createDataFrame(rows, "order_id string, at string, size double, needed double").select("order_id", F.to_timestamp("at").alias("trade_at"), "size", "needed")
    df.coalesce(1).write.parquet(str(tmp_path / "tape"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "tape")).withWatermark("trade_at", "1 minute")
    q = state.fills(stream, 300_000).writeStream.format("memory").queryName("fills").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.order_id, r.filled, r.filled_at) for r in spark.table("fills").where("status = 'FILLED'").collect()}
    assert got == {tuple(r) for r in state.fills_batch(df).select("order_id", "filled", "filled_at").collect()}


def test_stream_cycles_and_deduplication(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-01-01 00:00:05", 2.0), (1, "2026-01-01 00:00:06", 2.0), (2, "2026-01-01 00:01:05", 4.0)], "k int, at string, v double").select("k", F.to_timestamp("at").alias("at"), "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("dedup", state.once_per_key(source(), ["k"], "at", "1 hour"), "append"), ("cycles", state.cycle_totals(source(), "at", "1 minute", "10 seconds", ["k"], "v"), "complete")):
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(180)
    assert spark.table("dedup").count() == 2
    assert {(r.k, r.n, r.total) for r in spark.table("cycles").collect()} == {(1, 2, 4.0), (2, 1, 4.0)}
