import datetime as dt
import random

from tessarine.llm import topn
from tessarine.llm.topn import top_n

SCHEMA = "ticker string, strategy string, net_profit double, signal_id bigint, logged_at timestamp, rank string"


def brute(rows, n):
    groups = {}
    for t, s, p, i, at, _ in rows:
        if None not in (t, s, p, i) and p == p:
            groups.setdefault((t, s), set()).add((-p, at or dt.datetime.max, i))
    return {(*g, i, k + 1) for g, items in groups.items() for k, (_, _, i) in enumerate(sorted(items)[:n])}


def test_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        hot = rng.random() < 0.4
        rows.append((
            "HOT" if hot else rng.choice(["A", "B", None, ""]),
            "x" if hot else rng.choice(["x", "y", None]),
            rng.choice([None, float("nan"), float("inf"), 1.0, 2.0, rng.random()]),
            i if i % 50 else None,
            rng.choice([None, dt.datetime(2026, 1, rng.randint(1, 28))]),
            "clash",
        ))
    rows += rng.sample(rows, 800)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for n in (1, 3, 10):
        got = {tuple(r) for r in top_n(df, ["ticker", "strategy"], "net_profit", "signal_id", n, tie="logged_at").select("ticker", "strategy", "signal_id", "rank").collect()}
        assert got == brute(rows, n)


def test_buffers_of_many_small_groups_go_on_to_the_merge(spark, monkeypatch):
    monkeypatch.setattr(topn, "SHRINK_ROWS", 64)
    monkeypatch.setattr(topn, "HELD_ROWS", 100)
    rng = random.Random(2)
    rows = [(f"t{rng.randrange(900)}", "x", rng.random(), i, None, "clash") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    got = {tuple(r) for r in top_n(df, ["ticker", "strategy"], "net_profit", "signal_id", 3, tie="logged_at").select("ticker", "strategy", "signal_id", "rank").collect()}
    assert got == brute(rows, 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_n(df, ["ticker", "strategy"], "net_profit", "signal_id", 3, tie="logged_at").collect() == []


def test_without_tie_column(spark):
    df = spark.createDataFrame([("A", 1.0, 5), ("A", 1.0, 4), ("A", 0.5, 1)], "g string, s double, i bigint")
    assert [r.i for r in top_n(df, ["g"], "s", "i", 2).orderBy("rank").collect()] == [4, 5]
