import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessarine.functions import similarity, text
from tessarine.operators import analytics, ledger, linkage, ranking


def test_text_forms(spark):
    df = spark.createDataFrame([("Women's  A & B—Café 2026-27, at 1,250.5!", None), (None, "x"), ("", " ")], "a string, b string")
    got = df.select(
        text.plain_words(F.col("a")).alias("p"), text.spaced_words(F.col("a")).alias("s"), text.signature_text(F.col("a")).alias("g"), text.season_key(F.col("a")).alias("k"),
        text.number_texts(F.col("a")).alias("n"), text.first_filled(F.col("a"), F.col("b")).alias("f"), text.shorten(F.col("a"), 12).alias("t"),
    ).collect()
    assert got[0].p == "womens a and bcafe 2026 27 at 1 250 5" and got[0].s == "women s a b caf 2026 27 at 1 250 5"
    assert got[0].g == "women s a bcafe 2026-27 at 1 250.5" and got[0].k == "2026-2027" and got[0].n == ["2026", "27", "1250.5"]
    assert got[0].t == "Women's A &" and (got[1].f, got[2].f) == ("x", None) and got[1].p == "" and got[2].k is None


def test_similarity_of_empty_and_null(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"], [1.0, 0.0], [2.0, 0.0]), ([], [], [0.0, 0.0], [1.0, 0.0]), (None, ["a"], None, [1.0])], "x array<string>, y array<string>, u array<float>, v array<float>")
    got = df.select(similarity.jaccard(F.col("x"), F.col("y")).alias("j"), similarity.containment(F.col("x"), F.col("y")).alias("c"), similarity.cosine(F.col("u"), F.col("v")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(0.5, 1.0, 1.0), (0.0, 0.0, None), (None, None, None)]
    ratio = spark.createDataFrame([("abcd", "abxd"), (None, "a")], "a string, b string").select(similarity.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert ratio[0].r == 0.75 and ratio[1].r is None


def test_joins(spark):
    l = spark.createDataFrame([(1, None, 10.0), (2, "a", 20.0), (3, "a", 30.0)], "lid int, k string, at double")  # noqa: E741
    r = spark.createDataFrame([(7, None, 9.0), (8, "a", 20.0), (9, "a", 26.0)], "rid int, k string, at double")
    pairs = linkage.null_safe_join(l.select("lid", "k"), r.select("rid", "k"), ["k"]).select("lid", "rid").collect()
    assert {tuple(p) for p in pairs} == {(1, 7), (2, 8), (2, 9), (3, 8), (3, 9)}
    right = r.withColumnRenamed("rid", "v").withColumn("tie", F.col("v"))
    assert {(x.lid, x.out) for x in linkage.asof_join(l, right, "k", "at", "v", "out", "tie").collect()} == {(1, 7), (2, 8), (3, 9)}
    assert {(x.lid, x.out) for x in linkage.nearest_join(l, right, "k", "at", "v", "out", "tie").collect()} == {(1, 7), (2, 8), (3, 9)}
    near = linkage.range_join(l, r.withColumnRenamed("at", "other"), "k", "at", "other", 5.0).select("lid", "rid").collect()
    assert {tuple(x) for x in near} == {(2, 8), (3, 9)}
    assert linkage.range_join(l.limit(0), r.withColumnRenamed("at", "other"), "k", "at", "other", 5.0).count() == 0
    with pytest.raises(Exception, match="not unique"):
        linkage.validated_merge(l.select("lid", "k"), r.select("rid", "k"), "k").collect()


def test_nearest_prefers_the_earlier_of_two(spark):
    l = spark.createDataFrame([(1, "a", 10.0), (2, "b", 10.0)], "lid int, k string, at double")  # noqa: E741
    r = spark.createDataFrame([(5, "a", 8.0), (6, "a", 12.0)], "v int, k string, at double").withColumn("tie", F.col("v"))
    assert {(x.lid, x.out) for x in linkage.nearest_join(l, r, "k", "at", "v", "out", "tie").collect()} == {(1, 5), (2, None)}


def test_votes_and_groups(spark):
    l = spark.createDataFrame([(1, ["x", "y", "x"]), (2, None), (3, [])], "lid int, t array<string>")  # noqa: E741
    r = spark.createDataFrame([(7, ["x", "y"]), (8, ["z"])], "rid int, t array<string>")
    votes = linkage.vote_candidates(l, r, "lid", "rid", "t", 5).collect()
    assert [(v.lid, v.rid, v.votes) for v in votes] == [(1, 7, 2)]
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c"), ("h", "a")], "g string, m string")
    declared = spark.createDataFrame([("g", ["c", "b", "a"]), ("h", ["a", "b", "c"])], "g string, d array<string>")
    assert [x.g for x in linkage.exhaustive_groups(members, "g", "m", declared, "d", 3).collect()] == ["g"]


def test_ladder_known_values(spark):
    levels = spark.createDataFrame([("b", 0.31, 3.0, 1), ("b", 0.30, 2.0, 0), ("b", 0.0, 9.0, 2), ("c", 0.5, None, 0)], "book string, price double, size double, k int")
    got = {r.quantity: r for r in ledger.depth_fill(levels, "book", "price", "size", ["k"], [1, 4, 50]).collect()}
    assert (got[4.0].filled, got[4.0].cost, got[4.0].worst, got[4.0].levels) == (4.0, 1.22, 0.31, 2)
    assert (got[1.0].cost, got[50.0].filled) == (0.3, 5.0)


def test_ledger(spark):
    rows = [("a", 1, 5.0), ("a", 2, -3.0), ("a", 3, 9.0), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, n int, v double")
    got = [(r.k, r.n, r.balance, r.peak, r.drawdown) for r in ledger.running_balance(df, "k", ["n"], "n", "v").orderBy("k", "n").collect()]
    assert got == [("a", 1, 5.0, 5.0, 0.0), ("a", 2, 2.0, 5.0, 3.0), ("a", 3, 11.0, 11.0, 0.0), ("b", 1, None, None, None)]
    assert {(r.k, r.crossed_at) for r in ledger.first_crossing(df, "k", ["n"], "v", "n", 10.0).collect()} == {("a", 3), ("b", None)}
    assert [(r.k, r.n) for r in ledger.replenished(df, ["k"], ["n"], "n", "v", 0.5, 5.0).collect()] == [("a", 3)]
    assert [r.session_no for r in ledger.sessions(df, "k", "n", "v", 1.0).where("k = 'a'").orderBy("n").collect()] == [1, 1, 1]


def test_running_sums_of_a_hot_key_are_cut(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), k // 2, k, rng.choice([None, -2.0, 1.0, 4.0])) for k in range(600)]
    df = spark.createDataFrame(rows, "k string, n bigint, i int, v double").repartition(5)
    want = {}
    for key in {r[0] for r in rows}:
        total = peak = None
        for _, _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if v is not None:
                total = (total or 0.0) + v
                peak = total if peak is None else max(peak, total)
            want[i] = (total, peak)
    for parts in (1, 2, 9):
        for hot_rows in (50, 1_000):
            got = {r.i: (r.s, r.m) for r in ledger.running(df, ["k"], ["n", "i"], "n", "v", "s", "m", parts, hot_rows).collect()}
            assert got == want
    assert ledger.running(df.limit(0), ["k"], ["n", "i"], "n", "v", "s").count() == 0


def test_asof_of_a_hot_key_is_cut(spark):
    rng = random.Random(7)
    left = [(k, rng.choice(["hot", "hot", "a", None]), float(rng.randint(0, 300))) for k in range(300)]
    right = [(k, rng.choice(["hot", "hot", "a", None]), float(rng.randint(20, 300))) for k in range(200)]
    l, r = spark.createDataFrame(left, "lid int, k string, at double"), spark.createDataFrame(right, "v int, k string, at double").withColumn("tie", F.col("v"))  # noqa: E741
    got = {x.lid: x.out for x in linkage.asof_join(l, r, "k", "at", "v", "out", "tie", hot_rows=60).collect()}
    assert got == {i: max(((t, v) for v, q, t in right if q == k and t <= at), default=(0, None))[1] for i, k, at in left}


def test_rows_before_and_sessions_of_a_hot_key_are_cut(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["hot", "hot", "a", None]), rng.randint(0, 400)) for k in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, at int").repartition(4)
    want, numbers = {}, {}
    for key in ("hot", "a", None):
        before, n = None, 0
        for i, _, at in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            n += before is None or at - before > 3
            want[i], numbers[i], before = before, n, at
    for hot_rows in (20, 10_000):
        assert {r.i: r.b for r in ledger.previous(df, ["k"], ["at", "i"], "at", "at", "b", hot_rows=hot_rows).collect()} == want
        assert {r.i: r.session_no for r in ledger.sessions(df, "k", "at", "i", 3, hot_rows=hot_rows).collect()} == numbers


def test_fills_of_a_tape(spark):
    trades = [(1, "b", "yes", 5, 0.40, 3.0, False), (1, "b", "yes", 5, 0.40, 3.0, False), (2, "b", "yes", 6, 0.40, 2.0, True), (3, "b", "no", 6, 0.40, 9.0, False), (4, "b", "yes", 7, 0.40, 2.0, None), (5, "b", "yes", 8, 0.39, 1.0, False), (6, "b", "yes", 1, 0.30, 9.0, False)]
    probes = [(10, "b", "yes", 2, 0.40, 1.0, 4.0, 100), (11, "b", "yes", 2, 0.40, 9.0, 4.0, 100), (12, "b", "yes", 2, 0.40, 9.0, 4.0, 7), (13, "b", "no", 2, 0.30, 0.0, 1.0, 100)]
    t = spark.createDataFrame(trades, "trade_id int, book string, side string, at int, price double, size double, block boolean")
    p = spark.createDataFrame(probes, "probe_id int, book string, side string, placed_at int, price double, queue double, quantity double, until int")
    assert {(r.probe_id, r.filled_at, r.kind) for r in ledger.fresh_fills(t, p).collect()} == {(10, 7, "queue"), (11, 8, "through")}


def test_votes_of_rows_with_common_words_only(spark):
    l = spark.createDataFrame([(k, ["will", "win"]) for k in range(5)] + [(9, ["rare", "will"])], "lid int, toks array<string>")  # noqa: E741
    r = spark.createDataFrame([(20, ["win", "will", "win"]), (21, ["rare"]), (22, None)], "rid int, toks array<string>")
    got = {(x.lid, x.rid) for x in linkage.vote_candidates(l, r, "lid", "rid", "toks", 0.1, 2).collect()}
    assert got == {(k, 20) for k in range(5)} | {(9, 21)}


def test_ranking_and_rules(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(5)] + [("b", 9, 0.5), (None, 8, 2.5)], "g string, i int, s double")
    top = ranking.diversified_top(df, "g", [F.col("s").desc(), F.col("i")], 1, 4).collect()
    assert sorted(r.i for r in top) == [3, 4, 8, 9]
    rules = [("X", F.col("s") > 3), ("Y", F.col("g").isNull()), ("Z", F.col("s") > 2)]
    got = {r.i: (r.first, r.every) for r in df.select("i", ranking.first_reason(rules).alias("first"), ranking.all_reasons(rules).alias("every")).collect()}
    assert got[4] == ("X", ["X", "Z"]) and got[8] == ("Y", ["Y", "Z"]) and got[0] == (None, [])


def test_analytics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), ("a", None, 5.0), ("b", 1.0, 0.0)], "g string, v double, w double")
    got = {r.g: r.m for r in df.groupBy("g").agg(analytics.weighted_mean("v", "w").alias("m")).collect()}
    assert got == {"a": 1.0, "b": None}
    assert {(r.bin, r.n) for r in analytics.histogram(df, "v", 0.0, 2.0, 2).collect()} == {(2, 2), (3, 1)}
    assert analytics.describe(df.limit(0), ["g"], "v", [0.5]).count() == 0
    assert {(r.g, r.n, r.p50) for r in analytics.describe(df, ["g"], "v", [0.5]).collect()} == {("a", 2, 2.0), ("b", 1, 1.0)}
    assert {(r.g, r.p50) for r in analytics.describe(df, ["g"], "v", [0.5], exact=False).collect()} == {("a", 1.0), ("b", 1.0)}


def test_dates_are_utc(spark):
    assert spark.sql("select timestamp '2026-01-01 00:00:00' as t").first().t == dt.datetime(2026, 1, 1)


def test_votes_gather_nothing_on_the_driver(spark):
    left = spark.sql("select * from values (1L, array('ann', 'wins')), (2L, array('bob')) as v(l, t)")
    right = spark.sql("select * from values (7L, array('ann', 'lee')), (8L, array('bob')) as v(r, t)")
    found = linkage.vote_candidates(left, right, "l", "r", "t")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(x.l, x.r, x.votes) for x in found.collect()} == {(1, 7, 1), (2, 8, 1)}
