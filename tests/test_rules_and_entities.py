import random

import pytest
from pyspark.sql import functions as F

from tessarine.functions import entities, parsing, text
from tessarine.operators import contracts, linkage, rules, scoring
from tessarine.plans import catalog


@pytest.mark.parametrize(("said", "flags"), [
    ("The winner must be sworn in; it will resolve to 'Other' otherwise.", ["fallback_other", "requires_take_office"]),
    ("By-elections are not included.", ["by_elections_excluded"]),
    ("Overtime counts; a shootout is excluded.", ["overtime_excluded", "shootout_excluded"]),
    ("Extra time will count.", ["overtime_included"]),
    ("If canceled, it pays 50-50.", ["cancelled_event_half_payout"]),
    ("Stat corrections are ignored.", ["stat_corrections_excluded"]),
    (None, []), ("", []),
])
def test_material_flags(spark, said, flags):
    assert spark.createDataFrame([(said,)], "t string").select(rules.material_flags(F.col("t")).alias("f")).first().f == flags


def test_profiles_and_verdicts(spark):
    a = "The official certification decides, per the Associated Press, by March 3, 2027."
    rows = [(a, a), (a, "Officially declared winner per Reuters."), (a, None), (a + " Overtime is included.", a + " Overtime is not included."), (a, a.replace("Associated Press", "NOAA"))]
    df = spark.createDataFrame(rows, "x string, y string").select(rules.profile(F.col("x")).alias("a"), rules.profile(F.col("y")).alias("b"))
    got = [(r.s.verdict, r.s.reason, r.l.verdict) for r in df.select(rules.compare(F.col("a"), F.col("b"), F.lit(True)).alias("s"), rules.compare(F.col("a"), F.col("b"), F.lit(False)).alias("l")).collect()]
    assert got == [
        ("EXACT", None, "EXACT"), ("REVIEW", "basis differs", "REVIEW"), ("REVIEW", "rules missing", "COMPATIBLE"),
        ("REVIEW", "overtime_included vs overtime_excluded", "REVIEW"), ("REVIEW", "sources differ", "REVIEW"),
    ]
    first = df.first().a
    assert first.basis == "certified_result" and first.sources == ["credible_reporting"] and first.coverage == 1.0 and first.deadline == 1_804_118_399


def test_entities(spark):
    names = [("J. D. Vance", "jd vance"), ("Man Utd", "manchester united"), ("The Alba A. Noor Jr.", "alba noor"), ("FC", ""), (None, ""), ("José Ramírez", "jose ramirez")]
    got = spark.createDataFrame(names, "n string, want string").select("want", entities.canonical_entity(F.col("n")).alias("c")).collect()
    assert [r.c for r in got] == [r.want for r in got]
    more = spark.createDataFrame([("Lads",)], "n string").select(entities.canonical_entity(F.col("n"), {"lads": "alba town"}).alias("c")).first().c
    assert more == "alba town"
    pairs = [("alba noor", "noor alba", 0.98), ("alba noor", "alba noor", 1.0), ("", "x", 0.0), ("alba maria noor lopez ruiz", "alba maria noor lopez ruis", None)]
    scores = [r.s for r in spark.createDataFrame(pairs, "a string, b string, want double").select(entities.equivalence(F.col("a"), F.col("b")).alias("s")).collect()]
    assert scores[:3] == [0.98, 1.0, 0.0] and 0.6 < scores[3] < 0.92
    verdicts = [r.v for r in spark.createDataFrame([("Alba Noor", "Noor"), ("Alba", None), ("Alba Noor", "Milo Vant")], "a string, b string").select(entities.entity_verdict(F.col("a"), F.col("b")).alias("v")).collect()]
    assert verdicts == [True, None, False]
    alike = spark.createDataFrame([("the certified result of the cup", "certified result of the cup")], "a string, b string").select(entities.identity_similarity(F.col("a"), F.col("b")).alias("s"), entities.sources_compatible(F.col("a"), F.lit("qqq")).alias("c")).first()
    assert alike.s > 0.8 and alike.c is False


def test_cutoffs(spark):
    said = ["before September 16", "by Sep 15, 2027", "before 2027", "by January 1 2027", "on May 3", "no date", None]
    held = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, t string").select("k", parsing.cutoff(F.col("t")).alias("c"))
    got = {r.k: r.c and tuple(r.c) for r in held.collect()}
    assert got == {0: ("before", None, 9, 16), 1: ("by", 2027, 9, 15), 2: ("before", 2027, 1, 1), 3: ("by", 2027, 1, 1), 4: ("on", None, 5, 3), 5: None, 6: None}
    pairs = held.alias("a").join(held.alias("b"), F.col("a.k") < F.col("b.k"), "inner")
    agreeing = {(r[0], r[1]) for r in pairs.where(parsing.cutoffs_agree(F.col("a.c"), F.col("b.c"))).select("a.k", "b.k").collect()}
    assert agreeing == {(0, 1)}


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([("KX-27MAR14-A", "on 2027-02-30 or 2027-03-01", 7.9, "above $25k"), ("KX-27FEB30", None, -7.9, "dip to 3"), (None, "2026", float("nan"), None)], "t string, d string, q double, a string")
    got = df.select(parsing.ticker_date(F.col("t")).cast("string").alias("t"), parsing.iso_date(F.col("d")).cast("string").alias("d"), parsing.whole(F.col("q")).alias("q"), parsing.asset_threshold(F.col("a")).alias("a"), parsing.direction(F.col("a")).alias("w"), parsing.explicit_year(F.col("d")).alias("y")).collect()
    assert [tuple(r) for r in got] == [("2027-03-14", None, 7, 25_000.0, "above", 2027), (None, None, -7, None, "below", None), (None, None, None, None, None, 2026)]
    ranges = '[{"start": 0, "end": 0.1, "step": 0.001}]'
    tick = spark.range(1).select(parsing.tick_size(F.lit(ranges), F.lit(0.05)).alias("a"), parsing.tick_size(F.lit(ranges), F.lit(0.5)).alias("b"), parsing.tick_size(F.lit("x"), F.lit(0.5)).alias("c"), parsing.ceil_to(F.lit(0.07 * 100 * 0.5 * 0.5), 10_000).alias("d"), parsing.canonical(F.lit("btc"), {"btc": "bitcoin"}).alias("e")).first()
    assert tuple(tick) == (0.001, 0.01, 0.01, 1.7501, "bitcoin")
    seasons = [r.s for r in spark.createDataFrame([("2026-2027",), ("2026 - 27",), ("2026/27",), ("x",)], "t string").select(text.season_key(F.col("t")).alias("s")).collect()]
    assert seasons == ["2026-2027", "2026-2027", "2026", None]


def test_pair_probabilities(spark):
    rows = [(k, k / 200 if k % 7 else None, (k > 100) if k % 3 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, f double, same boolean")
    got = {r.k: r for r in scoring.decided(scoring.pair_probabilities(df, "k", ["f"], "same"), 0.5).collect()}
    assert len(got) == 200 and got[190].decision == "PASS" and got[10].decision == "REJECT" and all(0 <= r.probability <= 1 for r in got.values())
    assert scoring.decided(scoring.pair_probabilities(df.where("same"), "k", ["f"], "same"), 0.5).first().decision == "UNRESOLVED"


def test_full_signature(spark):
    row = ("Will Alba Noor win the 2027-28 women's FIFA World Cup?", "Overtime is included. Reuters decides by March 3, 2028.", "https://www.official-source.com Gazette", None)
    df = spark.createDataFrame([(1, *row), (2, "Will the Republicans win more than 50 seats in the US House in Texas TX-07?", None, None, None), (3, None, None, None, None)], "i int, title string, rules string, source string, closes timestamp")
    got = {r.i: r for r in contracts.signatures(df, ["i"], "title", None, [], "rules", "source", ["closes"]).collect()}
    a, b = got[1], got[2]
    assert (a.domain, a.proposition, a.subject, a.competition, a.season, a.flags, a.source_families, a.gender) == ("sports", "winner", "Alba Noor", "fifa_world_cup", "2027-2028", ["overtime_included"], ["credible_reporting"], "women")
    assert (b.office, b.country, b.region, b.district, b.metric, b.threshold_op, b.threshold_low, b.family) == ("us_house", "US", "US-TX", "US-TX-07", "seats", "gt", 50.0, "numeric:seats:above_threshold")
    assert got[3].domain == "other" and got[3].proposition is None and got[3].coverage == 0.0


def test_texts_are_brought_into_their_form_once(spark):
    rows = [("Will Ann Lee win in 2026?", "Ann Lee to win 2026"), ("Zoë & co", "zoe co"), ("", "x"), (None, "x"), ("ab", "ab")]
    df = spark.createDataFrame(rows, "a string, b string").select(F.round(entities.identity_similarity(F.col("a"), F.col("b")), 6).alias("s"))
    # Once for the Python side and once for what is left: the form stands in no lambda.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 12
    got = [r.s for r in df.collect()]
    assert got[2:] == [0.0, 0.0, 1.0] and 0.5 < got[0] < 1.0 and got[1] == 1.0


def test_names_that_are_one_entity_meet_however_they_begin(spark, tmp_path):
    rest = ("goals", "2026")
    left = [(1, "The Ann Lee", *rest), (2, "Kathryn Holtmann", *rest), (3, "Lee", *rest), (4, "Milo Vant", *rest)]
    right = [(10, "Ann Lee", *rest), (11, "Cathryn Holtmann", *rest), (12, "Ann Lee", "goals", "2027")]
    for name, rows in (("kalshi_signature", left), ("poly_signature", right)):
        spark.createDataFrame(rows, "sig_id bigint, subject string, metric string, season_year string").write.parquet(f"{tmp_path}/{name}.parquet")
    assert {tuple(r) for r in catalog.QUERIES["e6_entity_verdicts"](spark, str(tmp_path)).collect()} == {(1, 10, True), (2, 11, True), (3, 10, True)}


def test_same_entities_are_those_of_every_pair(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abe") for _ in range(rng.randint(1, 9)))
    names = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)]

    def slip(name):
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(name))
            name = name[:k] + rng.choice(["", "x", name[k] + "y"]) + name[k + 1 :] or "z"
        return " ".join(name.split())

    left = [(k % 3, n) for k, n in enumerate(names)] + [(0, ""), (1, names[1])]
    right = [(k % 3, slip(n)) for k, n in enumerate(names * 3)] + [(k % 3, n.split(" ")[-1]) for k, n in enumerate(names)] + [(0, "")]
    a, b = spark.createDataFrame(left, "k int, x string"), spark.createDataFrame(right, "k int, z string")
    got = [tuple(r) for r in linkage.same_entities(a, b, ["k"], "x", "z").collect()]
    want = {tuple(r) for r in a.join(b, "k").where(entities.canonical_verdict(F.col("x"), F.col("z"))).select("k", "x", "z").collect()}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
