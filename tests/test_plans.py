import datetime as dt

import pytest

from tessarine.functions import registry
from tessarine.plans import catalog, preparation
from tessarine.session import local_session


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_p4_found(spark, tmp_path):
    rungs = [(1, "price", 70.0, None, "usd", 0.14), (2, "price", 70.0, 100.0, "usd", 0.14), (3, "temperature", 10.0, None, "degC", 0.15), (4, "votes", 70.0, None, "count", 1.0)]
    save(spark, tmp_path, "strike_ladder", rungs, "rung_id bigint, metric string, low double, high double, unit string, tolerance double")
    schema = "sig_id bigint, {} string, metric string, threshold_low double, threshold_high double, unit string, domain string, proposition string, threshold_op string, resolution_source string"
    rest = (None, "threshold", "ge", None)
    left = [(10, "over $70 in May", "price", 70.0, None, None), (11, "from 7,000 cents to $100", "price", 7000.0, 10000.0, "US cents"), (12, "at least 50.2 F", "temperature", 50.2, None, None), (13, None, None, None, None, None), (10, "over $70 in May", "price", 70.0, None, None)]
    right = [(20, "below 0.07 k USD", "price", 0.07, None, "-"), (21, "above 70.2 usd", "price", 70.2, None, "usd"), (22, "x", "votes", 70.0, 90.0, "votes")]
    save(spark, tmp_path, "kalshi_signature", [(*r, *rest) for r in left], schema.format("kalshi_title"))
    save(spark, tmp_path, "poly_signature", [(*r, *rest) for r in right], schema.format("polymarket_question"))
    got = [tuple(r) for r in preparation.p4_found(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(1, 10), (1, 20), (2, 11), (3, 12)]


def test_p6_found(spark, tmp_path):
    save(spark, tmp_path, "settlement_slot", [(5, "x", dt.datetime(2027, 3, 14, 7, 30)), (6, "y", dt.datetime(2027, 3, 14))], "slot_id bigint, slot_name string, slot_ts timestamp")
    rows = [
        (1, "2027-03-14T07:30:00.999Z", "2027-03-14", "soon", None),
        (2, "03/14/2027 2:30 AM", None, "", "America/New_York"),
        (2, "03/14/2027 2:30 AM", None, "", "America/New_York"),
        (3, "1805009400", "14.03.2027 09:00", "14/03/2027 01:00", "Europe/Berlin"),
    ]
    save(spark, tmp_path, "raw_settlement_rules", rows, "rule_id bigint, kalshi_close_time string, kalshi_settlement_time string, polymarket_end_date string, source_tz string")
    got = sorted(tuple(r) for r in preparation.p6_found(spark, str(tmp_path)).collect())
    assert got == sorted([(5, 1, "kalshi_close_time"), (6, 1, "kalshi_settlement_time"), (5, 2, "kalshi_close_time"), (5, 3, "kalshi_close_time"), (6, 3, "polymarket_end_date")])


def test_catalog_is_consistent():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES
    assert not any(name.startswith("p") and name not in ("p4_found", "p4_hidden_units", "p6_found") for name in catalog.QUERIES)


def test_functions_in_sql(spark):
    names = registry.register(spark)
    row = spark.sql("""select plain_words("Women's A&B") as p, spaced_words('A-b') as s, token_jaccard(array('a'), array('a', 'b')) as j, stable_sigmoid(-800D) as z,
        ascii_text('Café') as a, round(sequence_likeness('abcd', 'abxd'), 2) as l, utc_micros('1970-01-01 01:00', 'Europe/Berlin') as u""").first()
    assert (row.p, row.s, row.j, row.z, row.a, row.l, row.u) == ("womens a and b", "a b", 0.5, 0.0, "Cafe", 0.75, 0)
    assert len(names) == 7


@pytest.mark.parametrize("name", ["g10_asof_join", "n12_describe"])
def test_plans_read_only_what_they_need(spark, tmp_path, name):
    save(spark, tmp_path, "events", [(1, dt.datetime(2026, 1, 1), 2, "click", 1.0, "{}")], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_session_is_reused():
    assert local_session() is local_session()


@pytest.mark.parametrize(("name", "want"), [
    ("e6_entity_verdicts", {(1, 10, True), (1, 12, None), (2, 10, None), (2, 11, None), (2, 12, None), (3, 11, False), (3, 12, None)}),
    ("e9_anchors", {(1, 10, 1.0, True, True), (3, 11, 0.5, False, False)}),
])
def test_names_are_brought_into_their_form_before_they_meet(spark, tmp_path, name, want):
    schema = "sig_id bigint, {} string, subject string, metric string, season_year string"
    rest = ("goals", "2026")
    save(spark, tmp_path, "kalshi_signature", [(1, "x", "Ann Lee", *rest), (2, "x", None, *rest), (3, "in 2026", "Bob Ray", *rest), (4, "x", "Ann Lee", None, "2026")], schema.format("kalshi_title"))
    save(spark, tmp_path, "poly_signature", [(10, "x", "Lee Ann Jr", *rest), (11, "in 2027", "Bob Kim", *rest), (12, "x", None, *rest)], schema.format("polymarket_question"))
    if name == "e6_entity_verdicts":  # only names that begin alike meet
        save(spark, tmp_path / "alike", "kalshi_signature", [(1, "x", "Ann Lee", *rest), (2, "x", None, *rest), (3, "in 2026", "Bob Ray", *rest)], schema.format("kalshi_title"))
        save(spark, tmp_path / "alike", "poly_signature", [(10, "x", "Ann Lee Jr", *rest), (11, "x", "Bob Kim", *rest), (12, "x", None, *rest)], schema.format("polymarket_question"))
        tmp_path = tmp_path / "alike"
    found = catalog.QUERIES[name](spark, str(tmp_path))
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "translate(" not in above
    assert {tuple(r) for r in found.collect()} == want
