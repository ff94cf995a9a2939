import random

import pytest

from tessarine.operators import units

SCHEMA = "sig_id bigint, title string, side string, metric string, threshold_low double, threshold_high double, unit string, confidence string"


def rows_of(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r.sig_id: r for r in units.common_units(df, "sig_id", "title", source="side", **more).collect()}


def test_units_from_column_and_title(spark):
    got = rows_of(spark, [
        (1, "wind over 10", "l", "wind_speed", 10.0, None, " KN "),
        (2, "The price at least $0.007k in May", "l", "price", 0.007, None, "n/a"),
        (3, "The price at least US$5,000 in May", "l", "price", 5000.0, None, None),
        (4, "over 700¢?", "l", "price", 700.0, None, ""),
        (5, "between 10 degrees F and 14 degrees F", "l", "temperature", 10.0, 14.0, "-"),
        (6, "below 0 K", "l", "temperature", 0.0, None, None),
        (7, "from 451 to 700 US cents", "l", "price", 451.0, 700.0, None),
        (8, "2,345,000 kilowatt-hours", "l", "energy_output", 2345000.0, None, None),
        (9, "in 2028 the rate is at least 25 basis points in March 2028", "l", "interest_rate", 25.0, None, None),
        (10, None, "l", "votes", 1.2, None, "Million Votes"),
        (11, "no metric", "l", None, 1.0, None, "kg"),
        (12, "no bounds", "l", "votes", None, None, "votes"),
        (13, "nan", "l", "votes", float("nan"), None, "votes"),
        (14, "The price no less than $70 in April 2027", "l", "price", 70.0, None, None),
    ])
    want = {1: (18.52, None), 2: (7.0, None), 3: (5000.0, None), 4: (7.0, None), 5: (-12.2222222, -10.0), 6: (-273.15, None), 7: (4.51, 7.0), 8: (2345.0, None), 9: (0.25, None), 10: (1.2e6, None), 14: (70.0, None)}
    assert set(got) == set(want)
    for k, (low, high) in want.items():
        assert got[k].common_low == pytest.approx(low) and got[k].common_high == (None if high is None else pytest.approx(high))
        assert got[k].confidence == 1.0


def test_missing_units_are_predicted_or_reviewed(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for k in range(3000):
        unit, scale = rng.choice([("kg", 1.0), ("g", 1000.0), ("t", 0.001)])
        value = round(rng.uniform(200, 900) * scale, 4)
        hidden = k % 10 == 0
        truth[k] = unit
        rows.append((k, "no unit here", "l", "payload_mass", value, None, None if hidden else unit))
    rows.append((9999, "odd one", "l", "votes", 3.0, None, None))
    got = rows_of(spark, rows)
    guessed = [r for r in got.values() if r.unit_from == "predicted"]
    names = {"kg": "kg", "g": "g", "t": "tonne"}
    assert len(got) == 3001 and len(guessed) > 200
    assert sum(r.unit_found == names[truth[r.sig_id]] for r in guessed) >= 0.97 * len(guessed)
    assert got[9999].unit_from == "review" and got[9999].common_low is None


def test_other_spellings_metrics_and_doubtful_units(spark):
    rng = random.Random(5)
    rows = [(k, "no unit", rng.choice("lr"), "payload_mass", round(rng.uniform(200, 900), 3), None, "kg") for k in range(1500)]
    rows += [(k, "no unit", "l", "payload_mass", round(rng.uniform(0.2, 0.9), 6), None, "t") for k in range(1500, 3000)]
    rows += [(8000, "over 5 kg", "l", "payload_mass", 5.0, None, "kgz"), (8001, "x", "l", "brightness", 5.0, None, "lumen"), (8002, "x", "l", "payload_mass", 500.0, None, "t"), (8003, "x", "l", "payload_mass", 450.0, None, "kg")]
    got = rows_of(spark, rows, check=True)
    assert (got[8000].unit_from, got[8000].common_low) == ("title", 5.0)
    assert (got[8001].unit_from, got[8001].common_low) == ("review", None)
    assert got[8002].doubtful and got[8002].common_low == 500_000 and got[8003].doubtful is False


def test_empty_table(spark):
    assert units.common_units(spark.createDataFrame([], SCHEMA), "sig_id", "title").count() == 0


def test_every_spelling_is_unambiguous():
    for metric, every in units.UNITS.items():
        names = [a for _, _, _, own in every for a in own]
        assert len(names) == len(set(names)), metric
        assert all(a == a.lower() for a in names)
