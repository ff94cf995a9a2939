"""The scalar functions under names for SQL, for ad-hoc queries of a session."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessarine.operators.timestamps import to_micros, tz_version

#: SQL bodies of functions that built-ins can express.
BODIES = {
    "plain_words(t STRING) RETURNS STRING": "trim(regexp_replace(regexp_replace(replace(lower(t), '&', ' and '), '[\\'\"]', ''), '[^a-z0-9]+', ' '))",
    "spaced_words(t STRING) RETURNS STRING": "trim(regexp_replace(lower(t), '[^a-z0-9]+', ' '))",
    "token_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "case when a is null or b is null then null when size(array_union(a, b)) = 0 then 0 else size(array_intersect(a, b)) / size(array_union(a, b)) end",
    "stable_sigmoid(x DOUBLE) RETURNS DOUBLE": "case when x >= 0 then 1 / (1 + exp(-x)) else exp(x) / (1 + exp(x)) end",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known as temporary functions; returns their names."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    version = tz_version()

    @F.pandas_udf("string")
    def ascii_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")

    @F.pandas_udf("double")
    def sequence_likeness(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)], dtype="float64")

    @F.pandas_udf("bigint")
    def utc_micros(texts: pd.Series, zones: pd.Series) -> pd.Series:
        return pd.Series(to_micros(texts, zones, version), dtype="Int64")

    named = {"ascii_text": ascii_text, "sequence_likeness": sequence_likeness, "utc_micros": utc_micros}
    for name, function in named.items():
        spark.udf.register(name, function)
    return [h.split("(")[0] for h in BODIES] + list(named)
