"""Dates, cut-offs, thresholds and prices read from text and JSON, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessarine.functions.text import plain_words

# Names of months, and words that compare a number.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
COMPARISONS = {
    "ge": ["at least", "greater than or equal to"],
    "gt": ["more than", "greater than", "above", "over"],
    "le": ["at most", "less than or equal to"],
    "lt": ["less than", "fewer than", "below", "under"],
}
ABOVE = ["above", "over", "greater than", "higher than", "exceed", "close above"]
BELOW = ["below", "under", "less than", "lower than", "dip to", "close below"]

_NUMBER = r"\$?([0-9]+(?:\.[0-9]+)?)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def cutoff(text: Column) -> Column:
    """struct(op, year, month, day) of the first date of a text; op is before, by or on where that stands ahead of a month.

    ``before 2027`` is the first of January of that year. Full month names win over short ones. Null where there is no date.
    """
    words = plain_words(text)
    long, short = "|".join(MONTHS), "|".join(m[:3] for m in MONTHS)
    date = lambda names: rf"\b({names}) ([0-9]{{1,2}})(?: (20[0-9]{{2}}))?\b"
    name = F.coalesce(_found(words, date(long)), _found(words, date(short)))
    part = lambda k: F.when(_found(words, date(long)).isNotNull(), _found(words, date(long), k)).otherwise(_found(words, date(short), k))
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(name, 1, 3)).cast("int")
    ahead = lambda op: words.rlike(rf"\b(?:{op}) (?:{long}|{short})\b")
    op = F.when(ahead("before"), "before").when(ahead("by|on or before|on or prior to"), "by").when(ahead("on"), "on")
    bare = r"\b(before|by) (20[0-9]{2})\b"
    dated = F.struct(op.alias("op"), part(3).cast("int").alias("year"), month.alias("month"), part(2).cast("int").alias("day"))
    yearly = F.struct(_found(words, bare).alias("op"), _found(words, bare, 2).cast("int").alias("year"), F.lit(1).alias("month"), F.lit(1).alias("day"))
    return F.when(name.isNotNull(), dated).when(_found(words, bare).isNotNull(), yearly)


def cutoffs_agree(a: Column, b: Column) -> Column:
    """Whether two cut-offs end at the same moment (``before 16`` is ``by 15``); null where one is missing."""
    month = a["month"] == b["month"]
    same = month & (a["day"] == b["day"]) & a["op"].eqNullSafe(b["op"])
    next_day = lambda x, y: month & (x["op"] == "before") & (y["op"] == "by") & (x["day"] == y["day"] + 1)
    year = F.coalesce(a["year"] == b["year"], F.lit(True))
    return F.when(a.isNotNull() & b.isNotNull(), year & F.coalesce(same | next_day(a, b) | next_day(b, a), F.lit(False)))


def ticker_date(ticker: Column) -> Column:
    """The date of ``-27MAR14`` behind the first part of a ticker; null where there is none or it does not exist."""
    at = r"-([0-9]{2})(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)([0-9]{2})"
    up = F.upper(ticker)
    month = F.array_position(F.array(*[F.lit(m[:3].upper()) for m in MONTHS]), F.regexp_extract(up, at, 2))
    return F.when(up.rlike(at), F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_extract(up, at, 1), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.regexp_extract(up, at, 3)), F.lit("yyyy-MM-dd")).cast("date"))


def iso_date(text: Column) -> Column:
    """The first ``20yy-mm-dd`` of a text; null where there is none or it does not exist."""
    found = F.regexp_extract(text, r"\b(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b", 1)
    return F.when(found != "", F.try_to_timestamp(found, F.lit("yyyy-MM-dd")).cast("date"))


def explicit_year(text: Column) -> Column:
    return _found(text, r"\b(20[0-9]{2})\b").cast("int")


def threshold(text: Column) -> Column:
    """struct(op, low, high) of the first comparison of a text: range, eq (exactly), ge, gt, le, lt; null where there is none.

    Thousands separators are dropped. 'at least' is told before 'more than', as its words are the longer ones.
    """
    t = F.regexp_replace(F.lower(text), r"(?<=[0-9]),(?=[0-9]{3})", "")
    between = rf"between {_NUMBER}\s*%? and {_NUMBER}"
    low, exact = _found(t, between), _found(t, rf"\bexactly {_NUMBER}")
    made = lambda op, a, b=None: F.struct(F.lit(op).alias("op"), a.cast("double").alias("low"), (b if b is not None else F.lit(None)).cast("double").alias("high"))
    out = F.when(low.isNotNull(), made("range", low, _found(t, between, 2))).when(exact.isNotNull(), made("eq", exact))
    for op, words in COMPARISONS.items():
        number = _found(t, rf"(?:{'|'.join(words)}) {_NUMBER}")
        out = out.when(number.isNotNull(), made(op, number))
    return out


def asset_threshold(text: Column) -> Column:
    """The number behind a currency sign, or else behind a comparison, with k and m as thousands and millions."""
    t = F.regexp_replace(text, ",", "")
    money, bare = r"\$\s*([0-9]+(?:\.[0-9]+)?)\s*([kKmM])?", r"(?i)(?:above|over|below|under|greater than|less than|higher than|lower than|exceed)\s+\$?\s*([0-9]+(?:\.[0-9]+)?)\s*([kKmM])?"
    part = lambda k: F.when(t.rlike(money), F.regexp_extract(t, money, k)).otherwise(F.regexp_extract(t, bare, k))
    scale = F.when(F.lower(part(2)) == "k", 1e3).when(F.lower(part(2)) == "m", 1e6).otherwise(1.0)
    return F.nullif(part(1), F.lit("")).cast("double") * scale


def direction(text: Column) -> Column:
    """'above' or 'below' by the words of a text; null if it has neither."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    has = lambda words: F.greatest(*[padded.contains(f" {w} ").cast("int") for w in words]) == 1
    return F.when(has(ABOVE), "above").when(has(BELOW), "below")


def canonical(word: Column, aliases: Mapping[str, str]) -> Column:
    """The word that an alias stands for; other words stay."""
    if not aliases:
        return word
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), word), word)


def whole(number: Column) -> Column:
    """The integer part, cut towards zero, of the number as it is written; null for what is no number."""
    return F.when(~F.isnan(number), number.cast("decimal(38,12)").cast("bigint"))


def ceil_to(value: Column, parts: int) -> Column:
    """Rounded up to the next of ``parts`` parts of one, on doubles; 0 for what is not positive."""
    return F.when(value <= 0, F.lit(0.0)).otherwise(F.ceil(value * parts) / parts)


def tick_size(ranges: Column, price: Column, default: float = 0.01) -> Column:
    """The step of the first range of a JSON list of {start, end, step} that holds ``price``, else ``default``."""
    parsed = F.from_json(ranges, "array<struct<start:double,end:double,step:double>>")
    inside = F.filter(parsed, lambda r: (r["start"] <= price) & (price <= r["end"]) & r["step"].isNotNull())
    return F.coalesce(F.get(inside, F.lit(0))["step"], F.lit(default))


def capped_text(limit: int, *parts: Column) -> Column:
    """Filled parts joined by blanks, at most ``limit`` characters."""
    return F.substring(F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), 1, limit)
