"""Timestamps in mixed formats, precisions and zones, brought to UTC instants.

Each text is reduced to a shape mask: digits become ``9`` (one each), known words become their class,
everything else stays. Texts that differ in digits alone are tokenised once. A mask is mapped to a parser once
per worker; all texts of one mask are then converted together with NumPy. Wall times go through transition tables of the IANA database, whose
version is fixed on the driver and checked on every worker.
"""

from __future__ import annotations

import datetime as dt
import functools
import importlib.resources
import operator
import re
import zoneinfo
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of months and weekdays, and the offsets (minutes) of zone abbreviations.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
US_ZONES = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}
#: Years whose transitions are tabled. Before them the first offset holds; after them the calendar and the rules
#: repeat every 400 years.
FIRST_YEAR, LAST_YEAR = 1850, 2450
_CYCLE = 146_097 * 86_400
#: Longest mask that is remembered; no grammar reaches it.
_LONG = 400

_WORD = re.compile(r"[A-Za-z]+(?:[/_+-][A-Za-z_]+)*(?:/[A-Za-z_+-]+\d*)*|\d+|\s+|.", re.S)
_MONTH = {m: k + 1 for k, full in enumerate(MONTHS) for m in (full, full[:3])} | {"sept": 9}
_DAY = {d for full in DAYS for d in (full, full[:3])} | {"tues", "thur", "thurs"}

#: Grammars over masks. N is any run of digits; a name in braces is a field.
_DATE = {
    "ymd": r"(?P<y>9999)(?P<sep>[-/.])(?P<mo>99?)(?P=sep)(?P<d>99?)",
    "compact": r"(?P<y>9999)(?P<mo>99)(?P<d>99)",
    "slash": r"(?P<p>99?)/(?P<q>99?)/(?P<y>9999)",
    "dots": r"(?P<d>99?)\.(?P<mo>99?)\.(?P<y>9999)",
    "dmon": r"(?:W,? )?(?P<d>99?)[ -](?P<mon>M)[ -,]*(?P<y>9999)",
    "mond": r"(?:W,? )?(?P<mon>M) (?P<d>99?),? (?P<y>9999)",
}
_TIME = r"(?:(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>P))?)"
_TIME_COMPACT = r"(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9+))?)?"
_ZONE = r"(?: ?(?P<z>Z)| ?(?P<sg>[+-])(?P<oh>99)(?::?(?P<om>99))?)?(?: ?\[?(?P<zn>[RAU])\]?)?"
_SHAPES = {kind: re.compile(rf"{date}(?:(?:T|,? | K ){_TIME}{_ZONE})?") for kind, date in _DATE.items()}
_SHAPES["compact_time"] = re.compile(rf"{_DATE['compact']}T{_TIME_COMPACT}{_ZONE}")
_NUMBER = re.compile(r"-?9{1,19}(?:\.9+)?")


def tz_version() -> str:
    """Version of the IANA database that the tables come from."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


def _zone(name: str) -> zoneinfo.ZoneInfo | None:
    try:
        try:
            with importlib.resources.files("tzdata.zoneinfo").joinpath(name).open("rb") as source:
                return zoneinfo.ZoneInfo.from_file(source, key=name)
        except ModuleNotFoundError:
            return zoneinfo.ZoneInfo(name)
    except (OSError, ValueError, zoneinfo.ZoneInfoNotFoundError):
        return None


@functools.lru_cache(maxsize=1024)
def transitions(name: str, version: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Wall-clock boundaries (epoch seconds) of a zone and the offset (seconds) before, between and after.

    A wall time before a boundary still has the earlier offset. With the boundary at the later of the
    two wall times of a change, that picks the earlier instant of a repeated hour and moves a skipped
    time forward by the gap.
    """
    if version != tz_version():
        raise RuntimeError(f"time zone data {tz_version()} here, {version} on the driver")
    zone = _zone(name)
    if zone is None:
        return None
    utc = dt.timezone.utc

    def offset(second: int) -> int:
        return int(dt.datetime.fromtimestamp(second, utc).astimezone(zone).utcoffset().total_seconds())

    first, last = (int(dt.datetime(y, 1, 1, tzinfo=utc).timestamp()) for y in (FIRST_YEAR, LAST_YEAR))
    step = 7 * 86_400
    bounds, offsets = [], [offset(first)]
    for at in range(first, last, step):
        low, high = at, at + step
        if offset(high) == offsets[-1]:
            continue
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if offset(middle) == offsets[-1] else (low, middle)
        after = offset(high)
        bounds.append(high + max(offsets[-1], after))
        offsets.append(after)
    return np.array(bounds, dtype=np.int64), np.array(offsets, dtype=np.int64)


def shape(text: str) -> tuple[str, dict[str, list[str]], list[int] | None]:
    """The mask of a text, its words by their class, and the places in the text that line up with the mask.

    The places are None where the whole text does.
    """
    out, words, places, at = [], {}, [], 0
    for part in _WORD.findall(text):
        first, step = at, 1
        at += len(part)
        if part[0].isdigit() and part.isascii():
            out.append("9" * len(part))
            step = len(part)
        elif part[0].isspace():
            out.append(" ")
        elif not part[0].isalpha():
            out.append(part)
            step = len(part)
        else:
            low = part.lower()
            kind = (
                "M" if low in _MONTH else "W" if low in _DAY else "P" if low in ("am", "pm") else "T" if low == "t" else "Z" if low == "z"
                else "K" if low == "at" else "U" if part.upper() in US_ZONES else "A" if part.upper() in ABBREVIATIONS else "R" if "/" in part else "x" * len(part)
            )
            out.append(kind)
            step = len(kind)
            if kind in ("M", "P", "U", "A", "R"):
                words.setdefault(kind, []).append(part)
        places += range(first, first + step)
    return "".join(out), words, None if len(places) == len(text) else places


_DIGITS = str.maketrans("012345678", "9" * 9)


@functools.lru_cache(maxsize=65_536)
def _known_shape(digitless: str) -> tuple[str, dict[str, list[str]], Callable | None]:
    mask, words, places = shape(digitless)
    return mask, words, None if places is None else operator.itemgetter(*places) if len(places) > 1 else lambda t, p=places: t[p[0]]


@functools.lru_cache(maxsize=65_536)
def parser(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """The kind of date a mask states and where its fields lie, or None if it is no time."""
    if re.fullmatch("9{8}", mask):
        return "compact", {"y": (0, 4), "mo": (4, 6), "d": (6, 8)}
    if _NUMBER.fullmatch(mask):
        return "number", {}
    for kind, grammar in _SHAPES.items():
        if found := grammar.fullmatch(mask):
            return kind, {k: found.span(k) for k, v in found.groupdict().items() if v is not None and k != "sep"}
    return None


def _field(chars: np.ndarray, span: tuple[int, int] | None, default: int = 0) -> np.ndarray:
    """The number that stands in one span of equally long digit strings."""
    out = np.full(len(chars), default, dtype=np.int64)
    if span is not None:
        out[:] = 0
        for k in range(*span):
            out = out * 10 + (chars[:, k].astype(np.int64) - 48)
    return out


def _numbers(texts: list[str]) -> np.ndarray:
    """Microseconds of bare numbers, which count seconds, milli-, micro- or nanoseconds by their size."""
    out = np.empty(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        whole, _, part = text.strip().partition(".")
        size = abs(int(whole))
        unit = 1_000_000 if size < 10**11 else 1_000 if size < 10**14 else 1 if size < 10**17 else 0
        sign = -1 if whole.startswith("-") else 1
        out[k] = sign * (size // 1000 if unit == 0 else size * unit + int((part + "0" * 6)[:6]) * unit // 1_000_000)
    return out


def to_micros(texts: pd.Series, zones: pd.Series, version: str, end_of_day: bool = False) -> np.ndarray:
    """Microseconds since the epoch in UTC of each text, as nullable integers held in objects.

    ``end_of_day``: a date alone means its last second.
    """
    result = np.full(len(texts), None, dtype=object)
    groups: dict[str, list[int]] = {}
    lined: dict[int, str] = {}
    held: dict[int, dict[str, list[str]]] = {}
    values, own = texts.to_numpy(dtype=object), zones.to_numpy(dtype=object)
    for k, text in enumerate(values):
        if isinstance(text, str) and (text := text.strip()):
            like = text.translate(_DIGITS)
            mask, held[k], pick = (_known_shape if len(like) <= _LONG else _known_shape.__wrapped__)(like)
            if any("9" in w for w in held[k].get("R", ())):  # a zone name with digits of its own
                held[k] = shape(text)[1]
            lined[k] = text if pick is None else "".join(pick(text))
            groups.setdefault(mask, []).append(k)
    for mask, rows in groups.items():
        if (how := (parser if len(mask) <= _LONG else parser.__wrapped__)(mask)) is None:
            continue
        kind, spans = how
        if kind == "number":
            for k, v in zip(rows, _numbers([lined[k] for k in rows])):
                result[k] = int(v)
            continue
        micros, valid = _convert(kind, spans, mask, [lined[k] for k in rows], [held[k] for k in rows], [own[k] for k in rows], version)
        if end_of_day and "h" not in spans:
            micros = micros + 86_399_000_000
        for k, v, ok in zip(rows, micros.tolist(), valid.tolist()):
            if ok:
                result[k] = v
    return result


def _convert(kind: str, spans: dict, mask: str, lined: list[str], held: list[dict[str, list[str]]], zones: list, version: str) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds and validity of all texts of one mask."""
    chars = np.frombuffer("".join(lined).encode("latin-1", "replace"), dtype=np.uint8).reshape(len(lined), len(mask))
    get = lambda name, default=0: _field(chars, spans.get(name), default)
    word = lambda letter: [h[letter][0] for h in held]
    own = np.array([z if isinstance(z, str) and z else "UTC" for z in zones], dtype=object)
    year, day = get("y"), get("d", 1)
    month = np.array([_MONTH[w.lower()] for w in word("M")], dtype=np.int64) if "mon" in spans else get("mo", 1)
    if kind == "slash":
        us = np.array([z.startswith("America/") for z in own])
        first, second = get("p"), get("q")
        month, day = np.where(us, first, second), np.where(us, second, first)
    hour, minute, second = get("h"), get("mi"), get("s")
    valid = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31) & (minute < 60) & (second < 60)
    if "ap" in spans:
        valid &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.array([12 * (w.lower() == "pm") for w in word("P")], dtype=np.int64)
    valid &= (hour < 24) | ((hour == 24) & (minute == 0) & (second == 0) & ("ap" not in spans))  # 24:00 ends the day
    months = (np.where(valid, year, 1970) - 1970) * 12 + np.where(valid, month, 1) - 1
    date = months.astype("datetime64[M]").astype("datetime64[D]") + (np.where(valid, day, 1) - 1)
    valid &= date.astype("datetime64[M]").astype(np.int64) == months
    wall = date.astype(np.int64) * 86_400 + hour * 3600 + minute * 60 + second
    part = np.zeros(len(lined), dtype=np.int64)
    if "f" in spans:
        a, b = spans["f"]
        b = min(b, a + 6)
        part = _field(chars, (a, b)) * 10 ** (6 - (b - a))
    offset = np.zeros(len(lined), dtype=np.int64)
    named: np.ndarray | None = None
    if "z" in spans:
        pass
    elif "sg" in spans:
        minutes = get("oh") * 60 + get("om")
        valid &= (get("oh") <= 18) & (get("om") < 60)
        offset = np.where(chars[:, spans["sg"][0]] == ord("-"), -1, 1) * minutes * 60
    elif "zn" in spans:
        letter = mask[spans["zn"][0]]
        if letter == "A":
            offset = np.array([ABBREVIATIONS[w.upper()] * 60 for w in word("A")], dtype=np.int64)
        else:
            named = np.array([US_ZONES[w.upper()] if letter == "U" else w for w in word(letter)], dtype=object)
    else:
        named = own
    if named is not None:
        for name in set(named.tolist()):
            here = named == name
            table = transitions(name, version)
            if table is None:
                valid &= ~here
            else:
                offset[here] = table[1][np.searchsorted(table[0], _tabled(wall[here]), side="right")]
    return (wall - offset) * 1_000_000 + part, valid


def _tabled(wall: np.ndarray) -> np.ndarray:
    """Wall times after the tabled years, moved back by whole cycles of the calendar."""
    last = (LAST_YEAR - 1970) * 365.2425 * 86_400
    return wall - np.maximum(0, np.ceil((wall - last) / _CYCLE)).astype(np.int64) * _CYCLE


def instant_or(text: Column, zone: Column, as_of: Column, days: int) -> Column:
    """The instant of a text, or ``days`` after ``as_of`` where it is no time."""
    return F.coalesce(utc_instant(text, zone), as_of + F.make_dt_interval(F.lit(days)))


def utc_instant(text: Column, zone: Column, end_of_day: bool = False) -> Column:
    """A UTC timestamp for a time in text, null where the text is no time.

    A text without zone is in ``zone``, or in UTC where that is null or empty. Dates with slashes and
    the year last are month first where ``zone`` is in America/, day first elsewhere. Fractions are
    cut to microseconds. Null, blank, impossible dates, unknown zones and all other texts give null,
    whatever their length; 24:00 is the midnight that ends the day. A date alone means its midnight, or its
    last second with ``end_of_day``.
    """
    version = tz_version()

    @F.pandas_udf("bigint")
    def convert(texts: pd.Series, zones: pd.Series) -> pd.Series:
        return pd.Series(to_micros(texts, zones, version, end_of_day), dtype="Int64")

    return F.timestamp_micros(convert(text, zone))


def melt_instants(df: DataFrame, key: str, fields: list[str], zone: str) -> DataFrame:
    """One row (``key``, field_name, time_text, utc_ts) for each field of each row of ``df``.

    Repeated rows stay repeated; other columns are never read; an empty table gives no row.
    """
    long = df.select(
        F.col(key).alias("__k"), F.col(zone).alias("__z"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("time_text")) for f in fields])).alias("__f"),
    )
    return long.select(F.col("__k").alias(key), "__f.field_name", "__f.time_text", utc_instant(F.col("__f.time_text"), F.col("__z")).alias("utc_ts"))
