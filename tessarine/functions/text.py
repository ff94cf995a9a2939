"""Scalar text functions, as column expressions."""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@functools.lru_cache(maxsize=1)
def _ascii_tables() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII character, that character, and those that decompose to several."""
    one, to, several = [], [], {}
    for code in range(128, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(chr(code))
            to.append(plain)
        elif plain:
            several[chr(code)] = plain
    return "".join(one), "".join(to), several


def ascii_form(text: Column) -> Column:
    """Compatibility decomposition without marks and without whatever is not ASCII then, by tables of the Unicode database."""
    one, to, several = _ascii_tables()
    t = F.translate(text, one, to)
    table = F.from_json(F.lit(json.dumps(several, ensure_ascii=False)), "map<string,string>")  # one literal, which is folded
    spelt = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    return F.regexp_replace(F.when(t.rlike("[" + "".join(several) + "]"), spelt).otherwise(t), r"[^\x00-\x7F]", "")


def plain_words(text: Column) -> Column:
    """ASCII form in lower case, '&' as 'and', quotes dropped, everything else but letters and digits as blanks; '' for null."""
    low = F.regexp_replace(F.replace(F.lower(ascii_form(F.coalesce(text, F.lit("")))), F.lit("&"), F.lit(" and ")), "['\"`]", "")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def folded_words(text: Column) -> Column:
    """ASCII form in lower case, everything but letters and digits (quotes, too) as blanks; '' for null."""
    return spaced_words(ascii_form(F.coalesce(text, F.lit(""))))


def legacy_words(text: Column) -> Column:
    """Lower case with only letters, digits, ``. - %`` and blanks; '' for null."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9.\-%\s]", " "))


def spaced_words(text: Column) -> Column:
    """Lower case with every run of other characters than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def rule_text(text: Column) -> Column:
    """Lower case with straight apostrophes and collapsed white space."""
    return squeeze(F.translate(F.lower(text), "‘’", "''"))


def signature_text(text: Column) -> Column:
    """ASCII form (compatibility decomposition, marks dropped), lower case, only ``[a-z0-9%$.-]`` and blanks."""

    return squeeze(F.regexp_replace(F.lower(ascii_form(text)), r"[^a-z0-9%$.\-\s]", " "))


def tokens(text: Column, least: int = 2, stop: list[str] | None = None) -> Column:
    """Distinct words of at least ``least`` letters, sorted, without stop words and years."""
    words = F.filter(F.split(spaced_words(text), " "), lambda w: (F.length(w) >= least) & ~w.rlike("^20[0-9]{2}$"))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return F.array_sort(F.array_distinct(words))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the squeezed words; none for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(spaced_words(text), F.lit(f"(?=(.{{{n}}}))"), 1))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def number_texts(text: Column) -> Column:
    """Numbers of a text in order, as written but for thousands separators."""
    flat = F.regexp_replace(text, "([0-9]),([0-9]{3})", "$1$2")
    return F.regexp_extract_all(flat, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)


def season_key(text: Column) -> Column:
    """``2026-27``, ``2026 - 2027`` and the like as ``2026-2027``; a lone year stays; null where there is neither."""
    t = signature_text(text)
    both = r"\b(20[0-9]{2})\s*-\s*(20[0-9]{2}|[0-9]{2})\b"
    first, last = F.regexp_extract(t, both, 1), F.regexp_extract(t, both, 2)
    year = F.regexp_extract(t, r"\b(20[0-9]{2})\b", 1)
    full = F.when(F.length(last) == 2, F.concat(F.substring(first, 1, 2), last)).otherwise(last)
    return F.when(first != "", F.concat(first, F.lit("-"), full)).when(year != "", year)


def shorten(text: Column, width: int) -> Column:
    """Without a leading 'will' or 'who will', at most ``width`` characters, cut at a blank where there is one."""
    t = F.regexp_replace(squeeze(text), "(?i)^(who will|will) ", "")
    cut = F.regexp_extract(F.substring(t, 1, width + 1), r"^(.*)\s", 1)
    return F.when(F.length(t) <= width, t).when(cut != "", cut).otherwise(F.substring(t, 1, width))
