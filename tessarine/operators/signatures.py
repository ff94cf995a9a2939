"""Contract signatures: typed attributes read from a title, and profiles read from rule texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each kind of statement is recognised by, in order of precedence.
PROPOSITIONS = {
    "range": r"\b(between|from) .*[0-9].* (and|to) .*[0-9]",
    "threshold": r"\b(at least|at most|no less than|no more than|less than|more than|over|under|above|below)\b",
    "office_holder": r"\b(president|prime minister|governor|mayor|senator)\b",
    "advance": r"\b(semi|quarter)?finals?\b",
    "winner": r"\b(win|wins|winner|champion|crowned|outright|trophy|takes?|prize|medal|lantern|reel|album)\b",
}
OPERATORS = {
    "range": PROPOSITIONS["range"],
    "ge": r"\b(at least|no less than)\b",
    "le": r"\b(at most|no more than)\b",
    "gt": r"\b(over|above|more than)\b",
    "lt": r"\b(under|below|less than)\b",
}
STAGES = {"quarterfinal": r"\bquarterfinals?\b", "semifinal": r"\bsemifinals?\b", "final": r"\bfinals?\b"}
OFFICES = {"president": r"\bpresident\b", "prime_minister": r"\bprime minister\b", "governor": r"\bgovernor\b", "mayor": r"\bmayor\b"}
RULE_FLAGS = {
    "overtime": r"overtime|extra time", "postponed": r"postpone", "cancelled": r"cancel", "interim": r"interim|acting", "early_close": r"closes early|early close",
    "tie": r"\btie\b|dead heat", "revision": r"revis|correct", "consensus": r"consensus|credible report", "withdrawal": r"withdraw", "dispute": r"dispute",
}
SOURCE_FAMILIES = {"statistics": r"statistic|records|weather", "exchange": r"index desk|ledger", "league": r"league|committee|cup", "press": r"gazette", "foundation": r"foundation", "electoral": r"electoral"}


def first_of(text: Column, patterns: Mapping[str, str]) -> Column:
    """The name of the first pattern that occurs in the lower-case text; null if none does."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(name)) for name, p in patterns.items()])


def all_of(text: Column, patterns: Mapping[str, str]) -> Column:
    """Names of all patterns that occur, sorted; null for a null text."""
    low = F.lower(text)
    return F.when(text.isNotNull(), F.array_sort(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in patterns.items()]))))


def subject(text: Column, explicit: Column) -> Column:
    """The stated subject, else the name before the verb of a title that asks whether someone does something."""
    asked = F.trim(F.regexp_extract(text, r"(?i)^\s*will\s+(.+?)\s+(?:win|make|be|become|play|take|lift)\b", 1))
    said = F.trim(explicit)
    return F.when(said != "", said).when(asked != "", asked)


def completeness(*attributes: Column) -> Column:
    """Share of the attributes that are neither null nor blank."""
    filled = [F.when(a.isNotNull() & (F.trim(a.cast("string")) != ""), 1.0).otherwise(0.0) for a in attributes]
    total = filled[0]
    for f in filled[1:]:
        total = total + f
    return total / len(filled)


def last_date(text: Column) -> Column:
    """The latest ``Month d, yyyy`` of a text; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, 20[0-9]{2})"), 1)
    return F.array_max(F.transform(found, lambda d: F.to_date(F.try_to_timestamp(d, F.lit("MMMM d, yyyy")))))


def compare_profiles(left_flags: Column, right_flags: Column, left_text: Column, right_text: Column) -> Column:
    """EXACT, COMPATIBLE (no flag on one side only), REVIEW, or UNRESOLVED where a text is missing."""
    apart = F.size(F.array_except(left_flags, right_flags)) + F.size(F.array_except(right_flags, left_flags))
    missing = left_text.isNull() | right_text.isNull() | (F.length(F.trim(left_text)) == 0) | (F.length(F.trim(right_text)) == 0)
    return F.when(missing, "UNRESOLVED").when(F.lower(left_text) == F.lower(right_text), "EXACT").when(apart == 0, "COMPATIBLE").otherwise("REVIEW")
