"""Settlement rules: what a rule text decides by, its material clauses, its sources, and whether two profiles agree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarine.functions.text import rule_text
from tessarine.operators.signatures import last_date

# Phrases of each basis, in order of precedence.
TAKING_OFFICE = ["subsequently sworn in", "sworn in", "takes office", "take office", "inauguration date", "assume office"]
BASES = {
    "office_assumption": [*TAKING_OFFICE, "taking office"],
    "certified_result": ["final certified outcome", "official certification", "certified result", "certified outcome"],
    "declared_result": ["officially declared elected", "officially declared winner", "declared elected", "declared the winner"],
    "event_result": ["result of the election", "results of this election", "wins the election", "winner of the election", "who wins the election", "number of seats", "seats won", "seat count", "election winner"],
    "objective_measurement": ["official data", "reported value", "published value", "closing price", "settlement value"],
}
SEATS = r"\bnumber of (?:[a-z0-9.-]+\s+){0,5}seats\b"
# Each clause holds where every group has a phrase in the text and no phrase of the last list is there.
NOT = ["not included", "excluded"]
FLAGS: dict[str, tuple[list[list[str]], list[str]]] = {
    "requires_take_office": ([TAKING_OFFICE], []),
    "official_declaration_required": ([["officially declared", "official declaration", "declared elected", "declared the winner"]], []),
    "certification_required": ([["official certification", "certified outcome", "certified result", "final certified outcome"]], []),
    "final_court_outcome": ([["highest court", "final court", "court with jurisdiction", "legal challenges have", "challenges have been resolved"]], []),
    "fallback_market_price": ([["last fair market price", "market price", "fair market price"], ["resolve"]], []),
    "postponement_stays_open": ([["postpon"], ["remain open", "stays open", "contract remains open"]], []),
    "special_elections_excluded": ([["special elections are not included", "special elections to fill a vacancy"], NOT], []),
    "special_elections_included": ([["special election"], ["included"]], ["not included"]),
    "by_elections_excluded": ([["by-election", "by election"], NOT], []),
    "by_elections_included": ([["by-election", "by election"], ["included"]], NOT),
    "runoff_excluded": ([["runoff", "second round"], NOT], []),
    "runoff_included": ([["runoff", "second round"], ["included", "will determine", "includes any potential second round"]], NOT),
    "independent_caucus_counts": ([["independent"], ["caucus"]], []),
    "party_at_election_controls": ([["party under which the member was elected", "party under whose banner", "affiliation at the time of the election"]], []),
    "party_at_resolution_controls": ([["party affiliation at resolution", "affiliation when the market resolves"]], []),
    "death_after_win_counts": ([["die", "death", "incapacitated"], ["will resolve for that candidate", "still count", "counts"]], []),
    "death_after_win_excluded": ([["die", "death", "incapacitated"], ["will not count", "does not count", "excluded"]], ["will resolve for that candidate", "still count", "counts"]),
    "vacancy_after_election_counts_original_party": ([["vacates their seat"], ["attributed to the party under which", "original party"]], []),
    "overtime_included": ([["overtime", "extra time"], ["included", "will count", "counts"]], NOT),
    "overtime_excluded": ([["overtime", "extra time"], [*NOT, "regulation only"]], []),
    "shootout_included": ([["shootout"], ["included", "will count", "counts"]], NOT),
    "shootout_excluded": ([["shootout"], NOT], []),
    "cancelled_event_stays_open": ([["cancelled", "canceled", "abandoned"], ["remain open", "stays open", "rescheduled", "postponed"]], []),
    "cancelled_event_voids": ([["cancelled", "canceled", "abandoned"], ["void", "voided", "cancel the market", "market will be cancelled"]], []),
    "cancelled_event_half_payout": ([["cancelled", "canceled", "abandoned"], ["50-50", "50/50", "0.5", "half payout", "half-payout"]], []),
    "stat_corrections_included": ([["stat correction", "official correction", "data correction"], ["included", "will count"]], ["not included", "ignored"]),
    "stat_corrections_excluded": ([["stat correction", "official correction", "data correction"], ["not included", "ignored", "will not count"]], []),
}
FALLBACK_OTHER = r"resolve(?:s|d)?\s+(?:to\s+)?['\"]?other['\"]?"
# Phrases of each family of sources.
SOURCES = {
    "nigeria_inec": ["independent national electoral commission", "inec"],
    "us_election_official": ["federal election commission", "fec.gov", "united states congress", "congress.gov", "state electoral", "state election", "secretary of state", "election authorities", "state authorities", "official state", "official election results"],
    "credible_reporting": ["associated press", " ap ", "reuters", "credible reporting"],
    "official_sport_body": ["official league", "official match report", "official tournament"],
    "us_weather_official": ["national weather service", "noaa"],
    "cf_benchmarks": ["cf benchmarks"],
    **{name: [name] for name in ("chainlink", "pyth", "coinbase", "binance", "kraken", "coingecko")},
    "google_trends": ["google trends"],
    **{name: [name] for name in ("billboard", "spotify")},
}
# Clauses that one side alone must not have, and clauses that exclude each other.
ONE_SIDED = ["requires_take_office", "fallback_other", "fallback_market_price"]
OPPOSED = [
    ("special_elections_included", "special_elections_excluded"), ("by_elections_included", "by_elections_excluded"), ("runoff_included", "runoff_excluded"),
    ("party_at_election_controls", "party_at_resolution_controls"), ("death_after_win_counts", "death_after_win_excluded"), ("overtime_included", "overtime_excluded"),
    ("shootout_included", "shootout_excluded"), ("cancelled_event_stays_open", "cancelled_event_voids"), ("stat_corrections_included", "stat_corrections_excluded"),
]
QUALIFIERS = [
    (["first_round"], ["second_round"]), (["regular_season"], ["playoffs", "finals"]), (["popular_vote"], ["electoral_college"]),
    (["interim_included"], ["interim_excluded"]), (["overtime_included"], ["overtime_excluded"]),
]


def _any(text: Column, phrases: list[str]) -> Column:
    out = text.contains(phrases[0])
    for p in phrases[1:]:
        out = out | text.contains(p)
    return out


def basis_of(t: Column) -> Column:
    """``basis`` of a text that is in the form of ``rule_text`` already."""
    seats = t.rlike(SEATS) | (t.contains("election") & F.concat(F.lit(" "), t, F.lit(" ")).contains(" seats ") & _any(t, ["resolves to", "resolve based on", "determined by"]))
    return F.coalesce(*[F.when(_any(t, p) | seats if name == "event_result" else _any(t, p), F.lit(name)) for name, p in BASES.items()])


def flags_of(t: Column) -> Column:
    """``material_flags`` of a text in that form."""
    found = [F.when(t.rlike(FALLBACK_OTHER), F.lit("fallback_other"))]
    for name, (groups, without) in FLAGS.items():
        holds = ~_any(t, without) if without else F.lit(True)
        for group in groups:
            holds = holds & _any(t, group)
        found.append(F.when(holds, F.lit(name)))
    return F.array_sort(F.array_compact(F.array(*found)))


def sources_of(t: Column) -> Column:
    """``source_families`` of a text in that form."""
    return F.array_sort(F.array_compact(F.array(*[F.when(_any(t, p), F.lit(name)) for name, p in SOURCES.items()])))


def basis(text: Column) -> Column:
    """What decides: the first basis whose phrases the text has; null if none."""
    return basis_of(rule_text(text))


def material_flags(text: Column) -> Column:
    """The sorted names of the material clauses of a text; empty for null."""
    return flags_of(F.coalesce(rule_text(text), F.lit("")))


def source_families(text: Column) -> Column:
    """The sorted families of sources that a text names; empty for none."""
    return sources_of(F.coalesce(rule_text(text), F.lit("")))


def deadline(text: Column) -> Column:
    """The last moment (UTC seconds) of the latest date that a rule states; null if it states none."""
    return F.unix_seconds(last_date(text).cast("timestamp")) + 86_399


def profile(text: Column) -> Column:
    """struct(basis, flags, sources, deadline, present, coverage): coverage is the filled share of the four before it."""
    b, f, s, d = basis(text), material_flags(text), source_families(text), deadline(text)
    present = F.length(F.coalesce(rule_text(text), F.lit(""))) > 0
    filled = b.isNotNull().cast("int") + (F.size(s) > 0).cast("int") + (F.size(f) > 0).cast("int") + d.isNotNull().cast("int")
    return F.struct(b.alias("basis"), f.alias("flags"), s.alias("sources"), d.alias("deadline"), present.alias("present"), F.when(present, filled / 4).otherwise(0.0).alias("coverage"))


def with_profile(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` with the parts of ``profile`` as columns of their own: prefix_basis, prefix_flags and so on.

    The text is brought into its form once, and what is read from it is not computed again for every use.
    """
    name = f"__{prefix}_text"
    held = df.withColumn(name, F.coalesce(rule_text(F.col(text)), F.lit("")))
    t = F.col(name)
    held = held.withColumns({f"{prefix}_basis": basis_of(t), f"{prefix}_flags": flags_of(t), f"{prefix}_sources": sources_of(t), f"{prefix}_deadline": deadline(F.col(text)), f"{prefix}_present": F.length(t) > 0})
    c = lambda x: F.col(f"{prefix}_{x}")
    filled = c("basis").isNotNull().cast("int") + (F.size(c("sources")) > 0).cast("int") + (F.size(c("flags")) > 0).cast("int") + c("deadline").isNotNull().cast("int")
    return held.withColumn(f"{prefix}_coverage", F.when(c("present"), filled / 4).otherwise(0.0)).drop(name)


def profile_columns(prefix: str) -> dict[str, Column]:
    """The columns of ``with_profile``, for ``compare`` and the like."""
    return {x: F.col(f"{prefix}_{x}") for x in ("basis", "flags", "sources", "deadline", "present", "coverage")}


def flag_conflict(a: Column, b: Column) -> Column:
    """The first clause that one side alone must not have, or pair of clauses that exclude each other; null if none."""
    has = F.array_contains
    alone = [F.when(has(a, name) != has(b, name), F.lit(name)) for name in ONE_SIDED]
    opposed = [F.when((has(a, x) & has(b, y)) | (has(a, y) & has(b, x)), F.lit(f"{x} vs {y}")) for x, y in OPPOSED]
    return F.coalesce(*alone, *opposed)


def qualifier_conflict(a: Column, b: Column) -> Column:
    """Whether two sets of qualifiers hold values that exclude each other; what only one side states is no conflict."""
    meets = lambda c, values: F.arrays_overlap(c, F.array(*[F.lit(v) for v in values]))
    out = F.lit(False)
    for x, y in QUALIFIERS:
        out = out | (meets(a, x) & meets(b, y)) | (meets(a, y) & meets(b, x))
    return F.coalesce(out, F.lit(False))


def rule_sensitive(domain: Column, proposition: Column, office: Column, threshold_kinds: tuple[str, ...] = ("winner", "primary_winner", "exact_count", "range", "above_threshold", "below_threshold")) -> Column:
    """Whether the contract needs complete rules: politics, or a result about an office."""
    filled = F.coalesce(office, F.lit("")) != ""
    return (F.coalesce(domain, F.lit("")) == "politics") | (F.coalesce(proposition.isin(*threshold_kinds), F.lit(False)) & filled)


def compare(left: Column | Mapping[str, Column], right: Column | Mapping[str, Column], sensitive: Column) -> Column:
    """EXACT, COMPATIBLE or REVIEW for two profiles (structs, or their columns by name), with the reason for a review: struct(verdict, reason)."""
    a, b = left, right
    one = F.array_union(F.array_except(a["flags"], b["flags"]), F.array_except(b["flags"], a["flags"]))
    dated = F.when(a["deadline"].isNotNull(), a["flags"]).otherwise(b["flags"])
    fallback = F.array_contains(dated, "fallback_other") | F.array_contains(dated, "fallback_market_price")
    stated = a["basis"].isNotNull() & b["basis"].isNotNull()
    reason = F.coalesce(
        F.when(sensitive & ~(a["present"] & b["present"]), "rules missing"),
        F.when(sensitive & (F.least(a["coverage"], b["coverage"]) < 0.5), "coverage"),
        F.when(stated & (a["basis"] != b["basis"]), "basis differs"),
        F.when(sensitive & (a["basis"].isNotNull() != b["basis"].isNotNull()), "basis missing"),
        flag_conflict(a["flags"], b["flags"]),
        F.when(sensitive & (F.size(one) > 0), "clause on one side"),
        F.when((F.size(a["sources"]) > 0) & (F.size(b["sources"]) > 0) & ~F.arrays_overlap(a["sources"], b["sources"]), "sources differ"),
        F.when(sensitive & (a["deadline"].isNotNull() != b["deadline"].isNotNull()) & fallback, "deadline on one side"),
    )
    exact = a["basis"].eqNullSafe(b["basis"]) & (a["flags"] == b["flags"]) & (a["sources"] == b["sources"]) & a["present"] & b["present"]
    return F.struct(F.when(reason.isNotNull(), "REVIEW").when(exact, "EXACT").otherwise("COMPATIBLE").alias("verdict"), reason.alias("reason"))


def contradictions(a: str, b: str, attributes: list[str]) -> Column:
    """Names of the attributes that both structs state and that differ."""
    stated = lambda x: x.isNotNull() & (x.cast("string") != "")
    pairs = [(c, F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in attributes]
    return F.array_compact(F.array(*[F.when(stated(x) & stated(y) & (x.cast("string") != y.cast("string")), F.lit(c)) for c, x, y in pairs]))


def hydration_state(apart: Column, left_text: Column, right_text: Column, verdict: Column) -> Column:
    """CONTRADICTION where attributes differ, UNRESOLVED where a rule text is missing or needs review, else SAFE."""
    missing = F.coalesce(F.length(F.trim(left_text)), F.lit(0)) * F.coalesce(F.length(F.trim(right_text)), F.lit(0)) == 0
    return F.when(F.size(apart) > 0, "CONTRADICTION").when(missing | (verdict == "REVIEW"), "UNRESOLVED").otherwise("SAFE")


def needs_hydration(verdict: Column, left: Column | Mapping[str, Column], right: Column | Mapping[str, Column]) -> Column:
    """Whether more rule text could change a verdict: a review or compatible pair with a text missing or hardly covered."""
    return verdict.isin("REVIEW", "COMPATIBLE") & (~left["present"] | ~right["present"] | (F.least(left["coverage"], right["coverage"]) < 0.5))
