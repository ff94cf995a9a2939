"""Contracts read in full: domain, proposition, metric, competition, place, family, anchors, and the whole signature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarine.functions import entities, parsing
from tessarine.functions.text import season_key, signature_text, tokens
from tessarine.operators import rules

# Words of a category, and the domain they belong to.
CATEGORIES = {
    "sports": "sports", "sport": "sports", "politics": "politics", "political": "politics", "elections": "politics", "economics": "economics", "economy": "economics", "economic": "economics",
    "crypto": "crypto", "cryptocurrency": "crypto", "technology": "technology", "tech": "technology", "business": "business", "entertainment": "entertainment", "culture": "entertainment",
    "science": "science", "weather": "weather", "climate": "weather",
}
# Words of a text that tell its domain where no category does, in order of precedence.
DOMAIN_WORDS = {
    "sports": ["vs", "championship", "league", "tournament", "super bowl", "ufc", "nba", "nfl", "nhl", "mlb", "world cup", "ballon d or", "grand slam", "touchdown", "yards", "chess olympiad"],
    "politics": ["president", "election", "nominee", "congress", "senate", "governor", "prime minister"],
    "economics": ["inflation", "gdp", "unemployment", "interest rate", "fed", "cpi", "jobs report"],
    "crypto": ["bitcoin", "ethereum", "crypto", "solana"],
    "entertainment": ["movie", "oscar", "grammy", "emmy", "box office", "album", "actor", "actress", "spotify", "google search"],
}
# Patterns of what is measured, in order of precedence.
METRICS = {
    "rushing_touchdowns": r"\brushing (touchdowns?|tds?)\b", "receiving_touchdowns": r"\breceiving (touchdowns?|tds?)\b", "passing_touchdowns": r"\bpassing (touchdowns?|tds?)\b",
    "rushing_yards": r"\brushing yards?\b", "receiving_yards": r"\breceiving yards?\b", "passing_yards": r"\bpassing yards?\b", "receptions": r"\breceptions?\b", "sacks": r"\bsacks?\b",
    "interceptions": r"\binterceptions?\b", "home_runs": r"\bhome runs?\b", "goals": r"\bgoals?\b", "assists": r"\bassists?\b", "points": r"\bpoints?\b", "seats": r"\bseats?\b", "votes": r"\bvotes?\b",
    "search_rank": r"\b(google )?search(ed|es)?\b", "market_cap": r"\bmarket cap(italization)?\b", "inflation": r"\binflation\b|\bcpi\b", "unemployment": r"\bunemployment\b", "gdp": r"\bgdp\b",
    "interest_rate": r"\bfed(eral reserve)? (rate|funds)|\binterest rate\b", "temperature": r"\btemperature\b|\bdegrees?\b",
}
COMPETITIONS = {
    "uefa_champions_league": r"\b(uefa )?champions league\b", "premier_league": r"\b(english )?premier league\b|\bepl\b", "uefa_europa_league": r"\beuropa league\b", "uefa_conference_league": r"\bconference league\b",
    "fifa_world_cup": r"\b(fifa )?world cup\b", "ballon_dor": r"\bballon d or\b", "super_bowl": r"\bsuper bowl\b", "nba": r"\bnba\b", "nfl": r"\bnfl\b|\bpro football\b", "nhl": r"\bnhl\b", "mlb": r"\bmlb\b|\bworld series\b",
    "formula_1": r"\bformula (1|one)\b|\bf1\b", "ufc": r"\bufc\b", "lol_lck": r"\blck\b", "lol_lpl": r"\blpl\b", "lol_worlds": r"\b(league of legends|lol) worlds\b|\bworlds 20[0-9]{2}\b", "wimbledon": r"\bwimbledon\b",
    "australian_open": r"\baustralian open\b", "french_open": r"\bfrench open\b|\broland garros\b", "us_open": r"\bus open\b", "chess_olympiad": r"\bchess olympiad\b", "golf_masters": r"\bmasters tournament\b|\bthe masters\b",
    "pga_championship": r"\bpga championship\b", "ryder_cup": r"\bryder cup\b",
}
# Kinds of statement, in order of precedence.
KINDS = {
    "participation": r"\b(compete|participate|appear|enter|play in|make the field|make the ballot|run for|running for)\b",
    "primary_winner": r"primary.*\b(win|winner|nominee)\b|\b(win|winner|nominee)\b.*primary",
    "top_half": r"top half",
    "rank_threshold": r"\btop [0-9]+\b|\b(finish|rank|be) [0-9]+\b",
    "leader": r"\b(leader|lead the|most rushing|most receiving|most passing|most goals|most points|most searched)\b",
    "exact_count": r"\bexactly [0-9]",
    "range": r"\bbetween \$?[0-9]",
    "above_threshold": r" (at least|more than|greater than|above|over) ",
    "below_threshold": r" (at most|less than|fewer than|below|under) ",
    "relegation": r"relegat",
    "qualify": r"qualif",
    "make_playoffs": r"(make|reach) the playoffs",
    "winner": r"\b(nominee|nomination|win|winner|wins|champion|championship|most seats)\b",
    "binary_event": r"^ (will|is|does) ",
}
OFFICES = {
    "us_house": r"\bhouse( of representatives)?\b", "us_senate": r"\bsenate\b", "governor": r"\bgovernor|gubernatorial\b", "president": r"\bpresident|presidential\b",
    "prime_minister": r"\bprime minister\b", "mayor": r"\bmayor|mayoral\b",
}
COUNTRIES = {
    "united states": "US", "u s": "US", "usa": "US", "canada": "CA", "united kingdom": "GB", "uk": "GB", "france": "FR", "germany": "DE", "italy": "IT", "spain": "ES", "brazil": "BR",
    "argentina": "AR", "australia": "AU", "india": "IN", "china": "CN", "japan": "JP", "mexico": "MX", "ireland": "IE",
}
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC", "washington dc": "DC",
}
#: Words that anchor no event.
NO_ANCHOR = (
    "sports sport gaming game games winner wins match matches league series tournament playoffs regular season group stage weather rain rainfall temperature degrees high low daily"
    " election elections presidential house senate seat seats price market value rate percent percentage"
).split()
#: Metrics of a player or a team in a match.
MATCH_METRICS = ["rushing_touchdowns", "receiving_touchdowns", "passing_touchdowns", "rushing_yards", "receiving_yards", "passing_yards", "receptions", "sacks", "interceptions", "home_runs", "goals", "assists", "points"]
ASSETS = ["bitcoin", "ethereum", "solana", "gold", "silver", "platinum", "oil", "brent", "wti"]


def normal(text: Column) -> Column:
    """The signature form of a text between blanks, which the functions here read; '' becomes two blanks."""
    return F.concat(F.lit(" "), F.coalesce(signature_text(text), F.lit("")), F.lit(" "))


def _first(text: Column, patterns: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()])


def domain(categories: Sequence[Column], text: Column) -> Column:
    """By the first category that names a domain, else by whole words of the text, else 'other'."""
    said = [F.when(signature_text(c).contains(word), F.lit(name)) for c in categories for word, name in CATEGORIES.items()]
    words = [F.when(text.rlike(rf"\b({'|'.join(w)})\b"), F.lit(name)) for name, w in DOMAIN_WORDS.items()]
    return F.coalesce(*said, *words, F.lit("other"))


def proposition(text: Column) -> Column:
    return _first(text, KINDS)


def metric(text: Column) -> Column:
    return _first(text, METRICS)


def competition(text: Column) -> Column:
    return _first(text, COMPETITIONS)


def office(text: Column) -> Column:
    return _first(text, OFFICES)


def rank_semantics(text: Column, kind: Column) -> Column:
    """top_half, top_N, exact_rank_N or leader; null where no rank is told."""
    t = text
    top, exact = F.regexp_extract(t, r"\btop ([0-9]+)\b", 1), F.regexp_extract(t, r"\b(?:rank|be|finish) #?([0-9]+)\b", 1)
    return F.when(t.contains("top half"), "top_half").when(top != "", F.concat(F.lit("top_"), top.cast("int").cast("string"))).when(exact != "", F.concat(F.lit("exact_rank_"), exact.cast("int").cast("string"))).when((kind == "leader") | t.contains("most searched"), "leader")


def jurisdiction(text: Column, office_scope: Column) -> Column:
    """struct(country, region, district): states and districts only where the text is about the United States."""
    t = text
    us = office_scope.isin("us_house", "us_senate") | t.rlike(r"\b(u s|us|united states|midterm|congress)\b")
    longest = lambda names: sorted(names.items(), key=lambda x: (-len(x[0]), x[0]))
    state = F.coalesce(*[F.when(t.rlike(rf"\b{name}\b"), F.lit(f"US-{code}")) for name, code in longest(STATES)])
    country = F.coalesce(*[F.when(t.rlike(rf"\b{name}\b"), F.lit(code)) for name, code in longest(COUNTRIES)])
    letters, number = F.upper(F.regexp_extract(t, r"\b([a-z]{2})[- ]?([0-9]{1,2})\b", 1)), F.regexp_extract(t, r"\b([a-z]{2})[- ]?([0-9]{1,2})\b", 2)
    district = F.when(letters.isin(sorted(set(STATES.values()))), F.concat(F.lit("US-"), letters, F.lit("-"), F.lpad(number, 2, "0")))
    us = F.coalesce(us, F.lit(False))
    return F.struct(F.when(us, "US").otherwise(country).alias("country"), F.when(us, state).alias("region"), F.when(us, district).alias("district"))


def identity_of(context: Column) -> Column:
    """The words of a context without its numbers and comparisons."""
    t = F.regexp_replace(context, r"\b(?:win|winner|wins|exactly|at least|more than|above|over|under|below|top|most)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b[0-9]+(?:\.[0-9]+)?\b", " "), r"\s+", " "))


def family(dom: Column, kind: Column, measured: Column, office_scope: Column, contest: Column, text: Column) -> Column:
    """The payoff family that a contract is compared within."""
    p, m = F.coalesce(kind, F.lit("unknown")), F.coalesce(measured, F.lit("generic"))
    joined = lambda *parts: F.concat_ws(":", *parts)
    politics = F.when(measured.isin("seats", "votes"), joined(F.lit("politics_count"), F.coalesce(office_scope, F.lit("generic")), measured, p)).when(office_scope.isNotNull(), joined(F.lit("politics_office"), office_scope, p)).otherwise(joined(F.lit("politics_generic"), p))
    sports = F.when(measured.isin(*MATCH_METRICS), joined(F.lit("sports_stat"), measured, p)).when(contest.isNotNull(), joined(F.lit("sports_comp"), contest, p)).otherwise(joined(F.lit("sports_event"), p))
    counted = kind.isin("above_threshold", "below_threshold", "range", "exact_count")
    asset = text.rlike(rf"\b({'|'.join(ASSETS)})\b")
    other = F.when(counted & asset, joined(F.lit("asset_threshold"), p)).when(counted & measured.isNotNull(), joined(F.lit("numeric"), measured, p)).otherwise(joined(F.coalesce(dom, F.lit("other")), p))
    return F.when(dom == "politics", politics).when(dom == "sports", sports).when(dom.isin("crypto", "economics", "weather"), joined(dom, m, p)).otherwise(other)


def anchors(text: Column) -> Column:
    """The words of a text that may anchor an event: three letters or more, no years, none of those that every market has."""
    return F.filter(tokens(text, 3), lambda w: ~w.isin(NO_ANCHOR))


def signatures(df: DataFrame, keys: Sequence[str], title: str, subject: str | None, categories: Sequence[str], description: str, source: str, closes: Sequence[str]) -> DataFrame:
    """``keys`` and all attributes of the contract in each row; the latest of the clocks ``closes`` (timestamps) counts as its settlement.

    Texts are brought into their normal form once, and attributes that others are read from come before them.
    """
    c = F.col
    asked = F.nullif(F.trim(F.regexp_extract(c(title), r"(?i)^\s*will\s+(.+?)\s+(?:win|make|be|become|play|take|lift)\b", 1)), F.lit(""))
    who = asked if subject is None else F.coalesce(F.nullif(F.trim(c(subject)), F.lit("")), asked)
    base = df.select(
        *keys, c(title).alias("__title"), who.alias("subject"), normal(c(title)).alias("__t"), normal(F.concat_ws(" ", title, description)).alias("__w"), F.concat_ws(" ", *categories).alias("__c") if categories else F.lit("").alias("__c"),
        rules.profile(c(description)).alias("__r"), entities.source_key(c(source)).alias("source"), (F.greatest(*closes) if len(closes) > 1 else c(closes[0])).alias("settles_at"),
    )
    read = base.select(
        *keys, "__title", "__t", "__r", "subject", "source", "settles_at", domain([c("__c")], c("__t")).alias("domain"), proposition(c("__t")).alias("proposition"), metric(c("__w")).alias("metric"), competition(c("__w")).alias("competition"), office(c("__t")).alias("office"),
        entities.context_key(c("__title"), c("subject")).alias("context"), season_key(c("__title")).alias("season"), parsing.threshold(c("__title")).alias("__limit"),
    )
    filled = [c("domain") != "other", *[c(x).isNotNull() for x in ("proposition", "subject", "season", "settles_at", "source")]]
    place = jurisdiction(c("__t"), c("office"))
    return read.withColumn("__p", place).select(
        *keys, "domain", "proposition", "subject", "competition", "context", identity_of(c("context")).alias("identity"), "season", c("__limit.op").alias("threshold_op"), c("__limit.low").alias("threshold_low"), c("__limit.high").alias("threshold_high"),
        "metric", rank_semantics(c("__t"), c("proposition")).alias("rank"), F.when(c("__t").rlike(r"\bwomens?\b"), "women").when(c("__t").rlike(r"\bmens?\b"), "men").alias("gender"), "office",
        c("__p.country").alias("country"), c("__p.region").alias("region"), c("__p.district").alias("district"), "source", c("__r.basis").alias("basis"), c("__r.flags").alias("flags"), c("__r.sources").alias("source_families"),
        c("__r.deadline").alias("deadline"), c("__r.present").alias("rules_present"), c("__r.coverage").alias("coverage"), family(c("domain"), c("proposition"), c("metric"), c("office"), c("competition"), c("__t")).alias("family"),
        anchors(c("__title")).alias("anchors"), "settles_at", (sum((F.coalesce(f, F.lit(False)).cast("int") for f in filled), F.lit(0)) / len(filled)).alias("completeness"),
    )


def legacy_key(title: Column, subject: Column) -> Column:
    """The five attributes that a structural join equates: proposition, topic, year, subject, threshold; nulls are values."""
    return F.struct(proposition(normal(title)).alias("proposition"), identity_of(entities.context_key(title, subject)).alias("topic"), parsing.explicit_year(title).alias("year"), entities.canonical_entity(subject).alias("subject"), parsing.threshold(title)["low"].alias("threshold"))
