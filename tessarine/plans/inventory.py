"""Queries of scalars, entities, rules, books and feeds over the contract tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarine.functions import entities, parsing, similarity, text
from tessarine.operators import books, contracts, ledger, linkage, rules, scoring, timestamps
from tessarine.plans.relational import Source, query
from tessarine.session import materialise, slots
from tessarine.sources import feeds, readers

# Sources: predicates, merges and lookups


@query("a13_rich_rows", """
    select vec_id from semantic_poly where length(trim(coalesce(poly_id, ''), ' ')) > 0
        and (length(trim(coalesce(rerank_text, ''), ' ')) > 0 or encoded_at is not null) and domain is not null""")  # fmt: skip
def a13(t):
    ok = feeds.rich(F.col("poly_id"), F.col("rerank_text"), F.col("encoded_at"), F.col("domain").isNotNull())
    return t("semantic_poly").where(ok).select("vec_id")


@query("a12_newest_by_id", """
    select ticker, rule_id, fetched_at::varchar as fetched from raw_settlement_rules where ticker is not null
    qualify row_number() over (partition by ticker order by fetched_at desc nulls last, rule_id desc) = 1""")  # fmt: skip
def a12(t):
    rows = t("raw_settlement_rules").where("ticker is not null").select("ticker", "rule_id", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    return feeds.newest(rows, "ticker", [F.col("fetched_at").desc_nulls_last(), F.col("rule_id").desc()]).select("ticker", "rule_id", F.col("fetched_at").cast("string").alias("fetched"))


@query("a16_merged_universe", """
    with flat as (select sig_id, subject, season_year from kalshi_signature where sig_id % 3 = 0),
    keyset as (select sig_id, subject, season_year, structured_complete from kalshi_signature where sig_id % 2 = 0),
    fresh as (select * from keyset where sig_id not in (select sig_id from flat)),
    rich as (select sig_id, subject, season_year from fresh where structured_complete),
    filled as (select f.sig_id, d.subject, f.season_year from fresh f join kalshi_signature d on d.sig_id = f.sig_id where not f.structured_complete and d.sig_id % 5 <> 0)
    select * from flat union all select * from rich union all select * from filled""")  # fmt: skip
def a16(t):
    rows = t("kalshi_signature").select("sig_id", "subject", "season_year", "structured_complete")
    flat, keyset = rows.where("sig_id % 3 = 0").drop("structured_complete"), rows.where("sig_id % 2 = 0")
    details = rows.where("sig_id % 5 <> 0").select("sig_id", "subject")
    return feeds.merged_universe(flat, keyset, details, "sig_id", F.col("structured_complete")).select("sig_id", "subject", "season_year")


@query("a17_limited_universe", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 50")
def a17(t):
    flat = t("orders").select("o_orderkey", "o_totalprice")
    return feeds.universe(flat, flat, 50, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey")


@query("a8_milestone_index", """
    with m as (select user_id as milestone, list(distinct event_type) as related, ['view', 'click'] as prim from events group by user_id),
    n as (select distinct milestone, unnest(list_concat(related, prim)) as event_type from m), e as (select distinct event_type from events),
    g as (select event_type, count(*) as n, min(milestone) as first_one, max(milestone) as last_one from n group by event_type)
    select e.event_type, coalesce(n, 0) as n, first_one, last_one from e left join g using (event_type)""")  # fmt: skip
def a8(t):
    events = t("events").select("event_type").distinct()
    made = t("events").groupBy(F.col("user_id").alias("milestone")).agg(F.collect_set("event_type").alias("related")).withColumn("prim", F.array(F.lit("view"), F.lit("click")))
    held = feeds.event_index(events, made, "event_type", "milestone", "related", "prim")
    return held.select("event_type", F.size("milestones").cast("bigint").alias("n"), F.array_min("milestones").alias("first_one"), F.array_max("milestones").alias("last_one"))


@query("a6_trade_window", """
    select event_id from events where ts between timestamp '2024-01-05' and timestamp '2024-01-20' and event_type in ('click', 'purchase') and not (user_id % 10 = 0)""")
def a6(t):
    trades = t("events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type", (F.col("user_id") % 10 == 0).alias("block"))
    first, last = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return feeds.trade_window(trades, "event_type", "at", "block", first, last, ["click", "purchase"], False).select("event_id")


# Scalars


@query("c2_legacy_text", r"""
    select sig_id, trim(regexp_replace(regexp_replace(lower(coalesce(kalshi_title, '')), '[^a-z0-9.\-%\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ') as words from kalshi_signature""")
def c2(t):
    return t("kalshi_signature").select("sig_id", text.legacy_words(F.col("kalshi_title")).alias("words"))


@query("c7_end_of_day", r"""
    select distinct rule_id, epoch(case when regexp_matches(polymarket_end_date, '^\d{4}-\d\d-\d\d$') then try_strptime(polymarket_end_date, '%Y-%m-%d') + interval 86399 second
        else try_strptime(polymarket_end_date, '%Y-%m-%dT%H:%M:%SZ') end)::bigint as end_s
    from raw_settlement_rules where regexp_matches(polymarket_end_date, '^\d{4}-\d\d-\d\d(T[01]\d:\d\d:\d\dZ)?$')""")  # fmt: skip
def c7(t):
    iso = t("raw_settlement_rules").where(F.col("polymarket_end_date").rlike(r"^\d{4}-\d\d-\d\d(T[01]\d:\d\d:\d\dZ)?$"))
    return iso.select("rule_id", F.unix_seconds(timestamps.utc_instant(F.col("polymarket_end_date"), F.lit(None).cast("string"), end_of_day=True)).alias("end_s")).distinct()


@query("c9_default_end", r"""
    select distinct rule_id, floor(epoch(coalesce(try_strptime(polymarket_end_date, '%Y-%m-%dT%H:%M:%SZ'), fetched_at + interval 30 day)))::bigint as end_s
    from raw_settlement_rules where fetched_at is not null and (polymarket_end_date is null or regexp_matches(polymarket_end_date, '^\d{4}-\d\d-\d\dT[01]\d:\d\d:\d\dZ$'))""")  # fmt: skip
def c9(t):
    rows = t("raw_settlement_rules").where(F.col("fetched_at").isNotNull() & (F.col("polymarket_end_date").isNull() | F.col("polymarket_end_date").rlike(r"^\d{4}-\d\d-\d\dT[01]\d:\d\d:\d\dZ$")))
    end = timestamps.instant_or(F.col("polymarket_end_date"), F.lit(None).cast("string"), F.col("fetched_at").cast("timestamp"), 30)
    return rows.select("rule_id", F.unix_seconds(end).alias("end_s")).distinct()


@query("c13_cutoffs", r"""
    with w as (select doc_id, regexp_replace(regexp_replace(lower(text), '[''"`’]', '', 'g'), '[^a-z0-9]+', ' ', 'g') as t from documents where text is not null and lang = 'en' and regexp_matches(text, '^[\x00-\x7F]*$')),
    m as (select doc_id, t, regexp_extract(t, '\b(january|february|march|april|may|june|july|august|september|october|november|december) (\d{1,2})(?: (20\d\d))?\b', ['n', 'd', 'y']) as f,
        regexp_extract(t, '\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) (\d{1,2})(?: (20\d\d))?\b', ['n', 'd', 'y']) as s, regexp_extract(t, '\b(before|by) (20\d\d)\b', ['o', 'y']) as b from w),
    p as (select doc_id, t, b, case when f.n <> '' then f else s end as x from m),
    o as (select *, '(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b' as months from p)
    select doc_id,
        case when x.n = '' then nullif(b.o, '') when regexp_matches(t, '\bbefore ' || months) then 'before' when regexp_matches(t, '\b(by|on or before|on or prior to) ' || months) then 'by' when regexp_matches(t, '\bon ' || months) then 'on' end as op,
        case when x.n = '' then nullif(b.y, '')::int else nullif(x.y, '')::int end as year,
        case when x.n <> '' then list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], left(x.n, 3)) when b.o <> '' then 1 end::int as month,
        case when x.n <> '' then nullif(x.d, '')::int when b.o <> '' then 1 end as day from o""")  # fmt: skip
def c13(t):
    rows = t("documents").where(F.col("text").isNotNull() & (F.col("lang") == "en") & F.col("text").rlike(r"^[\x00-\x7F]*$"))
    return rows.select("doc_id", parsing.cutoff(F.col("text")).alias("c")).select("doc_id", *[F.col(f"c.{x}").alias(x) for x in ("op", "year", "month", "day")])


@query("c14_dates_in_text", r"""
    select distinct rule_id, try_strptime(nullif(regexp_extract(kalshi_close_time, '\b(20\d\d-\d\d-\d\d)\b', 1), ''), '%Y-%m-%d')::date::varchar as iso,
        nullif(regexp_extract(kalshi_title, '\b(20\d\d)\b', 1), '')::int as year from raw_settlement_rules""")  # fmt: skip
def c14(t):
    rows = t("raw_settlement_rules")
    return rows.select("rule_id", parsing.iso_date(F.col("kalshi_close_time")).cast("string").alias("iso"), parsing.explicit_year(F.col("kalshi_title")).alias("year")).distinct()


@query("c16_thresholds", r"""
    with t as (select sig_id, regexp_replace(lower(polymarket_question), '([0-9]),([0-9]{3})', '\1\2', 'g') as x from poly_signature),
    u as (select sig_id, regexp_replace(x, '([0-9]),([0-9]{3})', '\1\2', 'g') as x from t),
    n as (select sig_id, regexp_extract(x, 'between \$?([0-9]+(?:\.[0-9]+)?)\s*%? and \$?([0-9]+(?:\.[0-9]+)?)', 1) as r1, regexp_extract(x, 'between \$?([0-9]+(?:\.[0-9]+)?)\s*%? and \$?([0-9]+(?:\.[0-9]+)?)', 2) as r2,
        regexp_extract(x, '\bexactly \$?([0-9]+(?:\.[0-9]+)?)', 1) as eq, regexp_extract(x, '(?:at least|greater than or equal to) \$?([0-9]+(?:\.[0-9]+)?)', 1) as ge,
        regexp_extract(x, '(?:more than|greater than|above|over) \$?([0-9]+(?:\.[0-9]+)?)', 1) as gt, regexp_extract(x, '(?:at most|less than or equal to) \$?([0-9]+(?:\.[0-9]+)?)', 1) as le,
        regexp_extract(x, '(?:less than|fewer than|below|under) \$?([0-9]+(?:\.[0-9]+)?)', 1) as lt from u)
    select sig_id, case when r1 <> '' then 'range' when eq <> '' then 'eq' when ge <> '' then 'ge' when gt <> '' then 'gt' when le <> '' then 'le' when lt <> '' then 'lt' end as op,
        case when r1 <> '' then r1 when eq <> '' then eq when ge <> '' then ge when gt <> '' then gt when le <> '' then le when lt <> '' then lt end::double as low, nullif(r2, '')::double as high from n""")  # fmt: skip
def c16(t):
    return t("poly_signature").select("sig_id", parsing.threshold(F.col("polymarket_question")).alias("x")).select("sig_id", *[F.col(f"x.{c}").alias(c) for c in ("op", "low", "high")])


@query("c17_asset_thresholds", r"""
    with t as (select sig_id, lower(kalshi_title) as low, replace(kalshi_title, ',', '') as x from kalshi_signature where domain = 'crypto'),
    m as (select *, regexp_extract(x, '\$\s*([0-9]+(?:\.[0-9]+)?)\s*([kKmM])?', ['v', 's']) as a, regexp_extract(x, '(above|over|below|under|greater than|less than|higher than|lower than|exceed)\s+\$?\s*([0-9]+(?:\.[0-9]+)?)\s*([kKmM])?', ['w', 'v', 's'], 'i') as b from t),
    p as (select sig_id, low, case when a.v <> '' then a.v else b.v end as v, lower(case when a.v <> '' then a.s else b.s end) as s from m)
    select sig_id, nullif(v, '')::double * case s when 'k' then 1e3 when 'm' then 1e6 else 1 end as threshold,
        case when regexp_matches(' ' || low || ' ', ' (above|over|greater than|higher than|exceed|close above) ') then 'above' when regexp_matches(' ' || low || ' ', ' (below|under|less than|lower than|dip to|close below) ') then 'below' end as side from p""")  # fmt: skip
def c17(t):
    rows = t("kalshi_signature").where("domain = 'crypto'")
    return rows.select("sig_id", parsing.asset_threshold(F.col("kalshi_title")).alias("threshold"), parsing.direction(F.col("kalshi_title")).alias("side"))


@query("c21_whole_contracts", "select distinct signal_id, case when not isnan(quantity) then trunc(quantity)::bigint end as contracts from signals")
def c21(t):
    return t("signals").select("signal_id", parsing.whole(F.col("quantity")).alias("contracts")).distinct()


_RANGES = '[{"start": 0.0, "end": 0.02, "step": 0.001}, {"start": 0.02, "end": 0.05, "step": 0.005}, {"start": "x", "end": 1, "step": 1}]'


@query("c22_tick_size", "select l_orderkey, l_linenumber, case when l_discount between 0 and 0.02 then 0.001 when l_discount between 0.02 and 0.05 then 0.005 else 0.01 end::double as tick from lineitem")
def c22(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", parsing.tick_size(F.lit(_RANGES), F.col("l_discount").cast("double")).alias("tick"))


@query("c23_rounded_up", """
    with v as (select event_id, 0.07 * value * 0.5 * 0.5 as raw from events where value is not null and not isnan(value)),
    c as (select event_id, raw, case when raw <= 0 then 0 else ceil(raw * 10000) / 10000 end as centicent from v)
    select event_id, centicent, case when centicent <= 0 then 0 else ceil(centicent * 100) / 100 end as cent from c""")  # fmt: skip
def c23(t):
    raw = F.lit(0.07) * F.col("value") * 0.5 * 0.5
    rows = t("events").where("value is not null and not isnan(value)").select("event_id", parsing.ceil_to(raw, 10_000).alias("centicent"))
    return rows.withColumn("cent", parsing.ceil_to(F.col("centicent"), 100))


@query("c29_pair_text", """
    select sig_id, left(concat_ws(' ', nullif(trim(polymarket_question, ' '), ''), nullif(trim(subject, ' '), ''), nullif(trim(competition, ' '), ''), nullif(trim(season_year, ' '), '')), 60) as serial from poly_signature""")
def c29(t):
    return t("poly_signature").select("sig_id", parsing.capped_text(60, *[F.col(c) for c in ("polymarket_question", "subject", "competition", "season_year")]).alias("serial"))


# Signatures


@query("d6_context_key", r"""
    with n as (select sig_id, ' ' || trim(regexp_replace(regexp_replace(lower(strip_accents(kalshi_title)), '[^a-z0-9%$.\-\s]', ' ', 'g'), '\s+', ' ', 'g')) || ' ' as t,
        trim(regexp_replace(regexp_replace(lower(strip_accents(subject)), '[^a-z0-9%$.\-\s]', ' ', 'g'), '\s+', ' ', 'g')) as s from kalshi_signature where regexp_matches(coalesce(kalshi_title, ''), '^[\x00-\x7F]*$')),
    a as (select sig_id, case when s <> '' then replace(t, ' ' || s || ' ', '  ') else t end as t from n),
    b as (select sig_id, regexp_replace(t, '\b20[0-9]{2}(?:\s*-\s*(?:20)?[0-9]{2})?\b', ' ', 'g') as t from a)
    select sig_id, trim(regexp_replace(regexp_replace(t, '\b(?:will|who|be|become|the|in|market|yes|no)\b', ' ', 'g'), '\s+', ' ', 'g'), ' ') as context_key from b""")  # fmt: skip
def d6(t):
    rows = t("kalshi_signature").where(F.coalesce("kalshi_title", F.lit("")).rlike(r"^[\x00-\x7F]*$"))
    return rows.select("sig_id", entities.context_key(F.col("kalshi_title"), F.col("subject")).alias("context_key"))


@query("d8_source_key", r"""
    with w as (select sig_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(resolution_source), '[^a-z0-9%$\-\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
        lambda x: length(x) > 2 and x not in ('http', 'https', 'www', 'com', 'org', 'source', 'official')) as x from kalshi_signature)
    select sig_id, nullif(array_to_string(x[1:12], ' '), '') as source_key from w""")  # fmt: skip
def d8(t):
    return t("kalshi_signature").select("sig_id", entities.source_key(F.col("resolution_source")).alias("source_key"))


# Entities


_CANON_SQL = r"""
    n as (select sig_id, trim(regexp_replace(replace(regexp_replace(lower(strip_accents(coalesce(subject, ''))), '[^a-z0-9%$.\-\s]', ' ', 'g'), '.', ' '), '\s+', ' ', 'g')) as t from {0}),
    w as (select sig_id, list_filter(string_split(t, ' '), lambda x: x <> '' and x not in ('fc', 'afc', 'cf', 'the', 'team', 'club', 'jr', 'sr', 'ii', 'iii', 'iv')) as x from n),
    m as (select sig_id, case when len(x) >= 3 then list_concat(list_concat(x[1:1], list_filter(x[2:len(x) - 1], lambda y: length(y) > 1)), x[len(x):len(x)]) else x end as x from w),
    c as (select sig_id, array_to_string(x, ' ') as name from m)"""


@query("e4_canonical_entities", "with" + _CANON_SQL.format("poly_signature") + " select sig_id, name from c")
def e4(t):
    return t("poly_signature").select("sig_id", entities.canonical_entity(F.col("subject")).alias("name"))


@query("e5_equivalent_entities", "with recursive" + _CANON_SQL.format("(select sig_id, subject, season_year from kalshi_signature union all select sig_id, subject, season_year from poly_signature)") + """,
    y as (select sig_id, season_year as y, competition as k, 1 as side from kalshi_signature union all select sig_id, season_year, competition, 2 from poly_signature),
    p as (select a.sig_id as left_id, b.sig_id as right_id, ca.name as x, cb.name as z from y a join y b on a.y = b.y and a.k = b.k and a.side = 1 and b.side = 2 join c ca on ca.sig_id = a.sig_id join c cb on cb.sig_id = b.sig_id)
    select left_id, right_id, x = z as same_name from p where x <> '' and z <> '' and (x = z or (list_sort(list_distinct(string_split(x, ' '))) = list_sort(list_distinct(string_split(z, ' '))) and len(list_distinct(string_split(x, ' '))) >= 2))""")  # fmt: skip
def e5(t):
    side = lambda name, i, c: t(name).where("season_year is not null and competition is not null").select(F.col("sig_id").alias(i), "season_year", "competition", entities.canonical_entity(F.col("subject")).alias(c))
    pairs = side("kalshi_signature", "left_id", "x").join(side("poly_signature", "right_id", "z"), ["season_year", "competition"])
    return pairs.where(entities.equivalent(F.col("x"), F.col("z"))).select("left_id", "right_id", (F.col("x") == F.col("z")).alias("same_name"))


@query("e5_entity_scores")
def e5_scores(t):
    side = lambda name, i, c: t(name).where("season_year is not null and metric is not null and subject is not null").select(F.col("sig_id").alias(i), "season_year", "metric", entities.canonical_entity(F.col("subject")).alias(c))
    pairs = side("kalshi_signature", "left_id", "x").join(side("poly_signature", "right_id", "z"), ["season_year", "metric"]).where(F.substring("x", 1, 3) == F.substring("z", 1, 3))
    return pairs.select("left_id", "right_id", F.round(entities.equivalence(F.col("x"), F.col("z")), 6).alias("score"))


def _title_pairs(t: Source):
    """Each pair of titles once, over all slots: comparing them is heavier than their shuffle, which would be drawn together by its size."""
    rows = t("match_audit").where("kalshi_title is not null and polymarket_question is not null").select("audit_id", "kalshi_title", "polymarket_question")
    return rows.repartition(4 * slots(rows.sparkSession), "audit_id").distinct()


@query("e3_identity_similarity")
def e3(t):
    return _title_pairs(t).select("audit_id", F.round(entities.identity_similarity(F.col("kalshi_title"), F.col("polymarket_question")), 6).alias("likeness"))


@query("e2_title_words", r"""
    with s as (select ['will', 'the', 'a', 'an', 'in', 'on', 'at', 'to', 'of', 'for', 'be', 'is', 'and', 'or', 'by', 'from'] as stop),
    w as (select r.rule_id, list_distinct(list_filter(regexp_extract_all(lower(kalshi_title), '[a-z0-9]+'), lambda x: length(x) > 1 and not list_contains(stop, x))) as a,
        list_distinct(list_filter(regexp_extract_all(lower(poly_question), '[a-z0-9]+'), lambda x: length(x) > 1 and not list_contains(stop, x))) as b
        from (select distinct rule_id, kalshi_title, poly_question from raw_settlement_rules where regexp_matches(kalshi_title || poly_question, '^[\x00-\x7F]*$')) r, s)
    select rule_id, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6) as jac from w""")  # fmt: skip
def e2(t):
    stop = ["will", "the", "a", "an", "in", "on", "at", "to", "of", "for", "be", "is", "and", "or", "by", "from"]
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1), lambda w: (F.length(w) > 1) & ~w.isin(stop)))
    rows = t("raw_settlement_rules").where(F.concat("kalshi_title", "poly_question").rlike(r"^[\x00-\x7F]*$")).select("rule_id", words("kalshi_title").alias("a"), words("poly_question").alias("b")).distinct()
    return rows.select("rule_id", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("jac"))


@query("e9_anchors", r"""
    with p as (select a.sig_id as l, b.sig_id as r, lower(a.subject) as x, lower(b.subject) as y, coalesce(a.kalshi_title, '') as tx, coalesce(b.polymarket_question, '') as ty from kalshi_signature a join poly_signature b on a.metric = b.metric and a.season_year = b.season_year
        where regexp_matches(a.subject || b.subject, '^[A-Za-z ]*$')),
    w as (select *, list_distinct(string_split(trim(regexp_replace(x, ' +', ' ', 'g')), ' ')) as wx, list_distinct(string_split(trim(regexp_replace(y, ' +', ' ', 'g')), ' ')) as wy from p)
    select l, r, round(len(list_intersect(wx, wy)) / least(len(wx), len(wy)), 6) as overlap,
        list_sort(list_filter(wx, lambda z: z not in ('jr', 'sr', 'ii', 'iii', 'iv'))) = list_sort(list_filter(wy, lambda z: z not in ('jr', 'sr', 'ii', 'iii', 'iv'))) as same_person,
        regexp_extract(tx, '\b(20\d\d)\b', 1) = '' or regexp_extract(ty, '\b(20\d\d)\b', 1) = '' or regexp_extract(tx, '\b(20\d\d)\b', 1) = regexp_extract(ty, '\b(20\d\d)\b', 1) as same_year
    from w where len(list_intersect(wx, wy)) > 0""")  # fmt: skip
def e9(t):
    # What is said of a name is worked out once a record. Pairs meet at the words they share and count at the first of them.
    keys = ["metric", "season_year"]

    def side(name, s, title):
        rows = t(name).where(F.col("subject").rlike(r"^[A-Za-z ]*\z") & F.col("metric").isNotNull() & F.col("season_year").isNotNull())
        words = F.array_distinct(F.split(text.spaced_words(F.col("subject")), " "))
        held = rows.select(*keys, F.col("sig_id").alias(s), words.alias(f"{s}w"), entities.person_words(F.col("subject")).alias(f"{s}p"), entities.first_year(F.col(title)).alias(f"{s}y"))
        return held.withColumn("word", F.explode(f"{s}w"))

    met = side("kalshi_signature", "l", "kalshi_title").join(side("poly_signature", "r", "polymarket_question"), [*keys, "word"])
    met = met.where(F.get(F.array_intersect("lw", "rw"), F.lit(0)) == F.col("word"))
    overlap = F.round(entities.anchor_overlap(F.col("lw"), F.col("rw")), 6)
    return met.select("l", "r", overlap.alias("overlap"), entities.same_words(F.col("lp"), F.col("rp")).alias("same_person"), entities.years_agree(F.col("ly"), F.col("ry")).alias("same_year"))


_SUBJECT_PAIRS = "select a.sig_id as l, b.sig_id as r, a, b from kalshi_signature a join poly_signature b on lower(a.subject) = lower(b.subject)"


def _subject_pairs(t: Source):
    """Pairs of signatures of the same subject, as structs a and b."""
    columns = ["domain", "proposition", "metric", "office_scope", "season_year", "competition", "stage", "threshold_op", "threshold_low", "threshold_high", "danger_flags", "resolution_source"]
    side = lambda name, i, s: t(name).where("subject is not null").select(F.col("sig_id").alias(i), F.lower("subject").alias("who"), F.struct(*columns).alias(s))
    return side("kalshi_signature", "l", "a").join(side("poly_signature", "r", "b"), "who").drop("who")


@query("e10_threshold_compatibility", f"""
    with p as ({_SUBJECT_PAIRS}),
    o as (select l, r, a.threshold_low as al, b.threshold_low as bl, a.threshold_high as ah, b.threshold_high as bh,
        case a.threshold_op when 'ge_structured' then 'ge' when 'le_structured' then 'le' when 'structured' then 'unspecified' when 'threshold_unspecified' then 'unspecified' else a.threshold_op end as x,
        case b.threshold_op when 'ge_structured' then 'ge' when 'le_structured' then 'le' when 'structured' then 'unspecified' when 'threshold_unspecified' then 'unspecified' else b.threshold_op end as y from p)
    select l, r, (al is null and bl is null and ah is null and bh is null) or (coalesce(abs(al - bl) <= 1e-9, al is null and bl is null) and coalesce(abs(ah - bh) <= 1e-9, ah is null and bh is null)
        and (x is not distinct from y or coalesce(x = 'unspecified', false) or coalesce(y = 'unspecified', false))) as compatible from o""")  # fmt: skip
def e10(t):
    c = lambda s, x: F.col(f"{s}.{x}")
    ok = entities.thresholds_compatible(*[c(s, x) for s in "ab" for x in ("threshold_op", "threshold_low", "threshold_high")])
    return _subject_pairs(t).select("l", "r", ok.alias("compatible"))


@query("e11_domain_compatibility", f"with p as ({_SUBJECT_PAIRS}) select l, r, coalesce(a.domain, 'other') = 'other' or coalesce(b.domain, 'other') = 'other' or a.domain = b.domain as same_domain from p")
def e11(t):
    return _subject_pairs(t).select("l", "r", entities.same_domain(F.col("a.domain"), F.col("b.domain")).alias("same_domain"))


@query("e11_source_compatibility")
def e11_sources(t):
    return _subject_pairs(t).select("l", "r", entities.sources_compatible(F.col("a.resolution_source"), F.col("b.resolution_source")).alias("compatible"))


@query("e8_subject_compatibility", r"""
    with p as (select a.sig_id as l, b.sig_id as r, lower(a.subject) as x, lower(b.subject) as y from kalshi_signature a join poly_signature b on a.metric = b.metric and a.season_year = b.season_year where regexp_matches(a.subject || b.subject, '^[A-Za-z ]*$')),
    q as (select l, r, trim(regexp_replace(x, ' +', ' ', 'g')) as x, trim(regexp_replace(y, ' +', ' ', 'g')) as y from p),
    w as (select *, list_distinct(list_filter(string_split(x, ' '), lambda z: length(z) > 1)) as wx, list_distinct(list_filter(string_split(y, ' '), lambda z: length(z) > 1)) as wy from q)
    select l, r from w where x <> '' and y <> '' and (x = y or (length(x) >= 5 and length(y) >= 5 and (contains(x, y) or contains(y, x))) or (len(list_distinct(list_concat(wx, wy))) > 0 and len(list_intersect(wx, wy)) / len(list_distinct(list_concat(wx, wy))) >= 0.6))""")  # fmt: skip
def e8(t):
    side = lambda name, i, s: t(name).select(F.col("sig_id").alias(i), F.col("subject").alias(s), "metric", "season_year")
    pairs = side("kalshi_signature", "l", "x").join(side("poly_signature", "r", "y"), ["metric", "season_year"]).where(F.concat("x", "y").rlike("^[A-Za-z ]*$"))
    return pairs.where(entities.subject_compatible(F.col("x"), F.col("y"))).select("l", "r")


# Candidates


@query("g4_source_bits", """
    with c as (select distinct cand_id, retrieval_sources as s from hybrid_candidate),
    n as (select list_sort(list(distinct x)) as names from (select unnest(retrieval_sources) as x from hybrid_candidate)),
    m as (select cand_id, case when s is not null then list_sum(list_transform(names, lambda y, i: case when list_contains(s, y) then (1 << (i - 1)::int) else 0 end)) end::bigint as mask, names, s from c, n)
    select cand_id, mask, list_sort(list_distinct(coalesce(s, []))) as unpacked from m""")  # fmt: skip
def g4(t):
    rows = t("hybrid_candidate").select("cand_id", "retrieval_sources").dropDuplicates(["cand_id"])
    # The retrieval passes are a closed vocabulary; one that a bitmap cannot hold is refused.
    names = [r[0] for r in rows.select(F.explode("retrieval_sources").alias("s")).distinct().orderBy("s").limit(63).collect()]
    if len(names) > 62:
        raise ValueError("a bitmap holds at most 62 sources")
    held = rows.select("cand_id", entities.packed(F.col("retrieval_sources"), names).alias("mask"))
    return held.select("cand_id", "mask", F.coalesce(entities.unpacked(F.col("mask"), names), F.array().cast("array<string>")).alias("unpacked"))


def _evidence(column: str, bonus: str, penalty: str) -> str:
    return f"case when a.{column} is null or b.{column} is null or a.{column} = '' or b.{column} = '' then 0 when a.{column} = b.{column} then {bonus} else {penalty} end"


@query("g6_pair_scores", f"""
    with p as ({_SUBJECT_PAIRS})
    select l, r, ({_evidence("proposition", "1", "-2")} + {_evidence("domain", "0.75", "(case when a.domain <> 'other' and b.domain <> 'other' then -1.5 else 0 end)")} + {_evidence("metric", "2", "-2")}
        + {_evidence("office_scope", "2", "-2")} + {_evidence("season_year", "1.5", "-1.5")} + {_evidence("competition", "2", "-2")}
        + case when a.threshold_low is null or b.threshold_low is null then 0 when abs(a.threshold_low - b.threshold_low) <= 1e-9 then 3 else -3 end)::double as evidence from p""")  # fmt: skip
def g6(t):
    return _subject_pairs(t).select("l", "r", entities.pair_score("a", "b").alias("evidence"))


@query("g7_family_guard", f"""
    with p as ({_SUBJECT_PAIRS}), q as (select l, r, a.domain as da, b.domain as db, a.stage as sa, b.stage as sb, a.competition as ca, b.competition as cb from p)
    select l, r from q where (coalesce(da, 'other') = 'other' or coalesce(db, 'other') = 'other' or da = db) and not (coalesce(da = 'sports' and db = 'sports', false) and (coalesce(sa <> sb, false) or coalesce(ca <> cb, false)))""")  # fmt: skip
def g7(t):
    differ = lambda c: F.coalesce(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(False))
    sports = F.coalesce((F.col("a.domain") == "sports") & (F.col("b.domain") == "sports"), F.lit(False))
    return _subject_pairs(t).where(entities.same_domain(F.col("a.domain"), F.col("b.domain")) & ~(sports & (differ("stage") | differ("competition")))).select("l", "r")


@query("g8_rescued_neighbours", """
    with p as (select q.vec_id as query_id, e.vec_id as neighbour_id, q.label = e.label as own,
        round(list_dot_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 6) as score
        from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0),
    d as (select query_id, neighbour_id, score from p where own and score >= 0.1 qualify row_number() over (partition by query_id order by score desc, neighbour_id) <= 10),
    g as (select query_id, neighbour_id, score from p where score >= 0.2 qualify row_number() over (partition by query_id order by score desc, neighbour_id) <= 2)
    select query_id, neighbour_id, round(score, 4) as score from (select * from d union select * from g)""")  # fmt: skip
def g8(t):
    rows = t("embeddings").select("vec_id", "label", "embedding")
    top = linkage.domain_top_k(rows.where("vec_id % 50 = 0"), rows, "label", "vec_id", "embedding", 10, 0.1, 2, 0.2)
    return top.select("query_id", "neighbour_id", F.round("score", 4).alias("score"))


# Books


def _levels(t: Source):
    side = F.when(F.col("l_linenumber") % 2 == 1, "yes").otherwise("no")
    return t("lineitem").select(F.col("l_partkey").alias("book"), side.alias("side"), F.round(F.col("l_discount") * 4 + 0.05, 4).cast("double").alias("price"), F.col("l_quantity").cast("double").alias("size"), "l_orderkey", "l_linenumber")


_LEVELS = "l as (select l_partkey as book, case when l_linenumber % 2 = 1 then 'yes' else 'no' end as side, round(l_discount * 4 + 0.05, 4)::double as price, l_quantity::double as size, l_orderkey, l_linenumber from lineitem)"


@query("a4_implied_quotes", f"""
    with {_LEVELS}, u as (select * from l where price > 0 and size > 0),
    g as (select book, max(price) filter (side = 'yes') as yes_bid, max(price) filter (side = 'no') as no_bid from u group by book),
    s as (select g.*, (select max(size) from u where u.book = g.book and side = 'yes' and price = yes_bid) as yes_bid_size, (select max(size) from u where u.book = g.book and side = 'no' and price = no_bid) as no_bid_size from g)
    select book, yes_bid, yes_bid_size, no_bid, no_bid_size, round(1 - no_bid, 4) as yes_ask, no_bid_size as yes_ask_size, round(1 - yes_bid, 4) as no_ask, yes_bid_size as no_ask_size from s""")  # fmt: skip
def a4(t):
    return books.implied_quotes(_levels(t).select("book", "side", "price", "size"), "book", "side", "price", "size")


@query("j3_cost_or_nothing", f"""
    with {_LEVELS}, b as (select *, coalesce(sum(size) over (partition by book order by price, l_orderkey, l_linenumber rows between unbounded preceding and 1 preceding), 0) as before from l where price > 0 and size > 0),
    q as (select unnest([5.0, 400.0, 900.0])::double as quantity), f as (select book, quantity, least(size, quantity - before) as take, price from b join q on before < quantity)
    select book, quantity, case when sum(take) >= quantity - 1e-9 then round(sum(take * price), 7) end as cost from f group by book, quantity""")  # fmt: skip
def j3(t):
    return books.filled_costs(_levels(t), "book", "price", "size", ["l_orderkey", "l_linenumber"], [5, 400, 900])


@query("j5_complement_ladder", f"""
    with {_LEVELS}, c as (select book, round(1 - price, 10) as price, size from l where side = 'no'), k as (select * from c where price > 0 and price < 1 and size > 0)
    select book, count(*) as levels, min(price) as best, round(sum(size), 2) as total, min_by(size, (price, size)) as best_size from k group by book""")  # fmt: skip
def j5(t):
    nested = _levels(t).where("side = 'no'").groupBy("book").agg(F.collect_list(F.struct("price", "size")).alias("levels"))
    held = nested.select("book", books.ladder(F.col("levels"), complement=True).alias("x")).where("size(x) > 0")
    first = F.element_at("x", F.lit(1))
    return held.select("book", F.size("x").cast("bigint").alias("levels"), first["price"].alias("best"), F.round(F.aggregate("x", F.lit(0.0), lambda a, y: a + y["size"]), 2).alias("total"), first["size"].alias("best_size"))


@query("a25_book_snapshots", f"""
    with {_LEVELS}, want as (select o_custkey as book, min(o_orderkey) as first_place, count(*) as requests from orders where o_custkey is not null group by 1),
    have as (select book, count(*) as levels from l where book % 7 <> 0 group by book)
    select w.book, first_place, requests, levels, case when h.book is null then 'not_found' end as failure from want w left join have h using (book)""")  # fmt: skip
def a25(t):
    have = _levels(t).where("book % 7 != 0").groupBy("book").agg(F.count("*").alias("levels"))
    return books.snapshots(t("orders").select(F.col("o_custkey").alias("book"), "o_orderkey"), "book", "o_orderkey", have)


@query("m14_tape_fills", """
    with e as (select event_id as trade_id, user_id % 50 as book, event_type as side, epoch_us(ts) as sec, round(value / 20) as price, 1.0 as size, user_id % 11 = 0 as block from events where value is not null and not isnan(value)),
    p as (select trade_id as probe_id, book, side, sec as placed_at, price as bid, 2.0 as queue, 1.0 as quantity, sec + 86400000000 as until from e where trade_id % 97 = 0),
    m as (select p.probe_id, p.bid, p.queue, p.quantity, e.sec, e.price, e.trade_id, e.size from p join e on e.book = p.book and e.side = p.side where not block and e.sec > placed_at and e.sec <= until and e.price <= bid),
    t as (select probe_id, min(sec) as through_at from m where price < bid group by 1),
    c as (select *, sum(size) over (partition by probe_id order by sec, trade_id rows unbounded preceding) as run from m where price = bid),
    q as (select probe_id, min(sec) as queue_at from c where run >= queue + quantity group by 1)
    select probe_id, least(coalesce(through_at, queue_at), coalesce(queue_at, through_at)) as filled_at, case when through_at <= coalesce(queue_at, through_at) then 'through' else 'queue' end as kind from t full join q using (probe_id)""")  # fmt: skip
def m14(t):
    e = t("events").where("value is not null and not isnan(value)").select(
        F.col("event_id").alias("trade_id"), (F.col("user_id") % 50).alias("book"), F.col("event_type").alias("side"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.round(F.col("value") / 20).alias("price"), F.lit(1.0).alias("size"), (F.col("user_id") % 11 == 0).alias("block"),
    )
    probes = e.where("trade_id % 97 = 0").select(F.col("trade_id").alias("probe_id"), "book", "side", F.col("at").alias("placed_at"), "price", F.lit(2.0).alias("queue"), F.lit(1.0).alias("quantity"), (F.col("at") + 86_400_000_000).alias("until"))
    return ledger.fresh_fills(e, probes)


# Rules


def _sql_any(*phrases: str) -> str:
    return "(" + " or ".join("contains(t, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


_RULE_TEXT = r"trim(regexp_replace(translate(lower(coalesce({0}, '')), '‘’', ''''''), '\s+', ' ', 'g'), ' ')"
# Written out from the statement of each clause, not from the tables of the operator.
_NOT_IN, _IN = _sql_any("not included", "excluded"), _sql_any("included", "will count", "counts")
_FLAGS_SQL = {
    "requires_take_office": _sql_any("sworn in", "takes office", "take office", "inauguration date", "assume office"),
    "official_declaration_required": _sql_any("officially declared", "official declaration", "declared elected", "declared the winner"),
    "certification_required": _sql_any("official certification", "certified outcome", "certified result"),
    "final_court_outcome": _sql_any("highest court", "final court", "court with jurisdiction", "legal challenges have", "challenges have been resolved"),
    "fallback_other": r"regexp_matches(t, 'resolve(s|d)?\s+(to\s+)?[''\"]?other')",
    "fallback_market_price": "contains(t, 'market price') and contains(t, 'resolve')",
    "postponement_stays_open": "contains(t, 'postpon') and " + _sql_any("remain open", "stays open", "remains open"),
    "special_elections_excluded": _sql_any("special elections are not included", "special elections to fill a vacancy") + f" and {_NOT_IN}",
    "special_elections_included": "contains(t, 'special election') and contains(t, 'included') and not contains(t, 'not included')",
    "by_elections_excluded": _sql_any("by-election", "by election") + f" and {_NOT_IN}",
    "by_elections_included": _sql_any("by-election", "by election") + f" and contains(t, 'included') and not {_NOT_IN}",
    "runoff_excluded": _sql_any("runoff", "second round") + f" and {_NOT_IN}",
    "runoff_included": _sql_any("runoff", "second round") + " and " + _sql_any("included", "will determine", "includes any potential second round") + f" and not {_NOT_IN}",
    "independent_caucus_counts": "contains(t, 'independent') and contains(t, 'caucus')",
    "party_at_election_controls": _sql_any("party under which the member was elected", "party under whose banner", "affiliation at the time of the election"),
    "party_at_resolution_controls": _sql_any("party affiliation at resolution", "affiliation when the market resolves"),
    "death_after_win_counts": _sql_any("die", "death", "incapacitated") + " and " + _sql_any("will resolve for that candidate", "still count", "counts"),
    "death_after_win_excluded": _sql_any("die", "death", "incapacitated") + " and " + _sql_any("will not count", "does not count", "excluded") + " and not " + _sql_any("will resolve for that candidate", "still count", "counts"),
    "vacancy_after_election_counts_original_party": "contains(t, 'vacates their seat') and " + _sql_any("attributed to the party under which", "original party"),
    "overtime_included": _sql_any("overtime", "extra time") + f" and {_IN} and not {_NOT_IN}",
    "overtime_excluded": _sql_any("overtime", "extra time") + " and " + _sql_any("not included", "excluded", "regulation only"),
    "shootout_included": f"contains(t, 'shootout') and {_IN} and not {_NOT_IN}",
    "shootout_excluded": f"contains(t, 'shootout') and {_NOT_IN}",
    "cancelled_event_stays_open": _sql_any("cancelled", "canceled", "abandoned") + " and " + _sql_any("remain open", "stays open", "rescheduled", "postponed"),
    "cancelled_event_voids": _sql_any("cancelled", "canceled", "abandoned") + " and " + _sql_any("void", "cancel the market", "market will be cancelled"),
    "cancelled_event_half_payout": _sql_any("cancelled", "canceled", "abandoned") + " and " + _sql_any("50-50", "50/50", "0.5", "half payout", "half-payout"),
    "stat_corrections_included": _sql_any("stat correction", "official correction", "data correction") + " and " + _sql_any("included", "will count") + " and not " + _sql_any("not included", "ignored"),
    "stat_corrections_excluded": _sql_any("stat correction", "official correction", "data correction") + " and " + _sql_any("not included", "ignored", "will not count"),
}
_FLAG_LIST = "list_sort(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in _FLAGS_SQL.items()) + "], lambda x: x is not null))"
_BASIS_SQL = "case when " + " when ".join([
    _sql_any("sworn in", "takes office", "take office", "taking office", "inauguration date", "assume office") + " then 'office_assumption'",
    _sql_any("certified outcome", "official certification", "certified result") + " then 'certified_result'",
    _sql_any("officially declared winner", "declared elected", "declared the winner") + " then 'declared_result'",
    _sql_any("result of the election", "results of this election", "wins the election", "winner of the election", "number of seats", "seats won", "seat count", "election winner") + r" or regexp_matches(t, '\bnumber of ([a-z0-9.-]+\s+){0,5}seats\b') or (contains(t, 'election') and contains(' ' || t || ' ', ' seats ') and " + _sql_any("resolves to", "resolve based on", "determined by") + ") then 'event_result'",
    _sql_any("official data", "reported value", "published value", "closing price", "settlement value") + " then 'objective_measurement'",
]) + " end"
_FAMILY_LIST = "list_sort(list_filter([" + ", ".join([
    "case when contains(t, 'inec') or contains(t, 'independent national electoral commission') then 'nigeria_inec' end",
    "case when " + _sql_any("federal election commission", "fec.gov", "united states congress", "congress.gov", "state electoral", "state election", "secretary of state", "election authorities", "state authorities", "official state", "official election results") + " then 'us_election_official' end",
    "case when " + _sql_any("associated press", " ap ", "reuters", "credible reporting") + " then 'credible_reporting' end",
    "case when " + _sql_any("official league", "official match report", "official tournament") + " then 'official_sport_body' end",
    "case when " + _sql_any("national weather service", "noaa") + " then 'us_weather_official' end", "case when contains(t, 'cf benchmarks') then 'cf_benchmarks' end", "case when contains(t, 'google trends') then 'google_trends' end",
    *[f"case when contains(t, '{n}') then '{n}' end" for n in ("chainlink", "pyth", "coinbase", "binance", "kraken", "coingecko", "billboard", "spotify")],
]) + "], lambda x: x is not null))"
#: Texts that hold rules: those of both venues, and documents of the type rules.
_TEXTS = "d as (select doc_id, " + _RULE_TEXT.format("text") + " as t from documents where text is not null)"


def _rule_texts(t: Source):
    return t("documents").where("text is not null").select("doc_id", text.rule_text(F.col("text")).alias("t"))


@query("f2_basis", f"with {_TEXTS} select doc_id, {_BASIS_SQL} as basis from d")
def f2(t):
    return _rule_texts(t).select("doc_id", rules.basis_of(F.col("t")).alias("basis"))


@query("f3_material_flags", f"with {_TEXTS} select doc_id, {_FLAG_LIST} as flags from d")
def f3(t):
    return _rule_texts(t).select("doc_id", rules.flags_of(F.col("t")).alias("flags"))


@query("f4_source_families", f"with {_TEXTS} select doc_id, {_FAMILY_LIST} as families from d")
def f4(t):
    return _rule_texts(t).select("doc_id", rules.sources_of(F.col("t")).alias("families"))


_DATE_SQL = "list_max(list_filter(list_transform(regexp_extract_all({0}, '(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{{1,2}}, 20[0-9]{{2}}'), lambda d: try_strptime(d, '%B %-d, %Y')::date), lambda d: d is not null))"


def _profile_sql(column: str, name: str) -> str:
    return f"{name} as (select rule_id, {_BASIS_SQL} as basis, {_FLAG_LIST} as flags, {_FAMILY_LIST} as sources, dl, t <> '' as present from (select distinct rule_id, {_RULE_TEXT.format(column)} as t, {_DATE_SQL.format(column)} as dl from raw_settlement_rules))"


_BOTH = f"{_profile_sql('kalshi_rules_primary', 'ka')}, {_profile_sql('polymarket_rules', 'po')}"
_COVERED = "case when {0}.present then ((({0}.basis is not null)::int + (len({0}.flags) > 0)::int + (len({0}.sources) > 0)::int + ({0}.dl is not null)::int) / 4.0) else 0.0 end"
_CONFLICT = "coalesce(" + ", ".join(
    [f"case when list_contains(a.flags, '{f}') <> list_contains(b.flags, '{f}') then '{f}' end" for f in ("requires_take_office", "fallback_other", "fallback_market_price")]
    + [f"case when (list_contains(a.flags, '{x}') and list_contains(b.flags, '{y}')) or (list_contains(a.flags, '{y}') and list_contains(b.flags, '{x}')) then '{x} vs {y}' end" for x, y in (
        ("special_elections_included", "special_elections_excluded"), ("by_elections_included", "by_elections_excluded"), ("runoff_included", "runoff_excluded"), ("party_at_election_controls", "party_at_resolution_controls"),
        ("death_after_win_counts", "death_after_win_excluded"), ("overtime_included", "overtime_excluded"), ("shootout_included", "shootout_excluded"), ("cancelled_event_stays_open", "cancelled_event_voids"), ("stat_corrections_included", "stat_corrections_excluded"))]
) + ")"


def _profiles(t: Source):
    rows = t("raw_settlement_rules").select("rule_id", "kalshi_rules_primary", "polymarket_rules").dropDuplicates(["rule_id"])
    return rules.with_profile(rules.with_profile(rows, "kalshi_rules_primary", "a"), "polymarket_rules", "b")


@query("f1_rule_profiles", f"with {_BOTH} select a.rule_id, a.basis, a.flags, a.sources, a.present, ({_COVERED.format('a')})::double as coverage, epoch(a.dl)::bigint + 86399 as deadline from ka a")
def f1(t):
    return _profiles(t).select("rule_id", *[c.alias(name) for name, c in rules.profile_columns("a").items()])


@query("f5_flag_conflicts", f"with {_BOTH} select a.rule_id, {_CONFLICT} as conflict from ka a join po b using (rule_id)")
def f5(t):
    return _profiles(t).select("rule_id", rules.flag_conflict(F.col("a_flags"), F.col("b_flags")).alias("conflict"))


_REASON = f"""coalesce(case when s and not (a.present and b.present) then 'rules missing' end, case when s and least({_COVERED.format('a')}, {_COVERED.format('b')}) < 0.5 then 'coverage' end,
    case when a.basis <> b.basis then 'basis differs' end, case when s and (a.basis is null) <> (b.basis is null) then 'basis missing' end, {_CONFLICT},
    case when s and a.flags <> b.flags then 'clause on one side' end, case when len(a.sources) > 0 and len(b.sources) > 0 and not list_has_any(a.sources, b.sources) then 'sources differ' end,
    case when s and (a.dl is null) <> (b.dl is null) and list_has_any(case when a.dl is not null then a.flags else b.flags end, ['fallback_other', 'fallback_market_price']) then 'deadline on one side' end)"""


@query("f9_profile_verdicts", f"""
    with {_BOTH}, m as (select a.rule_id, unnest([true, false]) as s from ka a), c as (select m.rule_id, s, {_REASON} as reason, a.basis is not distinct from b.basis and a.flags = b.flags and a.sources = b.sources and a.present and b.present as exact
        from m join ka a on a.rule_id = m.rule_id join po b on b.rule_id = m.rule_id)
    select rule_id, s as sensitive, case when reason is not null then 'REVIEW' when exact then 'EXACT' else 'COMPATIBLE' end as verdict, reason from c""")  # fmt: skip
def f9(t):
    rows = _profiles(t).withColumn("sensitive", F.explode(F.array(F.lit(True), F.lit(False))))
    return rows.select("rule_id", "sensitive", rules.compare(rules.profile_columns("a"), rules.profile_columns("b"), F.col("sensitive")).alias("x")).select("rule_id", "sensitive", "x.verdict", "x.reason")


@query("f7_rule_sensitive", """
    select sig_id, coalesce(domain, '') = 'politics' or (coalesce(proposition in ('winner', 'primary_winner', 'exact_count', 'range', 'above_threshold', 'below_threshold'), false) and coalesce(office_scope, '') <> '') as sensitive from kalshi_signature""")
def f7(t):
    return t("kalshi_signature").select("sig_id", rules.rule_sensitive(F.col("domain"), F.col("proposition"), F.col("office_scope")).alias("sensitive"))


@query("f10_qualifier_conflicts", f"""
    with p as ({_SUBJECT_PAIRS}), q as (select l, r, coalesce(a.danger_flags, []) as x, coalesce(b.danger_flags, []) as y from p),
    c as (select l, r, x, y, unnest([['first_round', 'second_round'], ['regular_season', 'playoffs'], ['regular_season', 'finals'], ['popular_vote', 'electoral_college'], ['interim_included', 'interim_excluded'], ['overtime_included', 'overtime_excluded']]) as o from q)
    select l, r, bool_or((list_contains(x, o[1]) and list_contains(y, o[2])) or (list_contains(x, o[2]) and list_contains(y, o[1]))) as conflict from c group by l, r""")  # fmt: skip
def f10(t):
    flags = lambda s: F.coalesce(F.col(f"{s}.danger_flags"), F.array().cast("array<string>"))
    return _subject_pairs(t).select("l", "r", rules.qualifier_conflict(flags("a"), flags("b")).alias("conflict"))


_STRUCTURE = ["office_scope", "season_year", "stage", "threshold_low", "threshold_high", "threshold_op"]


@query("f11_contradictions", f"with p as ({_SUBJECT_PAIRS}) select l, r, list_filter([" + ", ".join(f"case when a.{c} is not null and b.{c} is not null and a.{c}::varchar <> '' and b.{c}::varchar <> '' and a.{c} <> b.{c} then '{c}' end" for c in _STRUCTURE) + "], lambda x: x is not null) as apart from p")
def f11(t):
    return _subject_pairs(t).select("l", "r", rules.contradictions("a", "b", _STRUCTURE).alias("apart"))


@query("f12_hydration_states", f"""
    with {_BOTH}, c as (select a.rule_id, a.present and b.present as both_texts, {_REASON.replace("case when s and", "case when true and")} as reason, {_COVERED.format('a')} as ca, {_COVERED.format('b')} as cb, a.basis is not distinct from b.basis and a.flags = b.flags and a.sources = b.sources and a.present and b.present as exact from ka a join po b using (rule_id))
    select rule_id, case when not both_texts or reason is not null then 'UNRESOLVED' else 'SAFE' end as state, (reason is not null or not exact) and (not both_texts or least(ca, cb) < 0.5) as needed from c""")  # fmt: skip
def f12(t):
    a, b = rules.profile_columns("a"), rules.profile_columns("b")
    rows = _profiles(t).withColumn("v", rules.compare(a, b, F.lit(True))["verdict"])
    state = rules.hydration_state(F.array().cast("array<string>"), F.col("kalshi_rules_primary"), F.col("polymarket_rules"), F.col("v"))
    return rows.select("rule_id", state.alias("state"), rules.needs_hydration(F.col("v"), a, b).alias("needed"))


@query("f13_late_states", f"""
    with p as ({_SUBJECT_PAIRS}), q as (select l, r, list_filter([""" + ", ".join(f"case when a.{c} is not null and b.{c} is not null and a.{c}::varchar <> '' and b.{c}::varchar <> '' and a.{c} <> b.{c} then '{c}' end" for c in _STRUCTURE) + """], lambda x: x is not null) as apart, a.resolution_source as x, b.resolution_source as y from p)
    select l, r, case when len(apart) > 0 then 'CONTRADICTION' when coalesce(length(trim(x)), 0) * coalesce(length(trim(y)), 0) = 0 then 'UNRESOLVED' else 'SAFE' end as state from q""")  # fmt: skip
def f13(t):
    apart = rules.contradictions("a", "b", _STRUCTURE)
    return _subject_pairs(t).select("l", "r", rules.hydration_state(apart, F.col("a.resolution_source"), F.col("b.resolution_source"), F.lit("EXACT")).alias("state"))



@query("b3_audit_summary", """
    with m as (select distinct audit_id, verdict, reasons from match_audit), r as (select x as name, count(*) as n from (select unnest(reasons) as x from m) group by 1 order by n desc, name limit 5)
    select 'verdict' as section, verdict as name, count(*) as n from m group by verdict union all select 'reason', name, n from r""")  # fmt: skip
def b3(t):
    once = t("match_audit").select("audit_id", "verdict", "reasons").dropDuplicates(["audit_id"])
    return readers.summary_sections(once, "verdict", "reasons", 5)


# Contracts in full


_NORM = r"' ' || trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9%$.\-\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ') || ' '"
_DOCS = "d as (select doc_id, text, source, " + _NORM.format("text") + r" as t from documents where text is not null and regexp_matches(text, '^[\x00-\x7F]*$') and length(text) < 100000)"


def _ascii_docs(t: Source):
    return t("documents").where(F.col("text").isNotNull() & F.col("text").rlike(r"^[\x00-\x7F]*$") & (F.length("text") < 100000))


@query("d2_domains", f"""
    with {_DOCS} select doc_id, case when contains(source, 'sport') then 'sports' when regexp_matches(t, '\\b(vs|championship|league|tournament|super bowl|ufc|nba|nfl|nhl|mlb|world cup|ballon d or|grand slam|touchdown|yards|chess olympiad)\\b') then 'sports'
        when regexp_matches(t, '\\b(president|election|nominee|congress|senate|governor|prime minister)\\b') then 'politics' when regexp_matches(t, '\\b(inflation|gdp|unemployment|interest rate|fed|cpi|jobs report)\\b') then 'economics'
        when regexp_matches(t, '\\b(bitcoin|ethereum|crypto|solana)\\b') then 'crypto' when regexp_matches(t, '\\b(movie|oscar|grammy|emmy|box office|album|actor|actress|spotify|google search)\\b') then 'entertainment' else 'other' end as domain from d""")  # fmt: skip
def d2(t):
    return _ascii_docs(t).select("doc_id", contracts.domain([F.col("source")], contracts.normal(F.col("text"))).alias("domain"))


@query("d3_propositions", r"""
    with n as (select sig_id, """ + _NORM.format("polymarket_question") + r""" as t from poly_signature where regexp_matches(polymarket_question, '^[\x00-\x7F]*$'))
    select sig_id, case when regexp_matches(t, '\b(compete|participate|appear|enter|play in|make the field|make the ballot|run for|running for)\b') then 'participation'
        when contains(t, 'primary') and regexp_matches(t, '\b(win|winner|nominee)\b') then 'primary_winner' when contains(t, 'top half') then 'top_half' when regexp_matches(t, '\btop [0-9]+\b') or regexp_matches(t, '\b(finish|rank|be) [0-9]+\b') then 'rank_threshold'
        when regexp_matches(t, '\b(leader|lead the|most rushing|most receiving|most passing|most goals|most points|most searched)\b') then 'leader' when regexp_matches(t, '\bexactly [0-9]') then 'exact_count' when regexp_matches(t, '\bbetween \$?[0-9]') then 'range'
        when regexp_matches(t, ' (at least|more than|greater than|above|over) ') then 'above_threshold' when regexp_matches(t, ' (at most|less than|fewer than|below|under) ') then 'below_threshold' when contains(t, 'relegat') then 'relegation' when contains(t, 'qualif') then 'qualify'
        when contains(t, 'make the playoffs') or contains(t, 'reach the playoffs') then 'make_playoffs' when regexp_matches(t, '\b(nominee|nomination|win|winner|wins|champion|championship|most seats)\b') then 'winner' when regexp_matches(t, '^ (will|is|does) ') then 'binary_event' end as kind from n""")  # fmt: skip
def d3(t):
    rows = t("poly_signature").where(F.col("polymarket_question").rlike(r"^[\x00-\x7F]*$"))
    return rows.select("sig_id", contracts.proposition(contracts.normal(F.col("polymarket_question"))).alias("kind"))


@query("d4_metrics", f"""
    with {_DOCS} select doc_id, case when regexp_matches(t, '\\bhome runs?\\b') then 'home_runs' when regexp_matches(t, '\\bgoals?\\b') then 'goals' when regexp_matches(t, '\\bassists?\\b') then 'assists' when regexp_matches(t, '\\bpoints?\\b') then 'points'
        when regexp_matches(t, '\\bseats?\\b') then 'seats' when regexp_matches(t, '\\bvotes?\\b') then 'votes' when regexp_matches(t, '\\bsearch(ed|es)?\\b') then 'search_rank' when regexp_matches(t, '\\bmarket cap(italization)?\\b') then 'market_cap' when regexp_matches(t, '\\b(inflation|cpi)\\b') then 'inflation'
        when regexp_matches(t, '\\bunemployment\\b') then 'unemployment' when regexp_matches(t, '\\bgdp\\b') then 'gdp' when regexp_matches(t, '\\bfed(eral reserve)? (rate|funds)|\\binterest rate\\b') then 'interest_rate' when regexp_matches(t, '\\btemperature\\b|\\bdegrees?\\b') then 'temperature' end as metric,
        case when regexp_matches(t, '\\bpremier league\\b|\\bepl\\b') then 'premier_league' when regexp_matches(t, '\\bworld cup\\b') then 'fifa_world_cup' when regexp_matches(t, '\\bus open\\b') then 'us_open' end as competition from d
        where not regexp_matches(t, '\\b(rushing|receiving|passing|receptions?|sacks?|interceptions?)\\b')""")  # fmt: skip
def d4(t):
    rows = _ascii_docs(t).where(~F.lower("text").rlike(r"\b(rushing|receiving|passing|receptions?|sacks?|interceptions?)\b"))
    return rows.select("doc_id", contracts.normal(F.col("text")).alias("t")).select("doc_id", contracts.metric(F.col("t")).alias("metric"), contracts.competition(F.col("t")).alias("competition"))


@query("d7_places", f"""
    with {_DOCS}, o as (select doc_id, t, case when regexp_matches(t, '\\bhouse( of representatives)?\\b') then 'us_house' when regexp_matches(t, '\\bsenate\\b') then 'us_senate' when regexp_matches(t, '\\bgovernor|gubernatorial\\b') then 'governor'
        when regexp_matches(t, '\\bpresident|presidential\\b') then 'president' when regexp_matches(t, '\\bprime minister\\b') then 'prime_minister' when regexp_matches(t, '\\bmayor|mayoral\\b') then 'mayor' end as office from d),
    u as (select *, coalesce(office in ('us_house', 'us_senate'), false) or regexp_matches(t, '\\b(u s|us|united states|midterm|congress)\\b') as us from o)
    select doc_id, office, case when us then 'US' when regexp_matches(t, '\\bunited kingdom\\b') then 'GB' when regexp_matches(t, '\\bargentina\\b') then 'AR' when regexp_matches(t, '\\baustralia\\b') then 'AU' when regexp_matches(t, '\\bgermany\\b') then 'DE' when regexp_matches(t, '\\bireland\\b') then 'IE'
        when regexp_matches(t, '\\bbrazil\\b') then 'BR' when regexp_matches(t, '\\bcanada\\b') then 'CA' when regexp_matches(t, '\\bfrance\\b') then 'FR' when regexp_matches(t, '\\bmexico\\b') then 'MX' when regexp_matches(t, '\\bchina\\b') then 'CN' when regexp_matches(t, '\\bindia\\b') then 'IN'
        when regexp_matches(t, '\\bitaly\\b') then 'IT' when regexp_matches(t, '\\bjapan\\b') then 'JP' when regexp_matches(t, '\\bspain\\b') then 'ES' when regexp_matches(t, '\\busa\\b') then 'US' when regexp_matches(t, '\\buk\\b') then 'GB' end as country from u""")  # fmt: skip
def d7(t):
    rows = _ascii_docs(t).select("doc_id", contracts.normal(F.col("text")).alias("t"))
    held = rows.withColumn("office", contracts.office(F.col("t")))
    return held.select("doc_id", "office", contracts.jurisdiction(F.col("t"), F.col("office"))["country"].alias("country"))


@query("d13_legacy_join", """
    with l as (select sig_id, lower(subject) as s, regexp_extract(kalshi_title, '\\b(20[0-9]{2})\\b', 1) as y, metric as m from kalshi_signature where regexp_matches(subject, '^[A-Za-z]{3,} [A-Za-z]{3,}$')),
    r as (select sig_id, lower(subject) as s, regexp_extract(polymarket_question, '\\b(20[0-9]{2})\\b', 1) as y, metric as m from poly_signature where regexp_matches(subject, '^[A-Za-z]{3,} [A-Za-z]{3,}$'))
    select l.sig_id as left_id, r.sig_id as right_id from l join r on l.s = r.s and l.y = r.y and l.m is not distinct from r.m""")  # fmt: skip
def d13(t):
    def side(name: str, title: str, out: str):
        rows = t(name).where(F.col("subject").rlike("^[A-Za-z]{3,} [A-Za-z]{3,}$"))
        key = contracts.legacy_key(F.col(title), F.col("subject"))
        return rows.select(F.col("sig_id").alias(out), key["subject"].alias("who"), F.coalesce(key["year"].cast("string"), F.lit("")).alias("year"), "metric")

    left, right = side("kalshi_signature", "kalshi_title", "left_id"), side("poly_signature", "polymarket_question", "right_id")
    return linkage.null_safe_join(left, right, ["who", "year", "metric"]).select("left_id", "right_id")


@query("d16_families", """
    select sig_id, case when domain = 'politics' then case when metric in ('seats', 'votes') then concat_ws(':', 'politics_count', coalesce(office_scope, 'generic'), metric, coalesce(proposition, 'unknown')) when office_scope is not null then concat_ws(':', 'politics_office', office_scope, coalesce(proposition, 'unknown')) else concat_ws(':', 'politics_generic', coalesce(proposition, 'unknown')) end
        when domain = 'sports' then case when metric in ('goals', 'assists', 'points') then concat_ws(':', 'sports_stat', metric, coalesce(proposition, 'unknown')) when competition is not null then concat_ws(':', 'sports_comp', competition, coalesce(proposition, 'unknown')) else concat_ws(':', 'sports_event', coalesce(proposition, 'unknown')) end
        when domain in ('crypto', 'economics', 'weather') then concat_ws(':', domain, coalesce(metric, 'generic'), coalesce(proposition, 'unknown'))
        when proposition in ('range', 'exact_count') and regexp_matches(' ' || lower(kalshi_title) || ' ', '\\b(bitcoin|ethereum|solana|gold|silver|platinum|oil|brent|wti)\\b') then concat_ws(':', 'asset_threshold', proposition)
        when proposition in ('range', 'exact_count') and metric is not null then concat_ws(':', 'numeric', metric, proposition) else concat_ws(':', coalesce(domain, 'other'), coalesce(proposition, 'unknown')) end as family from kalshi_signature""")  # fmt: skip
def d16(t):
    c = F.col
    return t("kalshi_signature").select("sig_id", contracts.family(c("domain"), c("proposition"), c("metric"), c("office_scope"), c("competition"), contracts.normal(c("kalshi_title"))).alias("family"))


@query("d17_anchors", r"""
    with w as (select sig_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(kalshi_title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3 and not regexp_matches(x, '^20[0-9]{2}$')))) as x from kalshi_signature)
    select sig_id, list_filter(x, lambda y: y not in ('sports', 'sport', 'gaming', 'game', 'games', 'winner', 'wins', 'match', 'matches', 'league', 'series', 'tournament', 'playoffs', 'regular', 'season', 'group', 'stage', 'weather', 'rain', 'rainfall', 'temperature', 'degrees', 'high', 'low', 'daily',
        'election', 'elections', 'presidential', 'house', 'senate', 'seat', 'seats', 'price', 'market', 'value', 'rate', 'percent', 'percentage')) as anchors from w""")  # fmt: skip
def d17(t):
    return t("kalshi_signature").select("sig_id", contracts.anchors(F.col("kalshi_title")).alias("anchors"))


@query("d9_left_signatures", r"""
    with r as (select distinct rule_id, kalshi_title, kalshi_rules_primary, polymarket_resolution_source from raw_settlement_rules where regexp_matches(coalesce(kalshi_title, ''), '^[\x00-\x7F]*$')),
    n as (select *, """ + _RULE_TEXT.format("kalshi_rules_primary") + " as t, " + _DATE_SQL.format("kalshi_rules_primary") + r""" as dl, regexp_extract(kalshi_title, '\b(20[0-9]{2})\b', 1) as y from r)
    select rule_id, nullif(y, '') as season, t <> '' as rules_present, len(""" + _FLAG_LIST + r""") as n_flags, epoch(dl)::bigint + 86399 as deadline, case when regexp_matches(lower(kalshi_title), '\bwomen') then 'women' end as gender from n""")  # fmt: skip
def d9(t):
    c = F.col
    rows = t("raw_settlement_rules").select("rule_id", "kalshi_title", "kalshi_rules_primary", "polymarket_resolution_source", c("fetched_at").cast("timestamp").alias("fetched_at")).dropDuplicates(["rule_id"]).where(F.coalesce("kalshi_title", F.lit("")).rlike(r"^[\x00-\x7F]*$"))
    s = contracts.signatures(rows, ["rule_id"], "kalshi_title", None, [], "kalshi_rules_primary", "polymarket_resolution_source", ["fetched_at"])
    return s.select("rule_id", "season", "rules_present", F.size("flags").cast("bigint").alias("n_flags"), "deadline", "gender")


@query("d1_right_signatures")
def d1(t):
    c = F.col
    rows = t("poly_signature").withColumn("seen", c("seen_at").cast("timestamp")).withColumn("ends", F.timestamp_seconds(F.when(F.abs("end_ts") < 1e11, c("end_ts"))))
    return contracts.signatures(rows, ["sig_id"], "polymarket_question", "subject", ["domain"], "context", "resolution_source", ["seen", "ends"])


@query("g1_verified_structure", """
    with p as (select a.sig_id as left_id, b.sig_id as right_id, a.threshold_low as al, b.threshold_low as bl, a.end_ts as ae, b.end_ts as be from kalshi_signature a join poly_signature b
        on a.proposition is not distinct from b.proposition and a.season_year is not distinct from b.season_year and a.metric is not distinct from b.metric and a.stage is not distinct from b.stage and lower(a.subject) = lower(b.subject))
    select left_id, right_id from p where (al is null and bl is null or abs(al - bl) <= 1e-9) and coalesce(abs(ae - be) <= 604800, true)""")  # fmt: skip
def g1(t):
    side = lambda name, i, x: t(name).where("subject is not null").select(F.col("sig_id").alias(i), F.lower("subject").alias("who"), "proposition", "season_year", "metric", "stage", F.col("threshold_low").alias(f"{x}l"), F.col("end_ts").alias(f"{x}e"))
    pairs = linkage.null_safe_join(side("kalshi_signature", "left_id", "a"), side("poly_signature", "right_id", "b"), ["who", "proposition", "season_year", "metric", "stage"])
    bounds = F.coalesce(F.abs(F.col("al") - F.col("bl")) <= 1e-9, F.col("al").isNull() & F.col("bl").isNull())
    return pairs.where(bounds & F.coalesce(F.abs(F.col("ae") - F.col("be")) <= 604800, F.lit(True))).select("left_id", "right_id")


@query("g2_eight_keys", """
    with k as (select 'l' as side, sig_id, lower(subject) as s, season_year as y, metric as m, competition as c, stage as g, office_scope as o, threshold_low as t, proposition as p, domain as d from kalshi_signature
            union all select 'r', sig_id, lower(subject), season_year, metric, competition, stage, office_scope, threshold_low, proposition, domain from poly_signature),
    x as (select side, sig_id, y, unnest([s || '|y|' || y, s || '|m|' || m, s || '|c|' || c, s || '|g|' || g, s || '|o|' || o, s || '|p|' || p, s || '|d|' || d, m || '|t|' || cast(round(t * 1000)::bigint as varchar)]) as key from k),
    h as (select a.sig_id as left_id, b.sig_id as right_id, count(*) as hits from x a join x b on a.key = b.key and a.side = 'l' and b.side = 'r' group by 1, 2),
    v as (select h.*, a.season_year as ya, b.season_year as yb from h join kalshi_signature a on a.sig_id = left_id join poly_signature b on b.sig_id = right_id)
    select left_id, right_id, hits from v where ya is null or yb is null or ya = yb""")  # fmt: skip
def g2(t):
    bar = lambda a, tag, b: F.concat(a, F.lit(f"|{tag}|"), b)
    s = F.lower("subject")
    keys = F.array(*[bar(s, tag, F.col(c)) for tag, c in (("y", "season_year"), ("m", "metric"), ("c", "competition"), ("g", "stage"), ("o", "office_scope"), ("p", "proposition"), ("d", "domain"))], bar(F.col("metric"), "t", F.round(F.col("threshold_low") * 1000).cast("bigint").cast("string")))
    side = lambda name, i, y: t(name).select(F.col("sig_id").alias(i), F.col("season_year").alias(y), F.explode(keys).alias("key")).where("key is not null")
    met = side("kalshi_signature", "left_id", "ya").join(side("poly_signature", "right_id", "yb"), "key").where("ya is null or yb is null or ya = yb")
    return met.groupBy("left_id", "right_id").agg(F.count("*").alias("hits"))


# Lookups, payloads and the classifier


@query("a2_series_lookup", """
    with s as (select distinct signal_id, split_part(ticker, '-', 1) as series from signals where ticker is not null), d as (select split_part(ticker, '-', 1) as series, min(domain) as fee_type, count(*) as markets from kalshi_signature group by 1)
    select signal_id, s.series, fee_type, markets from s left join d using (series)""")  # fmt: skip
def a2(t):
    series = lambda c: F.split_part(c, F.lit("-"), F.lit(1))
    dimension = t("kalshi_signature").groupBy(series(F.col("ticker")).alias("series")).agg(F.min("domain").alias("fee_type"), F.count("*").alias("markets"))
    rows = t("signals").where("ticker is not null").select("signal_id", series(F.col("ticker")).alias("series")).dropDuplicates(["signal_id"])
    return linkage.validated_merge(rows, dimension, "series").select("signal_id", "series", "fee_type", "markets")


@query("a5_parsed_books", f"""
    with {_LEVELS} select book, count(*) as levels, min(price) as best_ask, min_by(size, (price, size)) as best_size from l where side = 'yes' and price > 0 and price < 1 and size > 0 group by book""")
def a5(t):
    pair = F.concat(F.lit('["'), F.col("price").cast("string"), F.lit('", '), F.col("size").cast("string"), F.lit("]"))
    payload = _levels(t).where("side = 'yes'").groupBy("book").agg(F.concat(F.lit("["), F.array_join(F.collect_list(pair), ", "), F.lit(', ["x", "1"]]')).alias("text"))
    held = payload.select("book", books.ladder(books.parsed_levels(F.col("text"))).alias("x")).where("size(x) > 0")
    first = F.element_at("x", F.lit(1))
    return held.select("book", F.size("x").cast("bigint").alias("levels"), first["price"].alias("best_ask"), first["size"].alias("best_size"))


@query("a18_token_order", """
    with m as (select vec_id, case when vec_id % 3 = 0 then ['No', 'Yes'] when vec_id % 3 = 1 then ['Yes', 'No'] else ['A', 'B', 'C'] end as outcomes, ['t1', 't2'] as tokens from semantic_poly)
    select vec_id, case when outcomes = ['No', 'Yes'] then ['t2', 't1'] else tokens end as ids from m""")  # fmt: skip
def a18(t):
    outcomes = F.when(F.col("vec_id") % 3 == 0, '["No","Yes"]').when(F.col("vec_id") % 3 == 1, '["Yes","No"]').otherwise('["A","B","C"]')
    rows = t("semantic_poly").select("vec_id", outcomes.alias("outcomes"), F.lit('["t1","t2"]').alias("tokens"))
    return rows.select("vec_id", readers.ordered_tokens("tokens", "outcomes").alias("ids"))


@query("a20_best_sides", f"""
    with {_LEVELS}, u as (select * from l where price > 0 and size > 0)
    select book, min(price) filter (side = 'no') as best_ask, min_by(size, (price, size)) filter (side = 'no') as ask_size, max(price) filter (side = 'yes') as best_bid from u group by book""")  # fmt: skip
def a20(t):
    level = F.struct("price", "size")
    nested = _levels(t).groupBy("book").agg(F.collect_list(F.when(F.col("side") == "no", level)).alias("asks"), F.collect_list(F.when(F.col("side") == "yes", level)).alias("bids"))
    held = nested.select("book", readers.tidy_quotes("asks", "ask").alias("a"), readers.tidy_quotes("bids", "bid").alias("b"))
    return held.select("book", F.col("a.price").alias("best_ask"), F.col("a.size").alias("ask_size"), F.col("b.price").alias("best_bid"))


@query("a14_open_rows", """
    select distinct rule_id from raw_settlement_rules where not coalesce(not kalshi_fetch_ok and not polymarket_fetch_ok, false) and coalesce(polymarket_fetch_ok, true) and coalesce(trim(poly_id, ' '), '') <> '' and coalesce(trim(poly_question, ' '), '') <> ''""")
def a14(t):
    rows = t("raw_settlement_rules").withColumn("closed", ~F.col("kalshi_fetch_ok") & ~F.col("polymarket_fetch_ok"))
    return feeds.usable(rows, "closed", "polymarket_fetch_ok", "poly_id", "poly_question").select("rule_id").distinct()


@query("h6_pair_probabilities")
def h6(t):
    c = t("hybrid_candidate").select("cand_id", "embedding_score", "deterministic_strength", F.size("retrieval_sources").alias("n_sources"), (F.col("equivalence_probability") >= 0.5).alias("same")).dropDuplicates(["cand_id"])
    scored = scoring.decided(scoring.pair_probabilities(c, "cand_id", ["embedding_score", "deterministic_strength", "n_sources"], "same"), 0.5)
    return scored.select("cand_id", F.round("probability", 4).alias("probability"), "decision")


@query("e6_entity_verdicts")
def e6(t):
    # Names are brought into their form once a record. Every pair that is one entity is given, however its names begin; a pair that is not where they begin alike.
    keys = ["season_year", "metric"]
    side = lambda name, i, c: materialise(t(name).where("season_year is not null and metric is not null").select(F.col("sig_id").alias(i), *keys, F.substring(F.lower("subject"), 1, 2).alias(f"{i}_start"), F.col("subject").isNull().alias(f"{i}_none"), entities.canonical_entity(F.col("subject")).alias(c)))
    left, right = side("kalshi_signature", "left_id", "x"), side("poly_signature", "right_id", "z")
    named, others = left.where("not left_id_none"), right.where("not right_id_none")
    same = materialise(linkage.same_entities(named, others, keys, "x", "z")).withColumn("same", F.lit(True))
    alike = named.withColumn("start", F.col("left_id_start")).join(others.withColumn("start", F.col("right_id_start")), [*keys, "start"])
    told = alike.join(same, [*keys, "x", "z"], "left").select("left_id", "right_id", F.when((F.col("x") != "") & (F.col("z") != ""), F.coalesce("same", F.lit(False))).alias("same"))
    unlike = named.join(same, [*keys, "x"]).join(others, [*keys, "z"]).where("left_id_start != right_id_start").select("left_id", "right_id", "same")
    ids = lambda d: d.select("left_id", "right_id", F.lit(None).cast("boolean").alias("same"))
    # A missing name has no verdict with any other.
    lone = ids(left.where("left_id_none").join(right, keys))
    rest = ids(named.join(right.where("right_id_none"), keys))
    return told.unionByName(unlike).unionByName(lone).unionByName(rest)


@query("q1_reason_maps", """
    with m as (select distinct audit_id, verdict, reasons from match_audit), x as (select verdict, unnest(reasons) as r from m), c as (select verdict, r, count(*) as n from x group by 1, 2), k as (select * from c where n > 1)
    select verdict, list(r order by r) as names, list(n * 2 order by r) as doubled, max(n) as most from k group by verdict""")  # fmt: skip
def q1(t):
    once = t("match_audit").select("audit_id", "verdict", "reasons").dropDuplicates(["audit_id"])
    counts = once.select("verdict", F.explode("reasons").alias("r")).groupBy("verdict", "r").agg(F.count("*").alias("n"))
    held = counts.groupBy("verdict").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "n")))).alias("m"))
    kept = held.select("verdict", F.map_filter("m", lambda _, n: n > 1).alias("m")).where(F.size("m") > 0)
    return kept.select("verdict", F.map_keys("m").alias("names"), F.map_values(F.transform_values("m", lambda _, n: n * 2)).alias("doubled"), F.array_max(F.map_values("m")).alias("most"))


@query("a21_tolerant_payloads", """
    select vec_id, case when vec_id % 4 = 3 then 0 else 2 end as n_rows, case when vec_id % 4 <> 3 then poly_id end as first_id from semantic_poly""")
def a21(t):
    rows = F.concat(F.lit('[{"id": "'), F.col("poly_id"), F.lit('"}, {"id": "x"}]'))
    payload = F.when(F.col("vec_id") % 4 == 0, rows).when(F.col("vec_id") % 4 == 1, F.concat(F.lit('{"markets": '), rows, F.lit("}"))).when(F.col("vec_id") % 4 == 2, F.concat(F.lit('{"data": {"items": '), rows, F.lit("}}"))).otherwise('{"error": "none"}')
    found = feeds.payload_rows(payload, "struct<id:string>")
    return t("semantic_poly").select("vec_id", found.alias("r")).select("vec_id", F.size("r").cast("int").alias("n_rows"), F.get("r", F.lit(0))["id"].alias("first_id"))
