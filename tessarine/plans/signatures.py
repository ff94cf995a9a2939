"""Queries over contract titles, rule texts, candidates and run tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessarine.functions import text
from tessarine.operators import ledger, linkage
from tessarine.operators import signatures as sig
from tessarine.plans.relational import _ONCE, ORACLE_SQL, QUERIES, _signals, query  # noqa: F401


def _case(column: str, patterns: dict[str, str]) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({column}), '{p}') then '{name}'" for name, p in patterns.items()) + " end"


def _flags(column: str) -> str:
    return "list_sort(list_filter([" + ", ".join(f"case when regexp_matches(lower({column}), '{p}') then '{n}' end" for n, p in sig.RULE_FLAGS.items()) + "], lambda x: x is not null))"


@query("d3_proposition", f"select sig_id, {_case('kalshi_title', sig.PROPOSITIONS)} as kind, {_case('kalshi_title', sig.OPERATORS)} as op from kalshi_signature")
def d3(t):
    return t("kalshi_signature").select("sig_id", sig.first_of(F.col("kalshi_title"), sig.PROPOSITIONS).alias("kind"), sig.first_of(F.col("kalshi_title"), sig.OPERATORS).alias("op"))


@query("d4_scopes", f"""
    select sig_id, {_case("polymarket_question", sig.STAGES)} as stage_found, {_case("polymarket_question", sig.OFFICES)} as office_found,
        case when regexp_matches(lower(polymarket_question), 'women') then 'women' end as gender_found, nullif(regexp_extract(polymarket_question, '(20[0-9][0-9])', 1), '') as year_found from poly_signature""")  # fmt: skip
def d4(t):
    q = F.col("polymarket_question")
    return t("poly_signature").select(
        "sig_id", sig.first_of(q, sig.STAGES).alias("stage_found"), sig.first_of(q, sig.OFFICES).alias("office_found"),
        F.when(F.lower(q).rlike("women"), "women").alias("gender_found"), F.nullif(F.regexp_extract(q, "(20[0-9][0-9])", 1), F.lit("")).alias("year_found"),
    )


@query("d5_subject", r"""
    with x as (select sig_id, trim(subject, ' ') as said, trim(regexp_extract(polymarket_question, '(?i)^\s*will\s+(.+?)\s+(?:win|make|be|become|play|take|lift)\b', 1), ' ') as asked from poly_signature)
    select sig_id, case when said <> '' then said when asked <> '' then asked end as who from x""")  # fmt: skip
def d5(t):
    return t("poly_signature").select("sig_id", sig.subject(F.col("polymarket_question"), F.col("subject")).alias("who"))


_ATTRIBUTES = ["domain", "proposition", "subject", "season_year", "end_ts", "resolution_source"]


@query("d12_completeness", "select sig_id, round((" + " + ".join(f"(case when {c} is not null and trim(cast({c} as varchar), ' ') <> '' then 1.0 else 0.0 end)" for c in _ATTRIBUTES) + ") / 6, 6) as share from kalshi_signature")
def d12(t):
    return t("kalshi_signature").select("sig_id", F.round(sig.completeness(*[F.col(c) for c in _ATTRIBUTES]), 6).alias("share"))


@query("f3_rule_flags", f"select distinct rule_id, {_flags('polymarket_rules')} as flags from raw_settlement_rules where polymarket_rules is not null")
def f3(t):
    return t("raw_settlement_rules").where("polymarket_rules is not null").select("rule_id", sig.all_of(F.col("polymarket_rules"), sig.RULE_FLAGS).alias("flags")).distinct()


@query("f4_source_family", f"select {_case('polymarket_resolution_source', sig.SOURCE_FAMILIES)} as family, count(distinct rule_id) as n from raw_settlement_rules group by 1")
def f4(t):
    return t("raw_settlement_rules").groupBy(sig.first_of(F.col("polymarket_resolution_source"), sig.SOURCE_FAMILIES).alias("family")).agg(F.countDistinct("rule_id").alias("n"))


@query("f6_rule_comparison", f"""
    with r as (select distinct rule_id, kalshi_rules_primary as a, polymarket_rules as b from raw_settlement_rules), p as (select *, {_flags("a")} as fa, {_flags("b")} as fb from r)
    select rule_id, case when a is null or b is null or length(trim(a, ' ')) = 0 or length(trim(b, ' ')) = 0 then 'UNRESOLVED' when lower(a) = lower(b) then 'EXACT' when fa = fb then 'COMPATIBLE' else 'REVIEW' end as verdict from p""")  # fmt: skip
def f6(t):
    a, b = F.col("kalshi_rules_primary"), F.col("polymarket_rules")
    rows = t("raw_settlement_rules").select("rule_id", a, b).distinct()
    return rows.select("rule_id", sig.compare_profiles(sig.all_of(a, sig.RULE_FLAGS), sig.all_of(b, sig.RULE_FLAGS), a, b).alias("verdict"))


_DATES = "(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, 20[0-9]{2}"


@query("c15_rule_deadline", f"""
    select doc_id, strftime(list_max(list_filter(list_transform(regexp_extract_all(text, '{_DATES}'), lambda d: try_strptime(d, '%B %-d, %Y')::date), lambda d: d is not null)), '%Y-%m-%d') as deadline from documents""")
def c15(t):
    return t("documents").select("doc_id", F.date_format(sig.last_date(F.col("text")), "yyyy-MM-dd").alias("deadline"))


@query("g2_multi_key_blocks", """
    with l as (select sig_id, lower(subject) as s, competition as c, season_year as y, metric as m, unnest([1, 2, 3]) as kind from kalshi_signature),
    r as (select sig_id, lower(subject) as s, competition as c, season_year as y, metric as m, unnest([1, 2, 3]) as kind from poly_signature),
    key as (select 'l' as side, sig_id, case kind when 1 then s || '|' || y when 2 then s || '|' || m when 3 then s || '|' || c end as k from l
            union all select 'r', sig_id, case kind when 1 then s || '|' || y when 2 then s || '|' || m when 3 then s || '|' || c end from r)
    select a.sig_id as left_id, b.sig_id as right_id, count(*) as key_hits from key a join key b on a.k = b.k and a.side = 'l' and b.side = 'r' group by 1, 2""")  # fmt: skip
def g2(t):
    s = F.lower("subject")
    keys = F.array(F.concat(s, F.lit("|"), "season_year"), F.concat(s, F.lit("|"), "metric"), F.concat(s, F.lit("|"), "competition"))
    side = lambda name, out: t(name).select(F.col("sig_id").alias(out), F.posexplode(keys).alias("kind", "k")).where("k is not null")
    left, right = side("kalshi_signature", "left_id"), side("poly_signature", "right_id")
    return left.select("left_id", "k").join(right.select("right_id", "k"), "k").groupBy("left_id", "right_id").agg(F.count("*").alias("key_hits"))


@query("g5_reserved_slots", """
    with c as (select distinct cand_id, query_vec_id, poly_idx, coalesce(deterministic_strength, 0) > 0 as strong, coalesce(embedding_score, -1) as score from hybrid_candidate),
    r as (select *, row_number() over (partition by query_vec_id, strong order by score desc, cand_id) as k from c),
    s as (select *, row_number() over (partition by query_vec_id order by (strong and k <= 2) desc, score desc, cand_id) as place from r)
    select query_vec_id, cand_id, place from s where place <= 4""")  # fmt: skip
def g5(t):
    c = t("hybrid_candidate").select("cand_id", "query_vec_id", "poly_idx", (F.coalesce("deterministic_strength", F.lit(0.0)) > 0).alias("strong"), F.coalesce("embedding_score", F.lit(-1.0)).alias("score")).distinct()
    k = F.row_number().over(Window.partitionBy("query_vec_id", "strong").orderBy(F.col("score").desc(), "cand_id"))
    kept = (F.col("strong") & (F.col("k") <= 2)).desc()
    place = F.row_number().over(Window.partitionBy("query_vec_id").orderBy(kept, F.col("score").desc(), "cand_id"))
    return c.withColumn("k", k).withColumn("place", place).where("place <= 4").select("query_vec_id", "cand_id", "place")


@query("g14_rung_in_tolerance", """
    select s.sig_id, arg_min(l.rung_id, (abs(l.low - s.threshold_low), l.rung_id)) as rung_id from kalshi_signature s join strike_ladder l on l.metric = s.metric
    where s.threshold_low is not null and abs(l.low - s.threshold_low) <= greatest(l.tolerance, 0.0000015) group by s.sig_id""")  # fmt: skip
def g14(t):
    rungs = t("strike_ladder").select("rung_id", "metric", "low", "tolerance")
    rows = t("kalshi_signature").where("threshold_low is not null").select("sig_id", "metric", "threshold_low").join(rungs, "metric")
    off = F.abs(F.col("low") - F.col("threshold_low"))
    near = rows.where(off <= F.greatest("tolerance", F.lit(0.0000015)))
    return near.groupBy("sig_id").agg(F.min_by("rung_id", F.struct(off.alias("o"), "rung_id")).alias("rung_id"))


@query("b5_changed_texts", """
    with old as (select distinct md5(coalesce(text, '')) as h from semantic_poly where vec_id % 2 = 0)
    select vec_id from semantic_poly where md5(coalesce(text, '')) not in (select h from old)""")  # fmt: skip
def b5(t):
    hashed = t("semantic_poly").select("vec_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    return hashed.join(hashed.where("vec_id % 2 = 0").select("h"), "h", "left_anti").select("vec_id")


@query("h10_bounded_audit", """
    with m as (select distinct audit_id, verdict, score from match_audit), n as (select verdict, count(*) as total from m group by verdict),
    s as (select audit_id, verdict, row_number() over (partition by verdict order by score desc nulls last, audit_id) as k from m)
    select s.audit_id, s.verdict, n.total from s join n on s.verdict is not distinct from n.verdict where k <= 25""")  # fmt: skip
def h10(t):
    rows = t("match_audit").select("audit_id", "verdict", "score").distinct()
    k = F.row_number().over(Window.partitionBy("verdict").orderBy(F.col("score").desc_nulls_last(), "audit_id"))
    counts = rows.groupBy("verdict").agg(F.count("*").alias("total"))
    return linkage.null_safe_join(rows.withColumn("k", k).where("k <= 25").select("audit_id", "verdict"), counts, ["verdict"]).select("audit_id", "verdict", "total")


@query("h11_seen_pairs", "select least(query_vec_id, poly_idx) as a, greatest(query_vec_id, poly_idx) as b, count(distinct cand_id) as n from hybrid_candidate group by 1, 2")
def h11(t):
    return t("hybrid_candidate").groupBy(F.least("query_vec_id", "poly_idx").alias("a"), F.greatest("query_vec_id", "poly_idx").alias("b")).agg(F.countDistinct("cand_id").alias("n"))


@query("j2_exit_fill", """
    with l as (select l_partkey as book, l_extendedprice / l_quantity as price, cast(l_quantity as double) as size, l_orderkey, l_linenumber from lineitem),
    b as (select *, coalesce(sum(size) over (partition by book order by price desc, l_orderkey, l_linenumber rows between unbounded preceding and 1 preceding), 0) as before from l where price > 0 and size > 0),
    q as (select unnest([10.0, 100.0])::double as quantity), f as (select book, quantity, least(size, quantity - before) as take, price from b join q on before < quantity)
    select book, quantity, sum(take) as filled, round(sum(take * price), 7) as cost, max(price) as best, count(*) as levels from f group by book, quantity""")  # fmt: skip
def j2(t):
    levels = t("lineitem").select(F.col("l_partkey").alias("book"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_quantity").cast("double").alias("size"), "l_orderkey", "l_linenumber")
    fills = ledger.depth_fill(levels, "book", "price", "size", ["l_orderkey", "l_linenumber"], [10, 100], descending=True)
    return fills.withColumnRenamed("worst", "best")


@query("j6_best_level", "select l_partkey as book, min(l_extendedprice / l_quantity) as best, sum(cast(l_quantity as double)) as total_size, count(*) as levels from lineitem where l_quantity > 0 group by 1")
def j6(t):
    rows = t("lineitem").where("l_quantity > 0").select(F.col("l_partkey").alias("book"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_quantity").cast("double").alias("size"))
    return rows.groupBy("book").agg(F.min("price").alias("best"), F.sum("size").alias("total_size"), F.count("*").alias("levels"))


@query("k4_near_miss", _ONCE + "select signal_id, strategy, round(net_per_contract, 6) + 0.0 as net_per_contract from s where not eligible and net_per_contract is not null and not isnan(net_per_contract) order by s.net_per_contract desc, signal_id limit 10")
def k4(t):
    rows = _signals(t, "signal_id", "strategy", "eligible", "net_per_contract").where("not eligible and net_per_contract is not null and not isnan(net_per_contract)")
    return rows.orderBy(F.col("net_per_contract").desc(), "signal_id").limit(10).select("signal_id", "strategy", F.round("net_per_contract", 6).alias("net_per_contract"))


@query("n3_capacity_grid", _ONCE + """
    , b as (select unnest([50.0, 100.0, 250.0, 500.0, 1000.0, 5000.0])::double as bankroll)
    select bankroll, count(*) filter (where capital <= bankroll) as fits, round(sum(case when capital <= bankroll then capital else 0 end), 2) + 0.0 as used from s, b where capital is not null and not isnan(capital) group by bankroll""")  # fmt: skip
def n3(t):
    rows = _signals(t, "signal_id", "capital").where("capital is not null and not isnan(capital)")
    grid = rows.withColumn("bankroll", F.explode(F.array(*[F.lit(float(b)) for b in (50, 100, 250, 500, 1000, 5000)])))
    fits = F.col("capital") <= F.col("bankroll")
    return grid.groupBy("bankroll").agg(F.count_if(fits).alias("fits"), F.round(F.sum(F.when(fits, F.col("capital")).otherwise(0.0)), 2).alias("used"))


@query("n6_fixed_buckets", _ONCE + """
    select duration_bucket, count(*) as n, count(*) filter (where eligible) as n_eligible, round(sum(case when capital is null or isnan(capital) then 0 else capital end), 2) + 0.0 as capital from s where duration_bucket is not null group by 1""")
def n6(t):
    rows = _signals(t, "signal_id", "duration_bucket", "eligible", "capital").where("duration_bucket is not null")
    return rows.groupBy("duration_bucket").agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"), F.round(F.sum(F.nanvl(F.coalesce("capital", F.lit(0.0)), F.lit(0.0))), 2).alias("capital"))


@query("n11_daily_series", "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, count(distinct user_id) as users, round(max(value), 4) as most from events group by 1, 2")
def n11(t):
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.max("value"), 4).alias("most"))


@query("c18_counts_in_titles", r"select sig_id, nullif(regexp_extract(lower(kalshi_title), '\b(exactly|top|round|game|map) ([0-9]+)\b', 2), '') as counted, regexp_matches(lower(kalshi_title), '\bvs?\.? ') as fixture from kalshi_signature")
def c18(t):
    low = F.lower("kalshi_title")
    return t("kalshi_signature").select("sig_id", F.nullif(F.regexp_extract(low, r"\b(exactly|top|round|game|map) ([0-9]+)\b", 2), F.lit("")).alias("counted"), low.rlike(r"\bvs?\.? ").alias("fixture"))


@query("c30_rule_collation", """
    select distinct rule_id, concat_ws(chr(10), nullif(kalshi_title, ''), nullif(kalshi_rules_primary, ''), nullif(kalshi_rules_secondary, ''), nullif(polymarket_rules, '')) as collated from raw_settlement_rules""")
def c30(t):
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("kalshi_title", "kalshi_rules_primary", "kalshi_rules_secondary", "polymarket_rules")]
    return t("raw_settlement_rules").select("rule_id", F.concat_ws("\n", *parts).alias("collated")).distinct()


@query("e8_token_compatibility", """
    with w as (select distinct audit_id, list_distinct(string_split(trim(regexp_replace(lower(kalshi_title), '[^a-z0-9]+', ' ', 'g')), ' ')) as a, list_distinct(string_split(trim(regexp_replace(lower(polymarket_question), '[^a-z0-9]+', ' ', 'g')), ' ')) as b
               from match_audit where kalshi_title is not null and polymarket_question is not null)
    select audit_id, len(list_intersect(a, b)) as shared, len(a) as n_left, len(b) as n_right from w""")  # fmt: skip
def e8(t):
    words = lambda c: F.array_distinct(F.split(text.spaced_words(F.col(c)), " "))
    rows = t("match_audit").where("kalshi_title is not null and polymarket_question is not null").select("audit_id", words("kalshi_title").alias("a"), words("polymarket_question").alias("b")).distinct()
    return rows.select("audit_id", F.size(F.array_intersect("a", "b")).alias("shared"), F.size("a").alias("n_left"), F.size("b").alias("n_right"))
