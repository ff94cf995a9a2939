"""Queries of the core operators, each beside the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.functions import similarity, text
from tessarine.operators import analytics, ledger, linkage, ranking
from tessarine.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Source = Callable[[str], DataFrame]

#: Every signal counts once, whatever the number of its deliveries.
_ONCE = "with s as (select distinct * from signals) "
_STOP = ["the", "of", "in", "to", "will", "be", "for", "at", "and"]
_STOP_SQL = ", ".join(f"'{w}'" for w in _STOP)


def query(name: str, sql: str | None = None):
    """Registers a query of a function of a table source."""

    def keep(build: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return keep


def _signals(t: Source, *columns: str) -> DataFrame:
    """Each signal once: a second delivery equals the first in every column, so its id tells it."""
    return t("signals").select("signal_id", *[c for c in columns if c != "signal_id"]).dropDuplicates(["signal_id"])


# Sources and sinks: union, deduplication, nested indexes


@query("a8_event_index", """
    with once as (select distinct * from raw_settlement_rules)
    select ticker, count(*) as n_rules, list_sort(list_distinct(list(poly_id) filter (where poly_id is not null))) as poly_ids
    from once where ticker is not null group by ticker""")  # fmt: skip
def a8(t):
    return t("raw_settlement_rules").select("rule_id", "ticker", "poly_id").dropDuplicates(["rule_id"]).where("ticker is not null").groupBy("ticker").agg(F.count("*").alias("n_rules"), F.array_sort(F.collect_set("poly_id")).alias("poly_ids"))


@query("a11_union_first_wins", """
    with u as (select o_custkey as id, 1 as feed, o_totalprice as v, o_orderkey as k from orders
               union all select c_custkey, 2, c_acctbal, c_custkey from customer)
    select id, feed, round(v, 2) as v from u qualify row_number() over (partition by id order by feed, v desc, k) = 1""")  # fmt: skip
def a11(t):
    one = t("orders").select(F.col("o_custkey").alias("id"), F.lit(1).alias("feed"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"))
    two = t("customer").select(F.col("c_custkey").alias("id"), F.lit(2).alias("feed"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("k"))
    return ranking.keep_one(one.unionByName(two), ["id"], [F.col("feed"), F.col("v").desc(), F.col("k")]).select("id", "feed", F.round("v", 2).alias("v"))


@query("a23_keep_last", """
    select kalshi_ticker, audit_id, verdict from match_audit where kalshi_ticker is not null
    qualify row_number() over (partition by kalshi_ticker order by audited_at desc nulls last, audit_id desc) = 1""")  # fmt: skip
def a23(t):
    rows = t("match_audit").where("kalshi_ticker is not null")
    return ranking.keep_one(rows, ["kalshi_ticker"], [F.col("audited_at").desc_nulls_last(), F.col("audit_id").desc()]).select("kalshi_ticker", "audit_id", "verdict")


@query("a14_usable_rows", """
    select distinct rule_id, ticker from raw_settlement_rules
    where coalesce(kalshi_fetch_ok, true) and coalesce(polymarket_fetch_ok, true) and ticker <> '' and poly_id <> '' and length(coalesce(kalshi_rules_primary, '')) > 10""")  # fmt: skip
def a14(t):
    ok = "coalesce(kalshi_fetch_ok, true) and coalesce(polymarket_fetch_ok, true) and ticker <> '' and poly_id <> '' and length(coalesce(kalshi_rules_primary, '')) > 10"
    return t("raw_settlement_rules").where(ok).select("rule_id", "ticker").distinct()


# Scalars


@query("c3_plain_words", r"""
    select sig_id, trim(regexp_replace(regexp_replace(replace(lower(strip_accents(coalesce(subject, kalshi_title, ''))), '&', ' and '), '[''"`’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) as words from kalshi_signature""")
def c3(t):
    return t("kalshi_signature").select("sig_id", text.plain_words(F.coalesce("subject", "kalshi_title")).alias("words"))


@query("c4_spaced_words", r"""
    select sig_id, trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce(subject, polymarket_question, '')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) as words from poly_signature""")
def c4(t):
    return t("poly_signature").select("sig_id", text.folded_words(F.coalesce("subject", "polymarket_question")).alias("words"))


@query("c5_rule_text", r"""
    select distinct rule_id, trim(regexp_replace(translate(lower(polymarket_rules), '‘’', ''''''), '\s+', ' ', 'g'), ' ') as rules from raw_settlement_rules""")
def c5(t):
    return t("raw_settlement_rules").select("rule_id", text.rule_text(F.col("polymarket_rules")).alias("rules")).distinct()


@query("c1_signature_text")
def c1(t):
    return t("semantic_poly").select("vec_id", text.signature_text(F.col("text")).alias("words"))


@query("c6_token_sets", rf"""
    select sig_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(kalshi_title), '[^a-z0-9]+', ' ', 'g')), ' '),
        lambda w: length(w) >= 2 and not regexp_matches(w, '^20[0-9]{{2}}$') and w not in ({_STOP_SQL})))) as toks
    from kalshi_signature""")  # fmt: skip
def c6(t):
    return t("kalshi_signature").select("sig_id", text.tokens(F.col("kalshi_title"), 2, _STOP).alias("toks"))


@query("c8_epoch_times", """
    select sig_id, cast(floor(case when abs(end_ts) > 1e11 then end_ts / 1000 else end_ts end) as bigint) as end_s,
           cast(floor((case when abs(end_ts) > 1e11 then end_ts / 1000 else end_ts end) / 86400) as bigint) as end_day
    from poly_signature""")  # fmt: skip
def c8(t):
    seconds = F.when(F.abs("end_ts") > 1e11, F.col("end_ts") / 1000).otherwise(F.col("end_ts"))
    return t("poly_signature").select("sig_id", F.floor(seconds).alias("end_s"), F.floor(seconds / 86400).alias("end_day"))


@query("c12_season_key", r"""
    with t as (select sig_id, case when sig_id % 3 = 0 then season_year || case when sig_id % 2 = 0 then ' - 20' else '-' end || (right(season_year, 2)::int + 1)::varchar else polymarket_question end as x from poly_signature),
    n as (select sig_id, regexp_replace(lower(strip_accents(x)), '[^a-z0-9%$.\-\s]', ' ', 'g') as x from t),
    k as (select sig_id, regexp_extract(x, '\b(20[0-9][0-9])\s*-\s*(20[0-9][0-9]|[0-9][0-9])\b', 1) as a, regexp_extract(x, '\b(20[0-9][0-9])\s*-\s*(20[0-9][0-9]|[0-9][0-9])\b', 2) as b, regexp_extract(x, '\b(20[0-9][0-9])\b', 1) as y from n)
    select sig_id, case when a <> '' and length(b) = 4 then a || '-' || b when a <> '' then a || '-' || left(a, 2) || b when y <> '' then y end as season from k""")  # fmt: skip
def c12(t):
    # A third of the rows get a season of two years, written in two ways.
    y = F.col("season_year")
    season = F.concat(y, F.when(F.col("sig_id") % 2 == 0, " - 20").otherwise("-"), (F.right(y, F.lit(2)).cast("int") + 1).cast("string"))
    said = F.when(F.col("sig_id") % 3 == 0, season).otherwise(F.col("polymarket_question"))
    return t("poly_signature").select("sig_id", text.season_key(said).alias("season"))


@query("c16_numbers", r"""
    select sig_id, list_transform(regexp_extract_all(regexp_replace(kalshi_title, '([0-9]),([0-9]{3})', '\1\2', 'g'), '([0-9]+(?:\.[0-9]+)?)', 1), lambda x: x) as nums from kalshi_signature""")
def c16(t):
    return t("kalshi_signature").select("sig_id", text.number_texts(F.col("kalshi_title")).alias("nums"))


@query("c19_json_fields", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def c19(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("c20_first_filled", """
    select distinct rule_id, coalesce(case when trim(kalshi_rules_primary, ' ') <> '' then kalshi_rules_primary end,
        case when trim(kalshi_rules_secondary, ' ') <> '' then kalshi_rules_secondary end, case when trim(polymarket_rules, ' ') <> '' then polymarket_rules end) as rules
    from raw_settlement_rules""")  # fmt: skip
def c20(t):
    rules = text.first_filled(F.col("kalshi_rules_primary"), F.col("kalshi_rules_secondary"), F.col("polymarket_rules"))
    return t("raw_settlement_rules").select("rule_id", rules.alias("rules")).distinct()


@query("c25_series_key", "select distinct signal_id, split_part(ticker, '-', 1) as series, coalesce(topic, ticker, 'unknown') as event_key from signals")
def c25(t):
    return t("signals").select("signal_id", F.split_part("ticker", F.lit("-"), F.lit(1)).alias("series"), F.coalesce("topic", "ticker", F.lit("unknown")).alias("event_key")).distinct()


@query("c31_short_titles", r"""
    with s as (select sig_id, regexp_replace(trim(regexp_replace(polymarket_question, '\s+', ' ', 'g')), '^(who will|will) ', '', 'i') as t from poly_signature)
    select sig_id, case when length(t) <= 34 then t when regexp_extract(left(t, 35), '^(.*)\s', 1) <> '' then regexp_extract(left(t, 35), '^(.*)\s', 1) else left(t, 34) end as short_title from s""")  # fmt: skip
def c31(t):
    return t("poly_signature").select("sig_id", text.shorten(F.col("polymarket_question"), 34).alias("short_title"))


# Similarity

_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)))"


@query("e3_title_similarity", f"""
    with w as (select distinct audit_id, trim(regexp_replace(lower(kalshi_title), '[^a-z0-9]+', ' ', 'g')) as a, trim(regexp_replace(lower(polymarket_question), '[^a-z0-9]+', ' ', 'g')) as b
               from match_audit where kalshi_title is not null and polymarket_question is not null),
    g as (select audit_id, {_GRAMS.format("a")} as x, {_GRAMS.format("b")} as y from w),
    n as (select audit_id, len(list_intersect(x, y)) as i, len(x) as nx, len(y) as ny from g)
    select audit_id, round(case when nx + ny - i = 0 then 0.0 else i / (nx + ny - i) end, 6) as jac, round(case when least(nx, ny) = 0 then 0.0 else i / least(nx, ny) end, 6) as cont from n""")  # fmt: skip
def e3(t):
    rows = t("match_audit").where("kalshi_title is not null and polymarket_question is not null").select("audit_id", "kalshi_title", "polymarket_question").distinct()
    grams = rows.select("audit_id", text.char_ngrams(F.col("kalshi_title")).alias("x"), text.char_ngrams(F.col("polymarket_question")).alias("y"))
    return grams.select("audit_id", F.round(similarity.jaccard(F.col("x"), F.col("y")), 6).alias("jac"), F.round(similarity.containment(F.col("x"), F.col("y")), 6).alias("cont"))


@query("e1_sequence_similarity")
def e1(t):
    rows = t("match_audit").where("kalshi_title is not null and polymarket_question is not null").select("audit_id", "kalshi_title", "polymarket_question").distinct()
    a, b = text.spaced_words(F.col("kalshi_title")), text.spaced_words(F.col("polymarket_question"))
    blend = 0.7 * similarity.jaccard(F.split(a, " "), F.split(b, " ")) + 0.3 * similarity.sequence_ratio(a, b)
    return rows.select("audit_id", F.round(blend, 6).alias("likeness"))


@query("e12_candidate_cosine", """
    with c as (select distinct * from hybrid_candidate)
    select c.cand_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 5) as score_now
    from c join semantic_poly a on a.vec_id = c.query_vec_id join semantic_poly b on b.vec_id = c.poly_idx
    where list_dot_product(a.embedding::double[], a.embedding::double[]) > 0 and list_dot_product(b.embedding::double[], b.embedding::double[]) > 0""")  # fmt: skip
def e12(t):
    vec = t("semantic_poly").select("vec_id", "embedding").where("embedding is not null")
    a, b = (vec.withColumnsRenamed({"vec_id": k, "embedding": f"{k}_v"}) for k in ("query_vec_id", "poly_idx"))
    cands = t("hybrid_candidate").select("cand_id", "query_vec_id", "poly_idx").dropDuplicates(["cand_id"])
    score = similarity.cosine(F.col("query_vec_id_v"), F.col("poly_idx_v"))
    return cands.join(a, "query_vec_id").join(b, "poly_idx").select("cand_id", F.round(score, 5).alias("score_now")).where("score_now is not null")


# Joins and retrieval


@query("g1_null_safe_join", """
    select a.sig_id as left_id, b.sig_id as right_id from kalshi_signature a join poly_signature b
    on a.subject = b.subject and a.season_year is not distinct from b.season_year and a.competition is not distinct from b.competition
       and a.stage is not distinct from b.stage and a.metric is not distinct from b.metric and a.threshold_op is not distinct from b.threshold_op
    where a.subject is not null""")  # fmt: skip
def g1(t):
    keys = ["subject", "season_year", "competition", "stage", "metric", "threshold_op"]
    left = t("kalshi_signature").where("subject is not null").select(*keys, F.col("sig_id").alias("left_id"))
    right = t("poly_signature").where("subject is not null").select(*keys, F.col("sig_id").alias("right_id"))
    return linkage.null_safe_join(left, right, keys).select("left_id", "right_id")


_WORDS_SQL = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 3))"


@query("g3_weighted_votes", f"""
    with l as (select sig_id as left_id, unnest({_WORDS_SQL.format("kalshi_title")}) as tok from kalshi_signature),
    r as (select sig_id as right_id, unnest({_WORDS_SQL.format("polymarket_question")}) as tok from poly_signature),
    n as (select (select count(*) from kalshi_signature) as nl, (select count(*) from poly_signature) as nr),
    c as (select tok, sum(a) as a, sum(b) as b from (select tok, 1 as a, 0 as b from l union all select tok, 0, 1 from r) group by tok),
    df as (select tok, ln(1 + (nl + nr)::double / (a + b)) as w from c, n where a <= greatest(20, 0.03 * nl) and b <= greatest(20, 0.03 * nr)),
    v as (select left_id, right_id, w from l join df using (tok) join r using (tok)),
    ml as (select left_id, string_agg(tok, ' ' order by tok) as everything from l where left_id not in (select left_id from l join df using (tok)) group by left_id),
    mr as (select right_id, string_agg(tok, ' ' order by tok) as everything from r where right_id not in (select right_id from r join df using (tok)) group by right_id),
    x as (select * from v union all select left_id, right_id, ln(1 + (nl + nr) / 2.0) from ml join mr using (everything), n)
    select left_id, right_id, count(*) as votes, round(sum(w), 4) as weight from x group by left_id, right_id""")  # fmt: skip
def g3(t):
    words = lambda c: F.filter(F.split(text.spaced_words(F.col(c)), " "), lambda w: F.length(w) >= 3)
    left = t("kalshi_signature").select(F.col("sig_id").alias("left_id"), words("kalshi_title").alias("toks"))
    right = t("poly_signature").select(F.col("sig_id").alias("right_id"), words("polymarket_question").alias("toks"))
    return linkage.vote_candidates(left, right, "left_id", "right_id", "toks", 0.03, 20).withColumn("weight", F.round("weight", 4))


@query("g8_domain_top_k", """
    with p as (select q.vec_id as query_id, e.vec_id as neighbour_id,
        round(list_dot_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 6) as score
        from embeddings q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id where q.vec_id % 50 = 0)
    select query_id, neighbour_id, round(score, 4) as score from p qualify row_number() over (partition by query_id order by score desc, neighbour_id) <= 10""")  # fmt: skip
def g8(t):
    rows = t("embeddings").select("vec_id", "label", "embedding")
    top = linkage.domain_top_k(rows.where("vec_id % 50 = 0"), rows, "label", "vec_id", "embedding", 10)
    return top.select("query_id", "neighbour_id", F.round("score", 4).alias("score"))


@query("g9_merge_candidates", """
    with c as (select distinct * from hybrid_candidate), x as (select query_vec_id, poly_idx, embedding_score, unnest(retrieval_sources) as s from c)
    select query_vec_id, poly_idx, round(max(embedding_score), 6) as embedding_score, list_sort(list(distinct s)) as retrieval_sources from x group by 1, 2""")  # fmt: skip
def g9(t):
    rows = t("hybrid_candidate").select("cand_id", "query_vec_id", "poly_idx", "embedding_score", "retrieval_sources").dropDuplicates(["cand_id"]).where("size(retrieval_sources) > 0")
    return linkage.merge_candidates(rows, ["query_vec_id", "poly_idx"], "embedding_score", "retrieval_sources").withColumn("embedding_score", F.round("embedding_score", 6))


_EVENTS = "with e as (select event_id, user_id, event_type, value, epoch_us(ts) / 1e6 as sec from events) "


def _events(t: Source) -> DataFrame:
    return t("events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sec"))


@query("g10_asof_join", _EVENTS + """
    , o as (select user_id, sec, event_id from e where event_type = 'click'),
    p as (select event_id, user_id, sec from e where event_type = 'purchase')
    select p.event_id, (select arg_max(o.event_id, (o.sec, o.event_id)) from o where o.user_id = p.user_id and o.sec <= p.sec) as last_click from p""")  # fmt: skip
def g10(t):
    e = _events(t)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "sec")
    right = e.where("event_type = 'click'").select("user_id", "sec", F.col("event_id").alias("click"))
    return linkage.asof_join(left, right, "user_id", "sec", "click", "last_click", "click").select("event_id", "last_click")


@query("g11_range_join", _EVENTS + """
    select a.event_id as first_id, b.event_id as second_id from e a join e b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'click' and abs(a.sec - b.sec) <= 3600""")  # fmt: skip
def g11(t):
    e = _events(t)
    left = e.where("event_type = 'purchase'").select(F.col("event_id").alias("first_id"), "user_id", "sec")
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("second_id"), "user_id", F.col("sec").alias("other_sec"))
    return linkage.range_join(left, right, "user_id", "sec", "other_sec", 3600.0).select("first_id", "second_id")


@query("g12_semi_join", """
    select sig_id from kalshi_signature k where not structured_complete and subject is not null
        and exists (select 1 from poly_signature p where lower(p.subject) = lower(k.subject) and p.season_year is not distinct from k.season_year)""")  # fmt: skip
def g12(t):
    key = lambda d: d.where("subject is not null").withColumn("who", F.lower("subject"))
    left = key(t("kalshi_signature").select("sig_id", "subject", "season_year", "structured_complete")).where("not structured_complete")
    right = key(t("poly_signature").select("subject", F.col("season_year").alias("year")))
    return left.join(right, (left["who"] == right["who"]) & left["season_year"].eqNullSafe(right["year"]), "left_semi").select("sig_id")


@query("g13_exhaustive_groups", """
    with seen as (select o_custkey as c, list_sort(list(distinct o_orderpriority)) as s from orders group by 1),
    declared as (select distinct o_orderpriority as p from orders), d as (select list_sort(list(p)) as s from declared)
    select c, len(seen.s) as members from seen, d where seen.s = d.s and len(seen.s) >= 3""")  # fmt: skip
def g13(t):
    orders = t("orders").select(F.col("o_custkey").alias("c"), "o_orderpriority")
    # The declared members are one row of a closed vocabulary: a scalar subquery of the plan, joined by a constant.
    declared = orders.select("o_orderpriority").distinct().agg(F.array_sort(F.collect_list("o_orderpriority")).alias("every")).withColumn("one", F.lit(1))
    customers = orders.select("c").distinct().withColumn("one", F.lit(1)).join(declared, "one").drop("one")
    return linkage.exhaustive_groups(orders, "c", "o_orderpriority", customers, "every", 3).select("c", F.size("every").alias("members"))


@query("g15_validated_merge", "select o_orderkey, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def g15(t):
    customers = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return linkage.validated_merge(t("orders").select("o_orderkey", "o_custkey"), customers, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("g16_nearest_time", _EVENTS + """
    , o as (select user_id, sec, event_id from e where event_type = 'click'), p as (select event_id, user_id, sec from e where event_type = 'error')
    select p.event_id, (select min(abs(o.sec - p.sec)) from o where o.user_id = p.user_id) as distance from p""")  # fmt: skip
def g16(t):
    e = _events(t)
    left = e.where("event_type = 'error'").select("event_id", "user_id", "sec")
    right = e.where("event_type = 'click'").select("user_id", "sec", F.col("sec").alias("click_sec"), "event_id")
    near = linkage.nearest_join(left, right.withColumnRenamed("event_id", "tie"), "user_id", "sec", "click_sec", "nearest", "tie")
    return near.select("event_id", F.abs(F.col("nearest") - F.col("sec")).alias("distance"))


@query("g17_anti_join", "select vec_id from semantic_poly s where not exists (select 1 from hybrid_candidate h where h.query_vec_id = s.vec_id)")
def g17(t):
    return t("semantic_poly").select("vec_id").join(t("hybrid_candidate").select(F.col("query_vec_id").alias("vec_id")), "vec_id", "left_anti")


@query("h1_first_reason", """
    select distinct audit_id, case when kalshi_title is null or kalshi_title = '' or polymarket_question is null or polymarket_question = '' then 'TITLE_MISSING'
        when kalshi_title = polymarket_question then 'PROOF_EXACT_TITLE' when score < 0.3 then 'LOW_SCORE' when len(reasons) > 2 then 'MANY_REASONS' end as reason from match_audit""")  # fmt: skip
def h1(t):
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    rules = [
        ("TITLE_MISSING", blank("kalshi_title") | blank("polymarket_question")), ("PROOF_EXACT_TITLE", F.col("kalshi_title") == F.col("polymarket_question")),
        ("LOW_SCORE", F.col("score") < 0.3), ("MANY_REASONS", F.array_size("reasons") > 2),
    ]
    return t("match_audit").select("audit_id", ranking.first_reason(rules).alias("reason")).distinct()


# Running state


@query("j1_depth_fill", """
    with l as (select l_partkey as book, l_extendedprice / l_quantity as price, cast(l_quantity as double) as size, l_orderkey, l_linenumber from lineitem),
    b as (select *, coalesce(sum(size) over (partition by book order by price, l_orderkey, l_linenumber rows between unbounded preceding and 1 preceding), 0) as before from l where price > 0 and size > 0),
    q as (select unnest([1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 500.0])::double as quantity),
    f as (select book, quantity, least(size, quantity - before) as take, price from b join q on before < quantity)
    select book, quantity, sum(take) as filled, round(sum(take * price), 7) as cost, max(price) as worst, count(*) as levels from f group by book, quantity""")  # fmt: skip
def j1(t):
    levels = t("lineitem").select(F.col("l_partkey").alias("book"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_quantity").cast("double").alias("size"), "l_orderkey", "l_linenumber")
    fills = ledger.depth_fill(levels, "book", "price", "size", ["l_orderkey", "l_linenumber"], [1, 2, 5, 10, 20, 50, 100, 500])
    return fills


@query("l2_confirm_samples", _ONCE + """
    select ticker, strategy, count(*) as n, round(min(net_profit), 6) + 0.0 as worst, round(sum(net_profit), 4) + 0.0 as total, round(max(net_profit), 6) + 0.0 as best, bool_and(net_profit >= 0) as confirmed
    from s where ticker is not null and strategy is not null and net_profit is not null and not isnan(net_profit) group by 1, 2""")  # fmt: skip
def l2(t):
    rows = _signals(t, "signal_id", "ticker", "strategy", "net_profit").where("ticker is not null and strategy is not null and net_profit is not null and not isnan(net_profit)")
    r6 = lambda c: F.round(c, 6)
    return rows.groupBy("ticker", "strategy").agg(F.count("*").alias("n"), r6(F.min("net_profit")).alias("worst"), F.round(F.sum("net_profit"), 4).alias("total"), r6(F.max("net_profit")).alias("best"), F.bool_and(F.col("net_profit") >= 0).alias("confirmed"))


@query("l5_diversified_top", _ONCE + """
    , r as (select signal_id, topic, allocation_score, row_number() over (partition by topic order by allocation_score desc, signal_id) as k from s where allocation_score is not null and not isnan(allocation_score))
    select signal_id, topic, round(allocation_score, 6) as allocation_score from r order by (k > 8)::int, allocation_score desc, signal_id limit 100""")  # fmt: skip
def l5(t):
    rows = _signals(t, "signal_id", "topic", "allocation_score").where("allocation_score is not null and not isnan(allocation_score)").distinct()
    top = ranking.diversified_top(rows, "topic", [F.col("allocation_score").desc(), F.col("signal_id")], 8, 100)
    return top.select("signal_id", "topic", F.round("allocation_score", 6).alias("allocation_score"))


@query("m7_running_balance", """
    with b as (select event_id, user_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as balance, ts from events),
    p as (select event_id, balance, max(balance) over (partition by user_id order by ts, event_id rows unbounded preceding) as peak from b)
    select event_id, round(balance, 2) as balance, round(peak, 2) as peak, round(peak - balance, 2) as drawdown from p""")  # fmt: skip
def m7(t):
    rows = t("events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "value")
    held = ledger.running_balance(rows, "user_id", ["micros", "event_id"], "micros", "value")
    return held.select("event_id", F.round("balance", 2).alias("balance"), F.round("peak", 2).alias("peak"), F.round(F.col("peak") - F.col("balance"), 2).alias("drawdown"))


@query("m8_replenished", """
    with l as (select event_id, value, lag(value) over (partition by user_id, event_type order by ts, event_id) as previous from events)
    select event_id, round(previous, 4) as previous from l where value - previous >= greatest(5, previous * 0.5)""")  # fmt: skip
def m8(t):
    events = t("events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "value")
    rows = ledger.replenished(events, ["user_id", "event_type"], ["micros", "event_id"], "micros", "value", 0.5, 5.0)
    return rows.select("event_id", F.round("previous", 4).alias("previous"))


@query("m14_first_crossing", """
    with r as (select user_id, epoch_us(ts) as sec, sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from events)
    select user_id, min(case when run >= 500 then sec end) as crossed_at, count(*) as rows_seen from r group by user_id""")  # fmt: skip
def m14(t):
    rows = t("events").select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("sec"), "value")
    return ledger.first_crossing(rows, "user_id", ["sec", "event_id"], "value", "sec", 500.0)


@query("m14_sessions", _EVENTS + """
    , g as (select *, case when sec - lag(sec) over (partition by user_id order by sec, event_id) <= 1800 then 0 else 1 end as fresh from e),
    k as (select user_id, sec, sum(fresh) over (partition by user_id order by sec, event_id rows unbounded preceding) as session_no from g)
    select user_id, session_no::bigint as session_no, count(*) as n, max(sec) - min(sec) as seconds from k group by 1, 2""")  # fmt: skip
def m14s(t):
    held = ledger.sessions(_events(t), "user_id", "sec", "event_id", 1800.0)
    return held.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), (F.max("sec") - F.min("sec")).alias("seconds"))


# Analytics


@query("n1_strongest", _ONCE + """
    select ticker, strategy, signal_id, round(net_profit, 6) + 0.0 as net_profit from s where net_profit is not null and not isnan(net_profit)
    qualify row_number() over (partition by ticker, strategy order by net_profit desc, signal_id) = 1""")  # fmt: skip
def n1(t):
    rows = t("signals").where("net_profit is not null and not isnan(net_profit)").select("ticker", "strategy", "signal_id", "net_profit")
    return ranking.keep_one(rows, ["ticker", "strategy"], [F.col("net_profit").desc(), F.col("signal_id")]).select("ticker", "strategy", "signal_id", F.round("net_profit", 6).alias("net_profit"))


_FINITE = "capital is not null and not isnan(capital) and {0} is not null and not isnan({0})"


@query("n4_weighted_means", _ONCE + f"""
    select strategy, round(sum(settlement_days * capital) / nullif(sum(capital), 0), 4) as days, count(*) as n from s where {_FINITE.format("settlement_days")} group by strategy""")
def n4(t):
    rows = _signals(t, "strategy", "settlement_days", "capital").where(_FINITE.format("settlement_days"))
    return rows.groupBy("strategy").agg(F.round(analytics.weighted_mean("settlement_days", "capital"), 4).alias("days"), F.count("*").alias("n"))


@query("n5_sum_by_topic", _ONCE + "select topic, round(sum(net_profit), 3) + 0.0 as total, count(*) as n from s where net_profit is not null and not isnan(net_profit) group by topic")
def n5(t):
    rows = _signals(t, "topic", "net_profit").where("net_profit is not null and not isnan(net_profit)")
    return rows.groupBy("topic").agg(F.round(F.sum("net_profit"), 3).alias("total"), F.count("*").alias("n"))


@query("n7_value_counts", _ONCE + "select reason, count(*) as n from s group by reason order by n desc, reason limit 12")
def n7(t):
    return _signals(t, "reason").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("reason").asc_nulls_last()).limit(12)


@query("n8_share_positive", _ONCE + """
    select strategy, round(avg(net_profit), 6) + 0.0 as mean_net, round(avg((net_profit > 0)::int), 6) as share_positive from s where net_profit is not null and not isnan(net_profit) group by strategy""")
def n8(t):
    rows = _signals(t, "strategy", "net_profit").where("net_profit is not null and not isnan(net_profit)")
    return rows.groupBy("strategy").agg(F.round(F.avg("net_profit"), 6).alias("mean_net"), F.round(analytics.share_positive("net_profit"), 6).alias("share_positive"))


@query("n10_histogram", """
    select case when value < 0 then 0 when value >= 200 then 11 else cast(floor(value / 20.0) as bigint) + 1 end as bin, count(*) as n from events where value is not null and not isnan(value) group by 1""")
def n10(t):
    return analytics.histogram(t("events"), "value", 0.0, 200.0, 10)


@query("n12_describe", """
    select event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as least, max(value) as most, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50,
        round(quantile_cont(value, 0.75), 6) as p75, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99
    from events where value is not null and not isnan(value) group by event_type""")  # fmt: skip
def n12(t):
    return analytics.describe(t("events"), ["event_type"], "value", [0.25, 0.5, 0.75, 0.9, 0.95, 0.99])


@query("n13_argmax_per_key", _ONCE + """
    select ticker, round(max(annualized_hold_return), 6) as best, count(*) as n, arg_max(signal_id, (annualized_hold_return, -signal_id)) as best_signal
    from s where ticker is not null and annualized_hold_return is not null and not isnan(annualized_hold_return) group by ticker""")  # fmt: skip
def n13(t):
    rows = _signals(t, "signal_id", "ticker", "annualized_hold_return").where("ticker is not null and annualized_hold_return is not null and not isnan(annualized_hold_return)").distinct()
    best = F.max_by("signal_id", F.struct("annualized_hold_return", (-F.col("signal_id")).alias("i")))
    return rows.groupBy("ticker").agg(F.round(F.max("annualized_hold_return"), 6).alias("best"), F.count("*").alias("n"), best.alias("best_signal"))


@query("n14_distinct_counts", _ONCE + "select run_id, count(distinct ticker) as tickers, count(distinct topic) as topics, count(*) as n from s group by run_id")
def n14(t):
    return _signals(t, "run_id", "ticker", "topic").groupBy("run_id").agg(F.countDistinct("ticker").alias("tickers"), F.countDistinct("topic").alias("topics"), F.count("*").alias("n"))


@query("n16_coverage", """
    with r as (select distinct * from raw_settlement_rules)
    select polymarket_resolution_source as src, count(*) as n, count(*) filter (where kalshi_fetch_ok) as left_ok, count(*) filter (where polymarket_fetch_ok) as right_ok,
        count(*) filter (where length(kalshi_rules_primary) > 10) as with_rules, count(*) filter (where regexp_matches(lower(polymarket_rules), 'overtime|extra time')) as overtime from r group by 1""")  # fmt: skip
def n16(t):
    stages = {"n": F.lit(True), "left_ok": F.col("kalshi_fetch_ok"), "right_ok": F.col("polymarket_fetch_ok"), "with_rules": F.length("kalshi_rules_primary") > 10, "overtime": F.lower("polymarket_rules").rlike("overtime|extra time")}
    columns = ["rule_id", "kalshi_fetch_ok", "polymarket_fetch_ok", "kalshi_rules_primary", "polymarket_rules", F.col("polymarket_resolution_source").alias("src")]
    rows = t("raw_settlement_rules").select(*columns).dropDuplicates(["rule_id"])
    return analytics.funnel(rows, ["src"], stages)


@query("n17_audit_summary", """
    with m as (select distinct audit_id, verdict, reasons from match_audit), x as (select verdict, unnest(reasons) as reason from m)
    select verdict, reason, count(*) as n from x group by 1, 2""")  # fmt: skip
def n17(t):
    rows = t("match_audit").select("audit_id", "verdict", "reasons").distinct()
    return rows.select("verdict", F.explode("reasons").alias("reason")).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


# Multi-join aggregates on the star schema


@query("q0_region_revenue", """
    select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")  # fmt: skip
def revenue(t):
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    where = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    place = t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(where, "n_nationkey")
    return lines.join(orders, "l_orderkey").join(place, "c_custkey").groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("m8_last_before", """
    select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous_order from orders""")
def last_before(t):
    orders = t("orders").select("o_orderkey", "o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    return ledger.previous(orders, ["o_custkey"], ["day", "o_orderkey"], "day", "o_orderkey", "previous_order").select("o_orderkey", "previous_order")
