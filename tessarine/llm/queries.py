"""Queries of the corpus operators, with their SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.llm import encoding, lookalike, matching, packing, residue, topn, vectors
from tessarine.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most profitable signals of every ticker and strategy."""
    best = topn.top_n(table(spark, sf_dir, "signals"), ["ticker", "strategy"], "net_profit", "signal_id", 3, tie="logged_at")
    return best.select("ticker", "strategy", "signal_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors with a cosine of 0.90 or more, one of them among the five nearest of the other."""
    near = vectors.nearest(table(spark, sf_dir, "semantic_poly"), "vec_id", "embedding", k=5, least=0.90)
    return near.select(F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")).distinct()


def _matched(spark: SparkSession, sf_dir: str, confidence: bool) -> DataFrame:
    left = table(spark, sf_dir, "kalshi_signature").withColumns({"id": F.col("sig_id"), "title": F.col("kalshi_title")})
    right = table(spark, sf_dir, "poly_signature").withColumns({"id": F.col("sig_id"), "title": F.col("polymarket_question")})
    return matching.match(left, right, confidence=confidence).withColumnsRenamed({"left_id": "kalshi_sig_id", "right_id": "poly_sig_id"})


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of signatures of the two venues that state the same contract, with a confidence."""
    return _matched(spark, sf_dir, True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched pairs alone."""
    return _matched(spark, sf_dir, False).select("kalshi_sig_id", "poly_sig_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows whose two titles are different strings that look the same."""
    titles = table(spark, sf_dir, "match_audit").select("audit_id", "kalshi_title", "polymarket_question")
    return lookalike.same_look(titles, "kalshi_title", "polymarket_question").where("verdict = 'same look'").select("audit_id").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


#: Scraped texts never share a container with the feed that settles contracts.
APART = [("crawl", "settlement_feed")]


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container for every document, under each of the token budgets."""
    # The budgets are a fixed table of a few rows.
    budgets = [(r.budget_id, r.capacity_tokens) for r in table(spark, sf_dir, "token_budget").select("budget_id", "capacity_tokens").distinct().collect()]
    return packing.pack(table(spark, sf_dir, "documents"), sorted(budgets), apart=APART)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are template residue, filler, an error page or a script notice."""
    return residue.find_residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many residue records are found by what, and how many of them the learning started from."""
    return residue.find_residue(table(spark, sf_dir, "documents")).groupBy("kind", "trusted").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_matches": p3_matches,
    "p5_found": p5_found,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_kinds": p9_kinds,
}

ORACLE_SQL: dict[str, str] = {
    "p2_found": """
        with v as (
            select vec_id, min(embedding::double[]) as e from semantic_poly
            where embedding is not null and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by vec_id
        ),
        n as (select vec_id, e, sqrt(list_dot_product(e, e)) as s from v),
        p as (
            select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.e, b.e) / (a.s * b.s), 9) as c
            from n a join n b on a.vec_id <> b.vec_id
        )
        select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b
        from (select *, row_number() over (partition by a order by c desc, b) as k from p) where k <= 5 and c >= 0.90
    """,
    "p1_found": """
        with once as (
            select distinct ticker, strategy, signal_id, net_profit, logged_at from signals
            where ticker is not null and strategy is not null and net_profit is not null and not isnan(net_profit)
        )
        select ticker, strategy, signal_id from once
        qualify row_number() over (
            partition by ticker, strategy order by net_profit desc, logged_at asc nulls last, signal_id asc) <= 3
    """,
}
