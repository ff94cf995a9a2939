"""Joins and candidate retrieval between record sets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine.functions import entities
from tessarine.functions.similarity import cosine
from tessarine.session import slots


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal. Both sides must differ in their other column names."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__{k}"])
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def same_entities(left: DataFrame, right: DataFrame, keys: Sequence[str], x: str, z: str) -> DataFrame:
    """(keys, x, z): all pairs of canonical names with equal keys that ``canonical_verdict`` takes for one entity, each once.

    Candidates leave no such pair out. If the words of one name hold those of the other, they hold its rarest word.
    If the ratio of two names is 0.88, at least 0.44 of the letters T of both stand in one order in both; every
    other letter breaks three of the padded trigrams of its own name and two of those of the other, so they share 0.2 T + 2.
    In the order of rarity, then, they share one of the trigrams that are left when the last ones of either are taken away.
    """
    keys = list(keys)
    sides = [d.select(*keys, F.col(c).alias("n")).where("n != ''").distinct() for d, c in ((left, x), (right, z))]

    def ranked(parts: Column) -> list[DataFrame]:
        """Names of both sides with their parts, rarest first; a part is counted among the names of its keys."""
        own = [d.withColumn("p", F.explode(parts)) for d in sides]
        counts = own[0].unionByName(own[1]).groupBy(*keys, "p").agg(F.count("*").alias("c"))
        term = F.array_sort(F.collect_list(F.struct("c", "p")))
        return [d.join(counts, [*keys, "p"]).groupBy(*keys, "n").agg(F.transform(term, lambda t: t["p"]).alias("p")) for d in own]

    def met(a: DataFrame, a_parts: Column, b: DataFrame, b_parts: Column, kept: Column) -> DataFrame:
        a = a.select(*keys, F.col("n").alias("x"), F.col("p").alias("ps"), F.explode(a_parts).alias("p"))
        b = b.select(*keys, F.col("n").alias("z"), F.col("p").alias("qs"), F.explode(b_parts).alias("p"))
        return a.join(b, [*keys, "p"]).where(kept).select(*keys, "x", "z")

    def head(least: Column) -> Column:
        return F.slice("p", 1, F.size("p") - F.ceil(least - 1e-9).cast("int") + 1)

    a, b = ranked(F.array_distinct(F.split("n", " ")))
    first = F.slice("p", 1, 1)
    pairs = met(a, first, b, F.col("p"), F.size(F.array_except("ps", "qs")) == 0)
    pairs = pairs.unionByName(met(a, F.col("p"), b, first, F.size(F.array_except("qs", "ps")) == 0))
    padded = F.concat(F.lit("  "), F.col("n"), F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.length("n") + 2), lambda k: F.substring(padded, k, F.lit(3)))
    # A trigram that comes again is another part.
    grams = F.transform(grams, lambda g, k: F.concat(g, F.size(F.filter(F.slice(grams, 1, k), lambda h: h == g)).cast("string")))
    a, b = ranked(grams)
    # The other name has 11/14 of the letters of this one or more.
    least = head(0.2 * (F.length("n") + F.ceil(F.length("n") * 11 / 14 - 1e-9)) + 2)
    total = F.length("x") + F.length("z")
    near = (2.0 * F.least(F.length("x"), F.length("z")) / total >= 0.88) & (F.size(F.array_intersect("ps", "qs")) >= 0.2 * total + 2 - 1e-9)
    pairs = pairs.unionByName(met(a, least, b, least, near)).distinct().repartition(4 * slots(left.sparkSession), "x", "z")
    return pairs.where(entities.canonical_verdict(F.col("x"), F.col("z"))).select(*keys, F.col("x").alias(x), F.col("z").alias(z))


def vote_candidates(left: DataFrame, right: DataFrame, lid: str, rid: str, tokens: str, share: float = 0.08, least: int = 80) -> DataFrame:
    """(lid, rid, votes, weight): pairs that share words which are not too common to vote.

    A word votes if it stands in at most ``max(least, share * rows)`` rows of either side; the limit grows with
    the tables. Rows whose words are all commoner vote by their whole set of words: they pair
    with the rows of the other side that have the same set. The weight of a pair sums log(1 + N / df) over the words that vote,
    N being the rows of both sides; sets of words that are equal weigh as one word in two rows.
    """
    sides = [d.select(F.col(i), F.array_sort(F.array_distinct(tokens)).alias("__set")) for d, i in ((left, lid), (right, rid))]
    n_left, n_right = (d.count() for d in sides)
    exploded = [d.select(i, F.explode("__set").alias("tok")) for d, i in zip(sides, (lid, rid))]
    counts = exploded[0].select("tok", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(exploded[1].select("tok", F.lit(0).alias("a"), F.lit(1).alias("b")))
    df = counts.groupBy("tok").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    df = df.where((F.col("a") <= max(least, share * n_left)) & (F.col("b") <= max(least, share * n_right))).select("tok", F.log(1 + F.lit(float(n_left + n_right)) / (F.col("a") + F.col("b"))).alias("w"))
    # Words and ids grow with the tables: they are merged, never gathered on the driver for a broadcast.
    voting = [d.join(df.hint("merge"), "tok") for d in exploded]
    votes = voting[0].join(voting[1].drop("w").hint("merge"), "tok").select(lid, rid, "w")
    mute = [d.where(F.size("__set") > 0).join(v.select(i).distinct().hint("merge"), i, "left_anti").select(i, F.array_join("__set", " ").alias("__all")) for d, v, i in zip(sides, voting, (lid, rid))]
    alike = mute[0].join(mute[1].hint("merge"), "__all").select(lid, rid, F.lit(math.log(1 + (n_left + n_right) / 2)).alias("w"))
    return votes.unionByName(alike).groupBy(lid, rid).agg(F.count("*").alias("votes"), F.sum("w").alias("weight"))


def range_join(left: DataFrame, right: DataFrame, key: str, at: str, other_at: str, width: float) -> DataFrame:
    """Pairs of equal ``key`` with ``|at - other_at| <= width`` (both in seconds).

    Time is cut into buckets of ``width``; the left side is matched with its own and the two adjacent
    buckets, so the join is an equi-join on (key, bucket) and a busy key is spread over its buckets.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    l = left.withColumn("__cell", F.explode(F.array(cell(at) - 1, cell(at), cell(at) + 1)))  # noqa: E741
    r = right.withColumn("__cell", cell(other_at))
    return l.join(r, [key, "__cell"]).where(F.abs(F.col(at) - F.col(other_at)) <= width).drop("__cell")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, payload: str, out: str, tie: str, hot_rows: int | None = None) -> DataFrame:
    """Each left row with ``payload`` of the last right row of its key at or before ``at`` (numeric).

    Union and a running last value in place of a join: no pairs are made. A key with more than ``hot_rows`` rows is cut into
    stretches of time, each of which is walked on its own and starts with the last value of those before it, so
    it is spread over tasks. Among right rows of one instant the largest ``tie`` counts.
    """
    from tessarine.operators.ledger import HOT_ROWS, stretches

    l = left.withColumns({"__p": F.lit(None).cast(dict(right.dtypes)[payload]), "__side": F.lit(1), "__tie": F.lit(None).cast("long")})  # noqa: E741
    r = right.select(key, at, F.col(payload).alias("__p"), F.lit(0).alias("__side"), F.col(tie).cast("long").alias("__tie"))
    both, split = stretches(l.unionByName(r, allowMissingColumns=True), [key], at, hot_rows=hot_rows or HOT_ROWS)
    order = Window.partitionBy(key, "__b").orderBy(at, "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = both.withColumn("__own", F.last("__p", ignorenulls=True).over(order)).where("__side = 1")
    if not split:
        return walked.withColumn(out, F.col("__own")).drop("__p", "__side", "__tie", "__b", "__own")
    last = both.where("__side = 0 and __p is not null").groupBy(key, "__b").agg(F.max_by("__p", F.struct(at, "__tie")).alias("__last"))
    # The last value before each stretch: at most one row a key and stretch meets the running window.
    needed = both.select(key, "__b").distinct()
    earlier = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = null_safe_join(needed, last, [key, "__b"], "left").withColumn("__carried", F.last("__last", ignorenulls=True).over(earlier))
    joined = null_safe_join(walked, carried.select(key, "__b", "__carried"), [key, "__b"], "left")
    return joined.withColumn(out, F.coalesce("__own", "__carried")).drop("__p", "__side", "__tie", "__b", "__own", "__carried")


def nearest_join(left: DataFrame, right: DataFrame, key: str, at: str, payload: str, out: str, tie: str) -> DataFrame:
    """Each left row with ``payload`` of the right row of its key nearest in time (earlier wins a tie)."""
    before = asof_join(left, right.withColumn("__x", F.struct(F.col(at).alias("t"), F.col(payload).alias("v"))), key, at, "__x", "__before", tie)
    flip = lambda d: d.withColumn("__neg", -F.col(at))
    after = asof_join(flip(before), flip(right).withColumn("__x", F.struct(F.col(at).alias("t"), F.col(payload).alias("v"))), key, "__neg", "__x", "__after", tie)
    closer = F.col("__before.t").isNotNull() & (F.col("__after.t").isNull() | (F.col(at) - F.col("__before.t") <= F.col("__after.t") - F.col(at)))
    return after.withColumn(out, F.when(closer, F.col("__before.v")).otherwise(F.col("__after.v"))).drop("__before", "__after", "__neg")


def domain_top_k(queries: DataFrame, rows: DataFrame, domain: str, vec_id: str, embedding: str, k: int, floor: float | None = None, rescue: int = 0, rescue_floor: float = -1.0) -> DataFrame:
    """Exact ``k`` most similar rows of the same domain for each query, by cosine, smaller id first on ties; and ``rescue`` of all domains.

    Rows under ``floor`` (or, of the rescue, ``rescue_floor``) are left out. The query set is stated and met with all rows;
    per task only the best rows of a query are kept ahead of the shuffle by the ranking limit.
    """
    q = queries.select(F.col(vec_id).alias("query_id"), F.col(domain).alias("__d"), F.col(embedding).alias("__q"))

    def best(on, k: int, floor: float | None) -> DataFrame:
        pairs = rows.join(q, on & (F.col(vec_id) != F.col("query_id")))
        scored = pairs.select("query_id", F.col(vec_id).alias("neighbour_id"), F.round(cosine(F.col("__q"), F.col(embedding)), 6).alias("score")).where("score is not null")
        scored = scored if floor is None else scored.where(F.col("score") >= floor)
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "neighbour_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    own = best(F.col(domain) == F.col("__d"), k, floor)
    if not rescue:
        return own
    every = best(F.lit(True), rescue, rescue_floor).join(own.select("query_id", "neighbour_id"), ["query_id", "neighbour_id"], "left_anti")
    return own.unionByName(every.withColumn("rank", F.lit(None).cast("int")))


def merge_candidates(df: DataFrame, keys: Sequence[str], score: str, sources: str) -> DataFrame:
    """One row a pair: its best score and the sorted set of all its sources."""
    return df.groupBy(*keys).agg(F.max(score).alias(score), F.array_sort(F.array_distinct(F.flatten(F.collect_list(sources)))).alias(sources))


def validated_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails at run time if ``key`` repeats on the right."""
    once = right.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    checked = once.withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string")))).otherwise(F.lit("")))
    return left.join(checked.where("__ok = ''").drop("__n", "__ok"), key, "left")


def exhaustive_groups(members: DataFrame, group: str, member: str, declared: DataFrame, declared_members: str, least: int) -> DataFrame:
    """Groups whose members are exactly the declared ones, with at least ``least`` of them."""
    seen = members.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("__seen"))
    return declared.join(seen, group).where((F.col("__seen") == F.array_sort(F.array_distinct(declared_members))) & (F.size("__seen") >= least)).drop("__seen")
