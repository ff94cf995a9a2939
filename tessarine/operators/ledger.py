"""Running state over ordered events: fills, balances, draw-downs, crossings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine.operators.linkage import null_safe_join
from tessarine.session import slots


#: Rows from which on the rows of one key are walked in stretches.
HOT_ROWS = 1_000_000


def _search(at: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """How many of the sorted ``cuts`` are under ``at``, by halving them."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(at > F.lit(cuts[middle]), _search(at, cuts[middle + 1 :], first + middle + 1)).otherwise(_search(at, cuts[:middle], first))


def stretches(df: DataFrame, keys: Sequence[str], at: str, parts: int | None = None, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with ``__b``, and whether any key is hot: the stretch of the numeric column ``at`` that a row lies in; 0 for all rows of keys with up to ``hot_rows`` rows.

    Keys are counted first. Where none is hot nothing else is computed. The cuts are quantiles of the rows
    of the hot keys, and literals, so that every recomputation gives the same stretches.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows)
    most = hot.agg(F.max("__n"), F.sum("__n")).first()
    if most[0] is None:
        return df.withColumn("__b", F.lit(0)), False
    parts = parts or max(2 * slots(df.sparkSession), math.ceil(most[1] / hot_rows))
    marked = null_safe_join(df, hot.select(*keys, F.lit(True).alias("__hot")), keys, "left")
    cuts = sorted(set(marked.where("__hot").approxQuantile(at, [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    return marked.withColumn("__b", F.when(F.col("__hot"), F.coalesce(_search(F.col(at), cuts), F.lit(-1))).otherwise(0)).drop("__hot"), True


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], at: str, amount: str, out: str, peak: str | None = None, parts: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the running sum of ``amount`` (``out``) and, if asked for, its running maximum (``peak``).

    ``at`` is the numeric column that ``order`` starts with. A key that holds a third of all rows would
    bring them into one task; instead each stretch of a hot key is summed on its own, and the sums of the
    stretches before it (at most ``parts`` a key) are added. Nulls are skipped; sums are null before the
    first value.
    """
    held, split = stretches(df, keys, at, parts, hot_rows)
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("__run", F.sum(amount).over(inside)).withColumn("__top", F.max("__run").over(inside))
    if not split:
        held = held.withColumn(out, F.col("__run"))
        return (held.withColumn(peak, F.col("__top")) if peak else held).drop("__b", "__run", "__top")
    sums = held.groupBy(*keys, "__b").agg(F.sum(amount).alias("__sum"), F.max("__run").alias("__most"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__offset", F.sum("__sum").over(before))
    sums = sums.withColumn("__peak", F.max(F.coalesce("__offset", F.lit(0.0)) + F.col("__most")).over(before))
    joined = null_safe_join(held, sums.select(*keys, "__b", "__offset", "__peak"), [*keys, "__b"])
    plus = lambda c: F.coalesce(F.col("__offset") + F.col(c), F.col(c), F.col("__offset"))
    joined = joined.withColumn(out, plus("__run"))
    if peak:
        joined = joined.withColumn(peak, F.greatest("__peak", plus("__top")))
    return joined.drop("__b", "__run", "__top", "__offset", "__peak")


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, value: str, out: str, parts: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``out``: ``value`` of the row before of the same key. Hot keys are walked in stretches of the numeric column ``at``."""
    held, split = stretches(df, keys, at, parts, hot_rows)
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    if not split:
        return held.withColumn(out, F.lag(value).over(inside)).drop("__b")
    held = held.withColumns({out: F.lag(value).over(inside), "__first": F.row_number().over(inside) == 1})
    last = held.groupBy(*keys, "__b").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b")))
    joined = null_safe_join(held, carried.select(*keys, "__b", "__carried"), [*keys, "__b"], "left")
    return joined.withColumn(out, F.when(F.col("__first"), F.col("__carried.v")).otherwise(F.col(out))).drop("__b", "__first", "__carried")


def depth_fill(levels: DataFrame, book: str, price: str, size: str, ties: Sequence[str], quantities: Sequence[float], descending: bool = False) -> DataFrame:
    """Cost of taking fixed quantities from the cheapest (or, descending, dearest) levels of every book.

    Returns ``book``, quantity, filled, cost, worst (the highest price taken) and levels; levels of one
    price follow ``ties``. The room before a level is a running sum that serves all quantities; levels
    beyond the largest one are dropped before they are aggregated. Levels with a null or non-positive
    price or size take no part.
    """
    usable = levels.where((F.col(price) > 0) & (F.col(size) > 0)).withColumn("__at", -F.col(price) if descending else F.col(price))
    usable = running(usable, [book], ["__at", *ties], "__at", size, "__until").withColumn("__before", F.col("__until") - F.col(size))
    need = usable.where(F.col("__before") < max(quantities)).withColumn("quantity", F.explode(F.array(*[F.lit(float(q)) for q in quantities])))
    take = F.least(F.col(size), F.col("quantity") - F.col("__before"))
    met = need.where(F.col("quantity") > F.col("__before")).withColumn("__take", take)
    return met.groupBy(book, "quantity").agg(
        F.sum("__take").alias("filled"), F.round(F.sum(F.col("__take") * F.col(price)), 7).alias("cost"), F.max(price).alias("worst"), F.count("*").alias("levels")
    )


def running_balance(df: DataFrame, key: str, order: Sequence[str], at: str, amount: str) -> DataFrame:
    """Adds balance, peak (running maximum) and drawdown (peak minus balance) of ``amount`` for every key."""
    held = running(df, [key], order, at, amount, "balance", "peak")
    return held.withColumns({c: F.round(c, 4) for c in ("balance", "peak")}).withColumn("drawdown", F.round(F.col("peak") - F.col("balance"), 4))


def first_crossing(df: DataFrame, key: str, order: Sequence[str], amount: str, at: str, level: float) -> DataFrame:
    """For every key the first ``at`` at which the running sum of ``amount`` reaches ``level``; null if never."""
    held = running(df, [key], order, at, amount, "__total")
    return held.groupBy(key).agg(F.min(F.when(F.col("__total") >= level, F.col(at))).alias("crossed_at"), F.count("*").alias("rows_seen"))


def replenished(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, amount: str, share: float, least: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose ``amount`` grew on the row before of the same key by at least ``max(least, share * before)``."""
    seen = previous(df, keys, order, at, amount, "previous", hot_rows=hot_rows)
    return seen.where(F.col(amount) - F.col("previous") >= F.greatest(F.lit(least), F.col("previous") * share))


def sessions(df: DataFrame, key: str, at: str, tie: str, gap: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds session_no: rows of a key that follow the row before within ``gap`` seconds share a session."""
    seen = previous(df, [key], [at, tie], at, at, "__before", hot_rows=hot_rows)
    fresh = F.when(F.col("__before").isNull() | (F.col(at) - F.col("__before") > gap), 1).otherwise(0)
    numbered = running(seen.withColumn("__new", fresh), [key], [at, tie], at, "__new", "session_no", hot_rows=hot_rows)
    return numbered.withColumn("session_no", F.col("session_no").cast("bigint")).drop("__new", "__before")


def fresh_fills(trades: DataFrame, probes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(probe_id, filled_at, kind) of the probes that a tape of trades fills.

    ``trades``: trade_id, book, side, at, price, size, block; ``probes``: probe_id, book, side, placed_at, price, queue,
    quantity, until (numeric times). Block trades, repeated trade ids, trades of the other side, and trades before a probe was placed
    or after it ended do not count. A trade at a better price (lower, for a bid) fills at once; trades at its very price
    fill it once they add up to its queue and quantity. Probes that are not filled are left out.
    """
    once = trades.where("trade_id is not null and not coalesce(block, false)").dropDuplicates(["trade_id"])
    met = once.join(probes.withColumnsRenamed({"price": "bid"}), ["book", "side"]).where("at > placed_at and at <= until and price <= bid")
    through = met.where("price < bid").groupBy("probe_id").agg(F.min("at").alias("through_at"))
    held = running(met.where("price = bid"), ["probe_id"], ["at", "trade_id"], "at", "size", "__sum", hot_rows=hot_rows)
    queued = held.where(F.col("__sum") >= F.col("queue") + F.col("quantity")).groupBy("probe_id").agg(F.min("at").alias("queue_at"))
    both = through.join(queued, "probe_id", "full_outer")
    first = F.least("through_at", "queue_at")
    return both.select("probe_id", first.alias("filled_at"), F.when(F.col("through_at") == first, "through").otherwise("queue").alias("kind"))
