"""Order books as arrays of levels: parsing, complements, best quotes, exact cost of a quantity, and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarine.operators import ledger

LEVEL = "struct<price:double,size:double>"


def parsed_levels(text: Column) -> Column:
    """Levels of a JSON list of ``[price, size]`` pairs of numbers in text; pairs that are no numbers are dropped."""
    pairs = F.from_json(text, "array<array<string>>")
    levels = F.transform(pairs, lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("price"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("size")))
    return F.filter(levels, lambda x: x["price"].isNotNull() & x["size"].isNotNull())


def ladder(levels: Column, complement: bool = False, descending: bool = False) -> Column:
    """Levels with a price between 0 and 1 and a positive size, in order of price; ``complement`` turns p into 1 - p first."""
    turned = F.transform(levels, lambda x: F.struct(F.round(1 - x["price"], 10).alias("price"), x["size"].alias("size"))) if complement else levels
    kept = F.array_sort(F.filter(turned, lambda x: (x["price"] > 0) & (x["price"] < 1) & (x["size"] > 0)))
    return F.reverse(kept) if descending else kept


def cost_of(levels: Column, quantity: Column) -> Column:
    """Cost of ``quantity`` from the levels in their order; null where they do not hold it (up to 1e-9)."""
    start = F.struct(quantity.cast("double").alias("left"), F.lit(0.0).alias("cost"))

    def take(state: Column, level: Column) -> Column:
        got = F.least(state["left"], level["size"])
        return F.struct((state["left"] - got).alias("left"), (state["cost"] + got * level["price"]).alias("cost"))

    return F.aggregate(levels, start, take, lambda s: F.when(s["left"] <= 1e-9, s["cost"]))


def implied_quotes(bids: DataFrame, book: str, side: str, price: str, size: str) -> DataFrame:
    """For each book the best yes and no bid, and the ask of each side that the other side's bid implies.

    ``bids`` has one level a row; ``side`` is 'yes' or 'no'. An ask is one minus the best bid of the other side,
    to four digits, with that bid's size. Levels without a positive price and size take no part.
    """
    usable = bids.where((F.col(price) > 0) & (F.col(size) > 0))
    best = lambda s: F.max(F.when(F.col(side) == s, F.struct(F.col(price).alias("p"), F.col(size).alias("q"))))
    held = usable.groupBy(book).agg(best("yes").alias("y"), best("no").alias("n"))
    ask = lambda c: F.round(1 - F.col(f"{c}.p"), 4)
    return held.select(
        book, F.col("y.p").alias("yes_bid"), F.col("y.q").alias("yes_bid_size"), F.col("n.p").alias("no_bid"), F.col("n.q").alias("no_bid_size"),
        ask("n").alias("yes_ask"), F.col("n.q").alias("yes_ask_size"), ask("y").alias("no_ask"), F.col("y.q").alias("no_ask_size"),
    )


def filled_costs(levels: DataFrame, book: str, price: str, size: str, ties: Sequence[str], quantities: Sequence[float]) -> DataFrame:
    """``book``, quantity and cost for each book and quantity; cost is null where the book does not hold the quantity (up to 1e-9)."""
    fills = ledger.depth_fill(levels, book, price, size, ties, quantities)
    return fills.select(book, "quantity", F.when(F.col("filled") >= F.col("quantity") - 1e-9, F.col("cost")).alias("cost"))


def snapshots(requests: DataFrame, book: str, order: str, books: DataFrame) -> DataFrame:
    """One row for each book that is asked for, at its first place in ``order``, with the levels of ``books`` or a reason why not."""
    asked = requests.where(F.col(book).isNotNull()).groupBy(book).agg(F.min(order).alias("first_place"), F.count("*").alias("requests"))
    held = books.select(F.col(book), F.lit(True).alias("__there"), *[c for c in books.columns if c != book])
    return asked.join(held, book, "left").withColumn("failure", F.when(F.col("__there").isNull(), "not_found")).drop("__there")
