"""Readers and writers for venue feeds, caches and run tables, with explicit schemas."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessarine.sources import files

LEVELS = T.ArrayType(T.StructType([T.StructField("price", T.DoubleType()), T.StructField("size", T.DoubleType())]))
LEFT_MARKET = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("ticker", "title", "subtitle", "event_ticker", "category", "status", "close_time", "rules_primary", "rules_secondary")],
    *[T.StructField(c, T.DoubleType()) for c in ("yes_bid_dollars", "yes_ask_dollars", "volume_fp", "volume_24h_fp")],
])
TRADE = T.StructType([
    T.StructField("trade_id", T.StringType()), T.StructField("ticker", T.StringType()), T.StructField("created_time", T.StringType()),
    T.StructField("yes_price_dollars", T.DoubleType()), T.StructField("count_fp", T.DoubleType()), T.StructField("taker_side", T.StringType()), T.StructField("is_block_trade", T.BooleanType()),
])


class PageFile(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


def _rows(path: str, items: str, schema: T.StructType) -> Iterator[tuple]:
    """Rows of one page: a JSON object that holds its rows under ``items``, or a list of rows."""
    with open(path, encoding="utf-8") as page:
        body = json.load(page)
    for one in body.get(items) or [] if isinstance(body, dict) else body:
        yield tuple(_coerced(one.get(f.name), f.dataType) for f in schema.fields)


def _coerced(value, kind: T.DataType):
    """The value in its type; what does not fit becomes null."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.DoubleType):
            return float(value)
        if isinstance(kind, T.LongType):
            return int(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else str(value).lower() == "true"
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else json.dumps(value)
    except (TypeError, ValueError):
        return None
    return value


def _pages(folder: str) -> list[str]:
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".json"))


class PagedFeed(DataSource):
    """Recorded pages of a paginated feed: ``spark.read.format("paged_feed")``, one partition a page.

    Options: ``path`` (folder of page files that all executors see), ``items`` (name of the list in a
    page). The schema has to be given. As a stream, pages come in the order in which they were written.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> PagedStream:  # noqa: N802
        return PagedStream(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        self.folder, self.items, self.schema = options["path"], options.get("items", "items"), schema

    def partitions(self) -> Sequence[InputPartition]:
        return [PageFile(p, k) for k, p in enumerate(_pages(self.folder))]

    def read(self, partition: PageFile) -> Iterator[tuple]:
        return _rows(partition.path, self.items, self.schema)


class PagedStream(DataSourceStreamReader):
    """Pages in the order in which they arrive: by time of writing, then by name. Each is read once, whatever its name."""

    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        self.folder, self.items, self.schema = options["path"], options.get("items", "items"), schema

    def _arrived(self) -> list[tuple[int, str, str]]:
        return sorted((os.stat(p).st_mtime_ns, os.path.basename(p), p) for p in _pages(self.folder))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"written": 0, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        pages = self._arrived()
        return {"written": pages[-1][0], "name": pages[-1][1]} if pages else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = ((o["written"], o["name"]) for o in (start, end))
        return [PageFile(p, k) for k, (written, name, p) in enumerate(self._arrived()) if first < (written, name) <= last]

    def read(self, partition: PageFile) -> Iterator[tuple]:
        return _rows(partition.path, self.items, self.schema)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make the feed formats known to a session."""
    spark.dataSource.register(PagedFeed)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; rows that do not parse are kept in ``_corrupt``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a fixed schema; numbers that do not parse are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def tidy_quotes(levels: str, side: str) -> F.Column:
    """Best price and size of a ladder: the lowest ask, or the highest bid; null for an empty ladder."""
    usable = F.filter(F.col(levels), lambda x: (x["price"] > 0) & (x["size"] > 0))
    return F.array_min(usable) if side == "ask" else F.array_max(usable)


def ordered_tokens(ids: str, outcomes: str) -> F.Column:
    """Token ids of a JSON list, with those of a Yes/No market as [yes, no]."""
    tokens, names = F.from_json(ids, "array<string>"), F.transform(F.from_json(outcomes, "array<string>"), lambda x: F.lower(F.trim(x)))
    flipped = (F.size(tokens) == 2) & (names == F.array(F.lit("no"), F.lit("yes")))
    return F.when(flipped, F.reverse(tokens)).otherwise(tokens)


class Cache:
    """A last-known-good table: versions in a folder, and a pointer that is replaced at once.

    A refresh that is empty or much smaller than what is there is refused, and readers never see a half
    written version.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self) -> str:
        return f"{self.folder}/CURRENT"

    def read(self, ttl_seconds: float | None = None, allow_stale: bool = False) -> DataFrame | None:
        """The current version, or None if there is none or it is older than ``ttl_seconds`` and not allowed to be."""
        if not files.exists(self.spark, self._pointer()):
            return None
        if ttl_seconds is not None and not allow_stale and files.age_seconds(self.spark, self._pointer()) > ttl_seconds:
            return None
        return self.spark.read.parquet(f"{self.folder}/{files.read_text(self.spark, self._pointer()).strip()}")

    def refresh(self, df: DataFrame, key: str, order: Sequence[F.Column], least_share: float = 0.5) -> bool:
        """Write ``df``, one row a key (last in ``order``), unless it has under ``least_share`` of the rows there."""
        from tessarine.operators.ranking import keep_one

        version = f"v-{uuid.uuid4().hex}"
        keep_one(df, [key], order).write.parquet(f"{self.folder}/{version}")
        fresh = self.spark.read.parquet(f"{self.folder}/{version}").count()
        old = self.read()
        if fresh == 0 or (old is not None and fresh < least_share * old.count()):
            return False
        files.replace_text(self.spark, self._pointer(), version)
        return True


def append_run(df: DataFrame, folder: str, run_id: str, columns: Sequence[str]) -> None:
    """Append a fixed projection of ``df`` to a run table, partitioned by run."""
    have = set(df.columns)
    picked = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*picked, F.lit(run_id).alias("run_id")).write.mode("append").partitionBy("run_id").parquet(folder)


def write_watchlist(df: DataFrame, path: str, order: Sequence[F.Column], size: int, schema_tag: str) -> int:
    """The first ``size`` rows in ``order`` as one versioned JSON document, replaced at once. A report of fixed size."""
    rows = [json.loads(r) for r in df.orderBy(*order).limit(size).toJSON().collect()]
    files.replace_text(df.sparkSession, path, json.dumps({"schema": schema_tag, "rows": rows}))
    return len(rows)


def read_watchlist(spark: SparkSession, path: str, schema: T.StructType, schema_tag: str) -> DataFrame:
    """The rows of a watch list; fails on another version, or where its rows are no list."""
    held = json.loads(files.read_text(spark, path))
    if not isinstance(held, dict) or held.get("schema") != schema_tag or not isinstance(held.get("rows"), list):
        raise ValueError(f"{path} is no watch list of version {schema_tag}")
    return spark.createDataFrame([tuple(_coerced(r.get(f.name), f.dataType) for f in schema.fields) for r in held["rows"]], schema)


def append_rows(df: DataFrame, path: str, columns: Sequence[str], kind: str) -> None:
    """Append a fixed projection as 'csv' (with a header) or 'json' lines; missing columns are null, others are left out."""
    have = set(df.columns)
    picked = df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])
    writer = picked.write.mode("append")
    (writer.option("header", True).csv(path) if kind == "csv" else writer.json(path))


def write_run_tables(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], folder: str, run_id: str) -> list[str]:
    """Append each table of a run under its own name, with the projection that is stated for it."""
    for name, (df, columns) in tables.items():
        append_run(df, f"{folder}/{name}", run_id, columns)
    return sorted(tables)


def summary_sections(audit: DataFrame, verdict: str, reasons: str, top: int) -> DataFrame:
    """section, name and n: rows of each verdict, and the ``top`` most frequent reasons. A report of fixed size."""
    verdicts = audit.groupBy(F.col(verdict).alias("name")).agg(F.count("*").alias("n")).withColumn("section", F.lit("verdict"))
    said = audit.select(F.explode(reasons).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return verdicts.unionByName(said.orderBy(F.col("n").desc(), "name").limit(top).withColumn("section", F.lit("reason"))).select("section", "name", "n")
