"""Every query of the core library, with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessarine.plans import inventory, preparation, relational, signatures, streams  # noqa: F401 (they register their queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**relational.QUERIES, **preparation.QUERIES}
ORACLE_SQL: dict[str, str] = {**relational.ORACLE_SQL}
FLAGSHIP = "j1_depth_fill"
