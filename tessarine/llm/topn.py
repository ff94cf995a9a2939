"""Top N items of every group by a mergeable bounded heap.

The partial step runs before the shuffle: each task walks its Arrow batches and keeps, for every
group it meets, a buffer of at most ``n`` distinct items. Only those buffers are shuffled, so a
group that holds a third of the table sends at most ``n`` rows per task. The merge step is the
same comparison over the buffers of one group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task gathers before it shrinks its buffers again; and rows of buffers that it holds on to.
SHRINK_ROWS, HELD_ROWS = 131_072, 524_288


def _codes(frame: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """One integer for each distinct combination of the group columns."""
    code = np.zeros(len(frame), dtype=np.int64)
    for name in names:
        one, values = pd.factorize(frame[name], use_na_sentinel=False)
        code = code * (len(values) + 1) + one
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    return code


def bounded_heap(frame: pd.DataFrame, groups: Sequence[str], n: int) -> pd.DataFrame:
    """The first ``n`` distinct (__s, __t, __i) of every group: highest __s, lowest __t, lowest __i."""
    if frame.empty:
        return frame
    code = _codes(frame, groups)
    score, tie, item = (frame[c].to_numpy() for c in ("__s", "__t", "__i"))
    order = np.lexsort((item, tie, -score, code))
    code, score, tie, item = code[order], score[order], tie[order], item[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (code[1:] != code[:-1]) | (score[1:] != score[:-1]) | (tie[1:] != tie[:-1]) | (item[1:] != item[:-1])
    order, code = order[fresh], code[fresh]
    first = np.ones(len(code), dtype=bool)
    first[1:] = code[1:] != code[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(code)), 0))
    return frame.iloc[order[np.arange(len(code)) - start < n]]


def top_n(df: DataFrame, groups: Sequence[str], score: str, item_id: str, n: int, tie: str | None = None) -> DataFrame:
    """The ``n`` best distinct items of every group.

    Order: ``score`` descending, then ``tie`` ascending (a timestamp or integer, nulls last), then
    ``item_id`` ascending. Returns ``groups``, ``item_id``, ``score`` and ``rank`` (1 is best).

    Rows with a null group column, a null ``item_id``, or a null or NaN score take no part.
    Infinite scores are numbers and take part. A row delivered again (equal score, tie and id in
    its group) counts once. An empty table gives an empty result. Other columns of ``df`` are
    never read, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    kinds = dict(df.dtypes)
    keys = [f"__g{k}" for k in range(len(groups))]
    tied = F.lit(0) if tie is None else F.unix_micros(F.col(tie)) if kinds[tie].startswith("timestamp") and kinds[tie] != "timestamp_ntz" else F.unix_micros(F.col(tie).cast("timestamp")) if kinds[tie] == "timestamp_ntz" else F.col(tie)
    narrow = df.select(
        *[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)],
        F.col(score).cast("double").alias("__s"),
        F.coalesce(tied.cast("long"), F.lit(2**63 - 1)).alias("__t"),
        F.col(item_id).cast("long").alias("__i"),
    ).where(" and ".join(f"{k} is not null" for k in [*keys, "__s", "__i"]) + " and not isnan(__s)")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pd.DataFrame | None = None
        waiting: list[pd.DataFrame] = []
        rows, limit = 0, SHRINK_ROWS
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch.to_pandas())
                rows += batch.num_rows
            if rows >= limit:
                kept = bounded_heap(pd.concat([*([] if kept is None else [kept]), *waiting], ignore_index=True), keys, n)
                waiting, rows, limit = [], 0, max(SHRINK_ROWS, len(kept))
                if len(kept) > HELD_ROWS:  # mostly small groups: the buffers go on to the merge, and others are begun
                    yield from pa.Table.from_pandas(kept, preserve_index=False).to_batches(max_chunksize=65_536)
                    kept, limit = None, SHRINK_ROWS
        if kept is not None or waiting:
            kept = bounded_heap(pd.concat([*([] if kept is None else [kept]), *waiting], ignore_index=True), keys, n)
            table = pa.Table.from_pandas(kept, preserve_index=False)
            yield from table.to_batches(max_chunksize=65_536)

    heaps = narrow.mapInArrow(partial, narrow.schema)
    # Equal items of two heaps share a dense rank, so merging needs no extra deduplication pass.
    order = Window.partitionBy(*keys).orderBy(F.col("__s").desc(), "__t", "__i")
    merged = heaps.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= n)
    one = merged.groupBy(*keys, "rank").agg(F.first("__i").alias("__i"), F.first("__s").alias("__s"))
    return one.select(
        *[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], F.col("__i").alias(item_id), F.col("__s").alias(score), "rank"
    )
