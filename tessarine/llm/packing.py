"""Filling containers of fixed capacity with documents, measured in tokens.

Conflict-constrained best fit: items go, duplicate clusters and then the largest first, into the container with the least room that
still takes them. Open containers are ordered by what room they have left; each carries a bitmap of the
sources and one of the duplicate clusters it holds, and the successor search goes on from the tightest
container until a compatible one is found. No container holds two members of a duplicate cluster, unless
the cluster has more members than all items together need containers; then each may hold that many times as
many, and no more. A container is opened rather than the rule broken.

Documents are dealt to shards by a hash of their id; shards are packed independently of one another and
of the size of the corpus, and each leaves at most one container poorly filled per kind of conflict.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm import duplicates, encoding

#: Documents that are packed together by one task.
SHARD_DOCS = 20_000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, conflicts: Mapping[int, int] | None = None) -> list[tuple[int, int, int, int]]:
    """(item, piece, tokens, container) for every item; containers are numbered from 0.

    Only an item larger than ``capacity`` is divided: into full containers and a rest that is packed
    like any other item. ``conflicts`` gives, by source bit number, the bitmap of sources that may not
    share a container with it.
    """
    conflicts = conflicts or {}
    out: list[tuple[int, int, int, int]] = []
    opened = 0
    items: list[tuple[int, int, int, int]] = []
    for k, size in enumerate(sizes):
        piece = 0
        while size > capacity:
            out.append((k, piece, capacity, opened))
            opened, piece, size = opened + 1, piece + 1, size - capacity
        items.append((size, clusters[k], k, piece))
    members = Counter(c for size, c, _, _ in items if size)  # texts without tokens are copies of nothing
    least = max(1, math.ceil(sum(i[0] for i in items) / capacity))
    # Bits only for clusters that have copies; several copies a container where there are too few of them.
    bit = {c: n for n, c in enumerate(c for c, m in members.items() if m > 1)}
    layers = {c: math.ceil(members[c] / least) for c in bit}
    # Clusters go first, the largest ones ahead, while containers still have room; then the largest of the other items.
    spread = {c: -m for c, m in members.items() if m > 1}
    items.sort(key=lambda i: (spread.get(i[1], 0) if i[0] else 0, -i[0], i[1], i[2]))
    order: list[tuple[int, int]] = []  # (room left, container), ascending
    holds: dict[int, list[int]] = {}  # container -> [sources, cluster bitmap of each layer...]
    last: tuple[int, int] | None = None
    at = 0
    for size, cluster, k, piece in items:
        source, own = 1 << sources[k], bit.get(cluster) if size else None
        barred = conflicts.get(sources[k], 0)
        # Copies of one size come in a row: containers before the last one's place are known not to take them.
        begin = bisect.bisect_left(order, (size, -1))
        skipped = own is not None and last == (cluster, size) and not conflicts and at > begin
        if skipped:
            begin = at
        found = None
        for j in range(begin, len(order)):
            held = holds[order[j][1]]
            if held[0] & barred:
                continue
            if own is None or len(held) <= layers[cluster] or any(not layer >> own & 1 for layer in held[1 : 1 + layers[cluster]]):
                found = j
                break
        if found is None:
            room, box = capacity, opened
            opened += 1
            holds[box] = [0, 0]
            place = len(order)
        else:
            room, box = order.pop(found)
            place = found
        held = holds[box]
        held[0] |= source
        if own is not None:
            layer = next((n for n in range(1, len(held)) if not held[n] >> own & 1), len(held))
            if layer == len(held):
                held.append(0)
            held[layer] |= 1 << own
        bisect.insort(order, (room - size, box))
        # It moved left of its old place; if it takes no further copy, the search for the next one goes on there.
        full = own is not None and len(held) > layers[cluster] and all(layer >> own & 1 for layer in held[1:])
        at = place + 1 if found is not None and full and size > 0 else 0
        last = (cluster, size)
        out.append((k, piece, size, box))
    return out


def pack(df: DataFrame, budgets: Iterable[tuple[int, int]], doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = encoding.TOKENIZER, shard_docs: int = SHARD_DOCS, apart: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """A container for every document under every budget (id, capacity in tokens).

    Returns budget_id, container_id, ``doc_id``, piece (0 unless the text is longer than the capacity)
    and tokens. Null and empty texts have no tokens and get a container all the same. Texts that share four
    fifths of their shingles of five words, directly or over others, form a duplicate cluster (``duplicates``); ``apart``
    names pairs of sources that must not share a container. Repeated rows are copies of one another. Documents with a null id are
    packed with that id. Other columns are never read. An empty table gives an empty result.
    """
    budgets = [(int(b), int(c)) for b, c in budgets]
    if any(c < 1 for _, c in budgets):
        raise ValueError("capacities must be positive")
    pairs = [(a, b) for a, b in apart]
    kind = dict(df.dtypes)[doc_id]
    shards = max(1, math.ceil(df.count() / shard_docs))
    keyed = df.select(F.struct(F.col(doc_id).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.xxhash64(duplicates.form(F.col(text))).alias("form_id")).alias("k"), F.col(text).alias("t"))
    counted = encoding.encode_corpus(keyed, doc_id="k", text="t", path=path).select("k.id", "k.source", "k.form_id", F.size("ids").alias("tokens"))
    near = duplicates.clusters(df.select(F.xxhash64(duplicates.form(F.col(text))).alias("form_id"), duplicates.form(F.col(text)).alias("form")))
    counted = counted.join(near, "form_id", "left").select("id", "source", F.coalesce("cluster", "form_id").alias("cluster"), "tokens")
    # The tokens join the hash, so that a null or repeated id cannot gather in one shard.
    items = counted.select(
        F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")) for b, c in budgets])).alias("budget"),
        F.pmod(F.xxhash64("id", "cluster"), F.lit(shards)).cast("int").alias("shard"), "id", "source", "cluster", "tokens",
    ).select("budget.b", "budget.c", "shard", "id", "source", "cluster", "tokens")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "cluster", "id"], kind="stable").reset_index(drop=True)
        names, codes = {}, []
        for s in group["source"]:
            codes.append(names.setdefault(s, len(names)))
        barred: dict[int, int] = {}
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if x in names and y in names:
                    barred[names[x]] = barred.get(names[x], 0) | 1 << names[y]
        placed = best_fit(group["tokens"].tolist(), codes, group["cluster"].tolist(), int(group["c"].iloc[0]), barred)
        rows = [p[0] for p in placed]
        base = int(group["shard"].iloc[0]) << 32
        return pd.DataFrame({
            "budget_id": group["b"].iloc[0], "container_id": [base + p[3] for p in placed], "doc": group["id"].take(rows).to_numpy(),
            "piece": [p[1] for p in placed], "tokens": [p[2] for p in placed],
        })

    out = items.groupBy("b", "shard").applyInPandas(one, f"budget_id int, container_id bigint, doc {kind}, piece int, tokens int")
    return out.withColumnRenamed("doc", doc_id)
