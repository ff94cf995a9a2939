"""Clusters of near-duplicate texts: an exact similarity join over shingles of five words.

Texts are compared by their form (lower case, white space collapsed), each distinct form once. The shingles of a form are
put in one order for all forms, rare ones first. Two forms whose Jaccard similarity reaches the threshold have a first common
shingle in that order, and it stands so far ahead in both that what follows it can still make up the wanted overlap; so only
the head of each form is indexed, and every pair that meets there with enough left behind it is verified by the exact
similarity of the shingle sets. No pair that reaches the threshold is left out but within a cluster: the members of a shingle
meet the eight smallest first, and then all others that are not in one cluster by those links. Clusters are the components
of the verified links.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarine.session import materialise, spread

#: Words of a shingle; similarity of near duplicates; forms of a shingle that all others of it meet first.
WORDS, LIKE, MET = 5, 0.8, 8
#: Bits of a shingle that tell its bucket in the counts of how common shingles are; what rounding may take from a whole number; postings of a batch.
BUCKET_BITS, EPS, BATCH = 20, 1e-6, 1_000_000


def form(text: Column) -> Column:
    """What of a text is compared: lower case, white space collapsed; '' for null."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


class _Words(dict):
    """A random 64-bit number for each word; forgets all when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


_WORDS = _Words()


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the runs of five words of a form; a shorter text is one shingle."""
    words = text.split(" ")
    codes = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    if len(codes) < WORDS:
        codes = np.concatenate([codes, np.zeros(WORDS - len(codes), dtype=np.uint64)])
    out = np.zeros(len(codes) - WORDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            out = (out ^ codes[k : len(codes) - WORDS + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


@functools.lru_cache(maxsize=8)
def _recent(text: str) -> np.ndarray:
    """Shingles of a form; pairs of one form follow one another."""
    return shingles(text)


def similarity(a: str, b: str) -> float:
    """Exact Jaccard similarity of the shingle sets of two forms."""
    x, y = shingles(a), _recent(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _rarity(forms: DataFrame) -> np.ndarray:
    """How common the shingles of each bucket are, on a logarithmic scale; it orders shingles, and any order gives the same pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(sums, (shingles(t) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["bucket", "n"])

    # At most 2^20 rows, whatever the size of the table.
    counted = spread(forms.where("form != ''").select("form")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(1 << BUCKET_BITS, dtype=np.uint8)
    rarity[counted.column("bucket").to_numpy()] = np.round(4 * np.log2(1 + counted.column("n").to_numpy()))
    return rarity


def clusters(forms: DataFrame, like: float = LIKE) -> DataFrame:
    """(form_id, cluster) of every distinct form that has a near duplicate; forms without one are left out.

    ``forms``: form_id bigint (a hash of the form) and form string, repeated as they are. The cluster is the smallest form_id
    in it. Empty forms are near duplicates of nothing. An empty table gives an empty result.
    """
    rarity = _rarity(forms)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held = [], [], 0

        def out() -> pa.RecordBatch:
            kept = [len(k) for k, _ in keys]
            columns = [
                np.repeat(np.array(ids, dtype=np.int64), kept), np.concatenate([k for k, _ in keys]).view(np.int64),
                np.repeat(np.array([n for _, n in keys], dtype=np.int32), kept), np.concatenate([np.arange(n, dtype=np.int32) for n in kept]),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["form_id", "key", "size", "pos"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = shingles(t)
                n = len(found)
                order = np.lexsort((found, rarity[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
                head = found[order[: n - math.ceil(like * n - EPS) + 1]]
                ids.append(i)
                keys.append((head, n))
                held += len(head)
                if held >= BATCH:
                    yield out()
                    ids, keys, held = [], [], 0
        if ids:
            yield out()

    # Texts stay where they are read: postings of equal forms are equal, and only those are shuffled.
    posted = spread(forms.where("form != ''").select("form_id", "form")).mapInArrow(post, "form_id bigint, key bigint, size int, pos int")
    posted = posted.groupBy("key", "form_id").agg(F.min("size").alias("size"), F.min("pos").alias("pos"))
    # The smaller form of a pair has the shared shingle yet further ahead.
    posted = posted.withColumn("ahead", F.col("pos") <= F.col("size") - F.ceil(F.lit(2 * like / (1 + like)) * F.col("size") - EPS))
    postings = materialise(_crowded(posted))
    other = [F.col(c).alias(f"o_{c}") for c in ("form_id", "size", "pos")]
    wanted = F.ceil(F.lit(like / (1 + like)) * (F.col("size") + F.col("o_size")) - EPS)
    reach = F.least(F.col("size") - F.col("pos"), F.col("o_size") - F.col("o_pos")) >= wanted
    pair = [F.greatest("form_id", "o_form_id").alias("form_id"), F.least("form_id", "o_form_id").alias("rep")]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(x, y) >= like for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["form_id", "rep", "ok"])

    def judged(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs)
        # The texts that have to be compared are few; they are looked up once.
        ids = pairs.select("form_id").unionByName(pairs.select(F.col("rep").alias("form_id"))).distinct()
        texts = materialise(forms.join(ids, "form_id", "left_semi").dropDuplicates(["form_id"]).select("form_id", "form"))
        drawn = pairs.join(texts, "form_id").join(texts.select(F.col("form_id").alias("rep"), F.col("form").alias("other")), "rep").select("form_id", "rep", "form", "other")
        return materialise(drawn.mapInArrow(verify, "form_id bigint, rep bigint, ok boolean"))

    place = F.row_number().over(Window.partitionBy("key").orderBy("form_id"))
    reps = postings.where("ahead").withColumn("k", place).where(F.col("k") <= MET).select("key", *other)
    first = judged(postings.join(reps, "key").where((F.col("form_id") != F.col("o_form_id")) & reach).select(*pair).distinct())
    links = first.where("ok").select("form_id", "rep")
    labels = components(links)
    # Shingles with more forms than have met all others, and with more than one cluster: whatever is not linked by now meets.
    named = postings.join(labels, "form_id", "left").withColumn("cluster", F.coalesce("cluster", "form_id"))
    mixed = named.groupBy("key").agg(F.sum(F.col("ahead").cast("int")).alias("n"), F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    named = named.join(mixed.where((F.col("n") > MET) & (F.col("low") != F.col("high"))).select("key"), "key")
    smaller = named.where("ahead").select("key", F.col("cluster").alias("o_cluster"), *other)
    apart = (F.col("cluster") != F.col("o_cluster")) & (F.struct("size", "form_id") > F.struct("o_size", "o_form_id"))
    rest = named.join(smaller, "key").where(apart & reach).select(*pair).distinct().join(first.select("form_id", "rep"), ["form_id", "rep"], "left_anti")
    more = judged(rest).where("ok").select("form_id", "rep")
    return labels if more.isEmpty() else components(links.unionByName(more))


def _crowded(rows: DataFrame) -> DataFrame:
    """The rows of shingles that more than one form has, one of them ahead; counts are taken before the join, which may split a hot one."""
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("ahead").alias("any")).where("n > 1 and any").select("key")
    return rows.join(shared, "key")


def components(links: DataFrame) -> DataFrame:
    """(form_id, cluster): the smallest id that each id is linked with over any number of links."""
    edges = materialise(links.unionByName(links.select(F.col("rep").alias("form_id"), F.col("form_id").alias("rep"))).distinct())
    labels = materialise(edges.groupBy("form_id").agg(F.least(F.min("rep"), F.min("form_id")).alias("cluster")))
    while True:
        near = edges.join(labels.select(F.col("form_id").alias("rep"), "cluster"), "rep").groupBy("form_id").agg(F.min("cluster").alias("near"))
        # The label of a label is jumped to as well, so that long chains take few rounds.
        jump = labels.select(F.col("form_id").alias("cluster"), F.col("cluster").alias("far"))
        moved = labels.join(near, "form_id").join(jump, "cluster", "left").select("form_id", F.col("cluster").alias("old"), F.least("cluster", "near", "far").alias("cluster"))
        moved = materialise(moved)
        if moved.where("old != cluster").isEmpty():
            return moved.select("form_id", "cluster")
        labels = moved.select("form_id", "cluster")
