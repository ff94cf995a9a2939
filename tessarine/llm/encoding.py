"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts are cut into overlapping chunks of ``chunk_chars`` characters. Those of one chunk are encoded
where they are read; the chunks of longer ones are spread over the cluster, each is pre-tokenised and its
pieces are encoded on their own. A match of the pre-tokenising pattern depends only on the text from its start
on, so two chunks that share one boundary inside their overlap agree from there on: that is where
they are stitched. A stretch without any shared boundary (one giant word) is pre-tokenised again
from the last certain boundary, so the ids always equal those of the whole text.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: Pieces whose ids a worker remembers, and characters up to which it does.
PIECES, PIECE_CHARS = 100_000, 32
#: Fixed value: the pre-tokenising pattern that belongs to the published vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def tokenizer(path: str = TOKENIZER) -> tiktoken.Encoding:
    """The tokenizer of a rank file, read once in each Python worker."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _splitter() -> regex.Pattern:
    return regex.compile(PATTERN)


def clean(text: str) -> str:
    """Lone surrogates cannot be written as UTF-8 and become the replacement character."""
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def encode(text: str | None, path: str = TOKENIZER) -> list[int]:
    """Ids of one text without special tokens; none for a null or empty text."""
    return tokenizer(path).encode_ordinary(clean(text)) if text else []


def decode(ids: Sequence[int], path: str = TOKENIZER) -> str:
    """The text of ids: their raw bytes joined, then read as UTF-8."""
    return tokenizer(path).decode_bytes(list(ids)).decode("utf-8", "replace")


class _Known(dict):
    """Ids of short pieces, as words come again and again. Forgets all when full."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = tokenizer(path).encode_ordinary

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode(piece)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=4)
def _known(path: str) -> _Known:
    return _Known(path)


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens of ``text``, and its length."""
    return [m.start() for m in _splitter().finditer(text)] + [len(text)]


def chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Start and content of the chunks of ``text``; each runs ``overlap`` into the next."""
    return [(at, text[at : at + size + overlap]) for at in range(0, max(1, len(text)), size)]


def pieces(text: str, last: bool, path: str) -> tuple[list[int], list[int], list[int]]:
    """Boundaries that hold whatever follows the chunk, ids between them, and how many ids each has.

    The final pre-token of a chunk that is not the last may go on in the next one, so it is left out.
    """
    parts, known = _splitter().findall(text), _known(path)
    if not last:
        parts = parts[:-1]
    own = [known[p] for p in parts]
    return [0, *itertools.accumulate(map(len, parts))], [len(o) for o in own], list(itertools.chain.from_iterable(own))


def stitch(parts: list[dict], path: str = TOKENIZER) -> list[int]:
    """Ids of the whole text from its chunks: start, text, cuts, counts, ids, in order."""
    out: list[int] = []
    at = 0  # every boundary before this one is final
    for k, part in enumerate(parts):
        start, cuts = part["start"], part["cuts"]
        begin = bisect.bisect_left(cuts, at - start)
        if at < start or begin == len(cuts) or cuts[begin] != at - start:
            # No boundary shared: read on from the last certain one, until the chunks agree.
            known = {c + start for c in cuts}
            text, base = _text_from(parts, at, start + len(part["text"]))
            again = boundaries(text)
            if k + 1 < len(parts):
                again = again[:-1]
            joined = next((b for b in again[1:] if base + b in known), None)
            upto = again[-1] if joined is None else joined
            for a, b in zip(again, again[1:]):
                if a >= upto:
                    break
                out += tokenizer(path).encode_ordinary(text[a:b])
            at = base + upto
            if joined is None:
                continue
            begin = bisect.bisect_left(cuts, at - start)
        stop = len(cuts) - 1
        if k + 1 < len(parts):
            following = parts[k + 1]
            shared = {c + following["start"] for c in following["cuts"]}
            stop = next((i for i in range(begin, len(cuts)) if cuts[i] + start in shared), len(cuts) - 1)
        skip = sum(part["counts"][:begin])
        out += part["ids"][skip : skip + sum(part["counts"][begin:stop])]
        at = start + cuts[stop]
    return out


def _text_from(parts: list[dict], at: int, end: int) -> tuple[str, int]:
    """The text from ``at`` to ``end``, put together from the chunks that hold it."""
    out, here = [], at
    for i, part in enumerate(parts):
        stop = parts[i + 1]["start"] if i + 1 < len(parts) else part["start"] + len(part["text"])
        stop = min(end, max(stop, part["start"] + len(part["text"])))
        if part["start"] <= here < stop:
            out.append(part["text"][here - part["start"] : stop - part["start"]])
            here = stop
        if here >= end:
            break
    return "".join(out), at


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id`` and ``ids`` (list of int) of every row.

    Null and empty texts get the empty list. A row with a null id keeps its row. Repeated rows stay
    repeated, whatever their length. Other columns are never read. An empty table gives an empty result.
    """
    if not 0 < overlap_chars <= chunk_chars:
        raise ValueError("overlap_chars must be positive and at most chunk_chars")
    kind = dict(df.dtypes)[doc_id]
    base = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    long = F.coalesce(F.length("__text"), F.lit(0)) > chunk_chars

    def short_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [clean(t) if t else "" for t in batch.column(1).to_pylist()]
            ids = bpe.encode_ordinary_batch(texts, num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["__id", "__ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[] for _ in range(5)]
            for k, content in enumerate(batch.column(1).to_pylist()):
                key, whole = _digest(content), chunks(clean(content), chunk_chars, overlap_chars)
                rows += [k] * len(whole)
                for field, values in zip(out, ([key] * len(whole), range(len(whole)), [len(whole)] * len(whole), [w[0] for w in whole], [w[1] for w in whole])):
                    field += values
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["__id", "__key", "__k", "__n", "__start", "__part"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n, text = (batch.column(i).to_pylist() for i in (2, 3, 5))
            made = [pieces(t, i + 1 == of, path) for i, of, t in zip(k, n, text)]
            fields = [batch.column(i) for i in range(6)] + [pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in range(3)]
            yield pa.RecordBatch.from_arrays(fields, [*batch.schema.names, "__cuts", "__counts", "__ids"])

    def join(group: pa.Table) -> pa.Table:
        rows = {r["__k"]: r for r in group.to_pylist()}
        times = group.column("__k").to_pylist().count(0)  # a row that is delivered again brings its first chunk again
        parts = [{"start": r["__start"], "text": r["__part"], "cuts": r["__cuts"], "counts": r["__counts"], "ids": r["__ids"]} for _, r in sorted(rows.items())]
        return pa.table([group.column("__id").take(pa.array([0] * times)), pa.array([stitch(parts, path)] * times, pa.list_(pa.int32()))], names=["__id", "__ids"])

    done = spread(base.where(~long)).mapInArrow(short_ones, f"__id {kind}, __ids array<int>")
    cuts = f"__id {kind}, __key string, __k int, __n int, __start bigint, __part string"
    scattered = base.where(long).mapInArrow(cut, cuts).repartition("__id", "__key", "__k")
    encoded = scattered.mapInArrow(split, cuts + ", __cuts array<int>, __counts array<int>, __ids array<int>")
    joined = encoded.groupBy("__id", "__key").applyInArrow(join, f"__id {kind}, __ids array<int>")
    return done.unionByName(joined).select(F.col("__id").alias(doc_id), F.col("__ids").alias("ids"))


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
