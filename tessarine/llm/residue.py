"""Template residue, filler, error pages and script notices among real texts.

Two positive-unlabelled naive Bayes models are learned by expectation-maximisation on all
records; in each round every task adds up its records, and sums of fixed size reach the driver:

* the *page* model starts from few trusted records: short ones that are little but a status code, a word of
  scripts or errors, or a filler word. The rounds find the others by the words they share with those. It gives
  every passage a log-odds; a record is residue if its passages together speak for it and none of them speaks
  for real content, whatever page chrome stands around them;
* the *slot* model starts from trusted placeholders (a name in template brackets). It decides by the
  words around it whether a bare ``null``, ``None``, ``NaN`` or ``undefined`` is the empty value of a
  program or a word of the sentence. One unfilled slot makes a record residue.

Texts are tokenised once: what the models need of them is kept in the checkpoint folder.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.session import materialise, spread

#: Hash buckets of the words of either model.
BUCKETS = 1 << 18
ROUNDS = 12
#: Posteriors are multiples of this, so that their sums are exact in whatever order they are added.
GRAIN = 2.0**-20
#: Log-odds under which a passage speaks for real content.
CONTENT = -10.0
#: Weight, in words, of the overall word frequencies in the estimate of either class.
BACKGROUND = 300.0
#: Log-odds that a word must reach, while the class is learned, before it speaks for residue.
MARGIN = 0.5
#: Learning ends once the positive class is this many times as large as its trusted part.
DRIFT = 8.0
#: Longer records are not trusted unread, and what trusts them must be this share of them; they may still be found.
TRUST_CHARS, TRUST_SHARE = 150, 0.8

_NAME = r"(?:[A-Za-z][A-Za-z0-9_]*(?:[. ][A-Za-z][A-Za-z0-9_]*){0,3})"
# Ways in which template languages write a slot, by a string that each must contain.
SLOTS = {
    "{": [
        r"\{\{\{?\s*[#/^>&]?\s*(?:if |unless |each )?" + _NAME + r"(?:\s*\|[^{}]*)?\s*\}?\}\}", r"\{%-?\s*[\w. ]+\s*-?%\}",
        r"\{(?:\d+:)?" + _NAME + r"(?::[^{}\s]*)?\}", r"\{\d+\}",
    ],
    "<%": [r"<%[=-]?\s*" + _NAME + r"\s*-?%>"],
    "%": [r"%\(" + _NAME + r"\)[sdfi]", r"%" + _NAME + r"%", r"(?<![\w%])%[sd](?!\w)"],
    "[": [
        r"\[\[\s*" + _NAME + r"\s*\]\]", r"\$\[" + _NAME + r"\]", r"\[(?i:insert|todo:?|enter|your|add|fill in)\s+" + _NAME + r"\]",
        r"\[" + _NAME + r"\s+(?i:here|goes here|tbd)\]", r"\[(?i:object object)\]", r"\[[A-Za-z]+(?:_[A-Za-z]+)+\]",
    ],
    "<<": [r"<<\s*" + _NAME + r"\s*>>"],
    "&lt;": [r"&lt;\s*" + _NAME + r"\s*&gt;"],
    "__": [r"(?<![A-Za-z0-9_])__" + _NAME + r"__"],
    "@@": [r"@@" + _NAME + r"@@"],
    "~": [r"(?<![\w~])~" + _NAME + r"~(?!~)"],
    "|": [r"\|" + _NAME + r"\|(?i:missing)\|"],
}
#: A name in plain angle or square brackets is a slot unless it is markup or a choice.
ANGLE = r"<(" + _NAME + r")>"
MARKUP = set("html head title body center h1 h2 h3 h4 h5 h6 p br hr b i u em strong a div span table tr td th ul ol li img pre code script style meta link form input button".split())
EMPTY_VALUES = r"(?<![A-Za-z0-9_\"'<-])(null|NULL|None|NONE|NaN|NAN|undefined|UNDEFINED|nil|NIL)(?![A-Za-z0-9_\"'>-])"
# What makes a short record trusted to be residue where little else stands in it.
TRUSTED = [
    r"\bjavascript\b", r"\bcookies\b", r"\bcaptcha\b", r"\bhuman\b", r"\bscripts?\b", r"^traceback", r"exception:", r"^\s*file \"[^\"]+\", line", r"\w+error:", r"\berr_[a-z_]+\b", r"\bupstream\b",
    r"^\W*(?:http |error )?[45]\d\d\b", r"\(?(?:code|status|error):? [45]\d\d\b", r"[(\[][45]\d\d\b", r"<title>\s*[45]\d\d\b",
    r"\b(?:error|erreur|fehler|erro)\b", r"エラー", r"\baccess denied\b", r"\bsession (?:has )?expired\b", r"\brate limited\b", r"\bwent wrong\b", r"\bmaintenance\b", r"\bdata received\b", r"\bin your region\b",
    r"\blorem\b", r"\basdf\b", r"\bfoo bar\b", r"\bdummy\b", r"\bplaceholder\b", r"\b(?:your|insert|add) (?:[a-z]+ ){1,4}(?:here|at this spot|below|in this box)\b",
]

_SLOT = {k: re.compile("|".join(f"(?:{s})" for s in every)) for k, every in SLOTS.items()}
_ANGLE, _EMPTY = re.compile(ANGLE), re.compile(EMPTY_VALUES)
_EMPTY_WORDS = EMPTY_VALUES[EMPTY_VALUES.index("(null") + 1 : EMPTY_VALUES.index(")(?!")].split("|")
_TRUST = re.compile("|".join(f"(?:{t})" for t in TRUSTED), re.I)
#: The end of a passage (a line, a sentence, a wide gap or a menu bar), a number, a word, or a sign.
_TOKEN = re.compile(
    r"(?:(?<=[.!?])|(?<=[.!?][)\]\"”]))\s+|[。！？]+\s*|\s*[\r\n]+\s*|\s{2,}|\s[|]\s|\s-\s(?=[a-z])"
    r"|\d+(?:[.,:]\d+)*|[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]|[^\W\d_\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]+|[^\w\s。！？]|_+",
)
_LINES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[\r\n]+|\s{2,}|\s[|]\s")
_AROUND = re.compile(r"[^\W_]+|[^\s\w]")


@functools.lru_cache(maxsize=200_000)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


#: Marks of a feature beside its bucket: one of the first three of its kind in the record, a single word, the last of a passage.
EARLY, WORD, LAST = 1 << 18, 1 << 19, 1 << 20
_SIGN = 1 << 21


class _Codes(dict):
    """The bucket of each token, -1 for the end of a passage. Forgets all when full."""

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first.isspace() or first in "。！？":
            code = -1
        elif first.isdecimal():
            code = _bucket("<code>" if len(token) == 3 and first in "45" else "<num>")
        else:
            code = _bucket(token) if first.isalpha() else _bucket(first) | _SIGN
        if len(self) >= 200_000:
            self.clear()
        self[token] = code
        return code


_CODES = _Codes()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts (bucket and marks) in order, and how many each text has.

    Words count in lower case, numbers only as numbers (status codes as codes), each with the word
    before it in the same passage as well.
    """
    own = [[*map(_CODES.__getitem__, _TOKEN.findall(text.lower())), -1] for text in texts]
    sizes = np.array([len(o) for o in own], dtype=np.int64)
    flat = np.array(list(itertools.chain.from_iterable(own)), dtype=np.int64)
    rec, ends = np.repeat(np.arange(len(own)), sizes), flat < 0
    # A run of one sign counts once.
    kept = ~ends
    kept[1:] &= (flat[1:] != flat[:-1]) | (flat[1:] & _SIGN == 0)
    w, r, passage = flat[kept] & (BUCKETS - 1), rec[kept], np.cumsum(ends)[kept]
    if not len(w):
        return np.zeros(0, np.int32), np.zeros(len(own), np.int64)
    inner = passage[1:] == passage[:-1]
    both = np.full((len(w), 2), -1, dtype=np.int64)
    both[:, 0] = w | WORD
    both[:-1, 1][inner] = ((w[:-1] * 1_000_003 + w[1:] * 31 + 7) % BUCKETS)[inner]
    both[np.append(~inner, True), 0] |= LAST
    code, there = both.ravel(), both.ravel() >= 0
    code, r = code[there], np.repeat(r, 2)[there]
    key = r * BUCKETS + (code & (BUCKETS - 1))
    like = np.argsort(key)
    key = key[like]
    start = np.append(True, key[1:] != key[:-1])
    rank = np.arange(len(key)) - np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
    code[like[rank < 3]] |= EARLY
    return code.astype(np.int32), np.bincount(r, minlength=len(own))


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    """The word before and the word after a stretch of text; sentence ends count as borders."""
    before = _AROUND.findall(text[max(0, start - 40) : start])
    after = _AROUND.findall(text[end : end + 40])
    left = before[-1].lower() if before else "^"
    return ("^" if left in ".!?" else left), (after[0].lower() if after else "$")


def slots(text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """Contexts of certain slots, and (value, before, after) of possible empty values."""
    certain = [_context(text, *m.span()) for key, grammar in _SLOT.items() if key in text for m in grammar.finditer(text)]
    if "<" in text:
        certain += [_context(text, *m.span()) for m in _ANGLE.finditer(text) if m.group(1).lower() not in MARKUP]
    maybe = [(m.group(1).lower(), *_context(text, *m.span())) for m in _EMPTY.finditer(text)] if any(w in text for w in _EMPTY_WORDS) else []
    return certain, maybe


def trusted(text: str) -> bool:
    """A short record of which nearly everything stands in passages that speak of an error, of scripts or of filler."""
    if len(text) > TRUST_CHARS:
        return False
    parts = [p for p in _LINES.split(text) if p.strip()]
    return bool(parts) and sum(len(p) for p in parts if _TRUST.search(p)) >= TRUST_SHARE * sum(map(len, parts))


@dataclass
class Model:
    """Log-odds of word features (page) and of the words around an empty value (slot)."""

    page: np.ndarray
    prior: float = -4.0
    certain: float = 0.0
    before: dict[int, float] = field(default_factory=dict)
    after: dict[int, float] = field(default_factory=dict)
    natural: dict[str, tuple[float, dict[int, float], dict[int, float]]] = field(default_factory=dict)

    def are_pages(self, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the passages of each record speak for residue, and none of at least three words against it."""
        n = len(sizes)
        odds, word, last = self.page[code & (BUCKETS - 1)].astype(np.float64), (code & WORD) > 0, (code & LAST) > 0
        rec = np.repeat(np.arange(n), sizes)
        passage = np.cumsum(last) - last
        score, words = np.bincount(passage, odds), np.bincount(passage, word)
        against = np.zeros(n, dtype=bool)
        against[rec[last][(score < CONTENT) & (words >= 3)]] = True
        return (np.bincount(rec, word, minlength=n) >= 2) & (np.bincount(rec, odds, minlength=n) + self.prior > 0) & ~against

    def is_slot(self, value: str, before: str, after: str) -> bool:
        return self.is_slot_at(value, _bucket(before), _bucket(after))

    def is_slot_at(self, value: str, before: int, after: int) -> bool:
        """``is_slot`` of words that are given by their buckets."""
        if value not in self.natural:
            return True
        n, left, right = self.natural[value]
        share = lambda seen, key, total, kinds: math.log((seen.get(key, 0.0) + 0.2) / (total + 0.2 * kinds))
        odds = share(self.before, before, self.certain, 60) - share(left, before, n, 60)
        odds += share(self.after, after, self.certain, 60) - share(right, after, n, 60)
        return odds > -1.0

    def is_residue(self, text: str) -> bool:
        certain, maybe = slots(text)
        return bool(certain) or any(self.is_slot(*m) for m in maybe) or bool(self.are_pages(*features([text]))[0])


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``column`` holds at most ``most`` bytes (or a single record)."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _features(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, whether a record is trusted, its features, and the contexts of its slots."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1, 2_000_000):
            texts = batch.column(1).to_pylist()
            code, sizes = features(texts)
            raw, ends = code.tobytes(), np.cumsum(sizes) * 4
            trust, ctx = [], []
            for t in texts:
                certain, maybe = slots(t)
                trust.append(not certain and trusted(t))
                ctx.append([{"v": v, "b": _bucket(b), "a": _bucket(a)} for v, b, a in [*(("", *c) for c in certain), *maybe]])
            feats = pa.array([raw[e - 4 * n : e] for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trust, pa.bool_()), feats, pa.array(ctx, pa.list_(context))], ["id", "trust", "feats", "ctx"])

    context = pa.struct([("v", pa.string()), ("b", pa.int32()), ("a", pa.int32())])
    base = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).where("__t is not null and trim(__t) != ''")
    return materialise(spread(base).mapInArrow(featurise, f"id {dict(df.dtypes)[doc_id]}, trust boolean, feats binary, ctx array<struct<v: string, b: int, a: int>>"))


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all records of a batch, and how many each has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.int32), np.array([len(x) // 4 for x in raw], dtype=np.int64)


def _page_sums(records: DataFrame, odds: np.ndarray | None, prior: float) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Counts of each bucket, in the positive class and overall, and the records that are positive, trusted, and all.

    Trusted records are positive; the others are by their posterior, and negative before there are odds.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, every = np.zeros(BUCKETS + 3), np.zeros(BUCKETS + 3)
        for batch in _slices(batches, 1):
            code, sizes = _unpacked(batch.column(1))
            told = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            early = (code & EARLY) > 0
            rec, bucket = np.repeat(np.arange(len(sizes)), sizes)[early], code[early] & (BUCKETS - 1)
            p = told.astype(np.float64)
            if odds is not None:
                score = np.clip(prior + np.bincount(rec, odds[bucket], minlength=len(sizes)), -50.0, 50.0)
                p = np.where(told, 1.0, np.round(1 / (1 + np.exp(-score)) / GRAIN) * GRAIN)
            every[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
            yes[:BUCKETS] += np.bincount(bucket, p[rec], minlength=BUCKETS)
            every[BUCKETS:] += (p.sum(), told.sum(), len(sizes))
        seen = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(yes[seen]), pa.array(every[seen])], ["at", "yes", "every"])

    sums = records.select("trust", "feats").mapInArrow(add, "at int, yes double, every double").groupBy("at").agg(F.sum("yes").alias("yes"), F.sum("every").alias("every")).toArrow()
    at, (yes, every) = sums["at"].to_numpy(), np.zeros((2, BUCKETS + 3))
    yes[at], every[at] = sums["yes"].to_numpy(), sums["every"].to_numpy()
    return yes[:BUCKETS], every[:BUCKETS], *(float(x) for x in every[BUCKETS:])


def _learn_page(records: DataFrame, rounds: int) -> Model:
    """The page model: trusted records stay positive; the others start as negative, and in each round count as positive by their posterior."""
    odds, prior, before = None, 0.0, -1.0
    for turn in range(rounds):
        yes, every, positive, sure, n = _page_sums(records, odds, prior)
        if not sure:
            return Model(np.zeros(BUCKETS, dtype=np.float32))
        if odds is not None and positive > DRIFT * sure:  # the class would no longer be what the trusted records state
            break
        # Both classes lean on the word frequencies of all records, so a word new to a class counts little.
        no, usual = every - yes, every * (BACKGROUND / max(1.0, every.sum()))
        plain = np.log((yes + usual + 1e-12) / (yes.sum() + BACKGROUND)) - np.log((no + usual + 1e-12) / (no.sum() + BACKGROUND))
        odds = np.clip(np.where(usual > 0, plain - MARGIN, 0.0), -6.0, 6.0)
        final = np.clip(np.where(usual > 0, plain, 0.0), -6.0, 6.0)
        prior = math.log((positive + 1) / (n - positive + 1))
        if abs(positive - before) < 1e-3 * sure:  # nothing moves any more
            break
        before = positive
    return Model(final.astype(np.float32), prior)


def _slot_sums(contexts: DataFrame, wanted: Callable[[str, int, int], bool]) -> dict[str, tuple[float, dict[int, float], dict[int, float]]]:
    """For each value, the number of ``wanted`` contexts and how often each word stands before and after it."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([wanted(*x) for x in zip(*(b.column(k).to_pylist() for k in range(3)))], pa.bool_()))

    sides = F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("b").alias("word")), F.struct(F.lit("a").alias("side"), F.col("a").alias("word"))))
    kept = contexts.mapInArrow(mark, "v string, b int, a int, c bigint").select("v", "c", sides.alias("x"))
    out: dict[str, tuple[float, dict[int, float], dict[int, float]]] = {}
    for r in kept.groupBy("v", "x.side", "x.word").agg(F.sum("c").alias("c")).collect():
        n, left, right = out.get(r.v, (0.0, {}, {}))
        (left if r.side == "b" else right)[r.word] = float(r.c)
        out[r.v] = (n + (r.c if r.side == "a" else 0.0), left, right)
    return out


def _learn_slots(model: Model, contexts: DataFrame, rounds: int) -> None:
    """Words around certain slots, and around each empty-value word where it is used as a word.

    A word that is used in one collocation again and again is a word of the language there; that use
    starts as negative, every other one as positive. The share decides; eight uses are the least that a
    share can be told from, and bind only where the value occurs less than 32 times.
    """
    seen = _slot_sums(contexts, lambda v, b, a: True)
    model.certain, model.before, model.after = seen.pop("", (0.0, {}, {}))
    fixed = {(v, a) for v, (n, _, right) in seen.items() for a, c in right.items() if c >= 8 and c > 0.25 * n}
    wanted = lambda v, b, a: (v, a) in fixed
    for _ in range(rounds if fixed else 0):
        natural = _slot_sums(contexts, wanted)
        if natural == model.natural:
            break
        model.natural = natural
        held = Model(np.zeros(0), 0.0, model.certain, model.before, model.after, natural)
        wanted = lambda v, b, a, held=held: bool(v) and not held.is_slot_at(v, b, a)


def fit(records: DataFrame, rounds: int = ROUNDS) -> Model:
    """Learn both models by expectation-maximisation from every record of ``records`` (``_features``)."""
    model = _learn_page(records, rounds)
    contexts = records.select(F.explode("ctx").alias("x")).groupBy("x.v", "x.b", "x.a").agg(F.count("*").alias("c"))
    _learn_slots(model, materialise(contexts), rounds)
    return model


def find_residue(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id``, ``kind`` ('slot' or 'page') and ``trusted`` of every record that is template residue or no content.

    ``trusted`` tells the records that the learning started from; the others are found by the models, or by the
    grammar of a slot. Null, empty and blank texts are no cases. Repeated rows stay repeated. Texts are read
    whole. Other columns are never read. An empty table gives an empty result.
    """
    records = _features(df, doc_id, text)
    held = model if model is not None else fit(records)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            pages = held.are_pages(*_unpacked(batch.column(2)))
            slot = [any(not x["v"] or held.is_slot_at(x["v"], x["b"], x["a"]) for x in ctx) for ctx in batch.column(3).to_pylist()]
            kind = pa.array(["slot" if s else "page" if p else None for s, p in zip(slot, pages.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), kind, batch.column(1)], ["__id", "kind", "trusted"]).filter(kind.is_valid())

    return records.mapInArrow(judge, f"__id {dict(df.dtypes)[doc_id]}, kind string, trusted boolean").select(F.col("__id").alias(doc_id), "kind", "trusted")
