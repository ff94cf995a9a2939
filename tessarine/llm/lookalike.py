"""One consistent form for text that looks the same but holds different characters.

A mapping is derived once from the Unicode database (widths, ligatures, presentation forms, kinds of
space, invisible characters) and a table of look-alike letters, and checked for conflicts. It is
compiled into a longest-match transducer that walks the grapheme clusters of a text in one pass:
the letters of a cluster are mapped, its marks are put into canonical order and composed.
Case, digits, punctuation, spelling, strokes and accents stay as they are.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts (and Latin variants) with the shape of a Latin letter.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "հ": "h", "ո": "n", "օ": "o", "ս": "u", "յ": "j", "զ": "q", "Օ": "O", "Տ": "S", "ց": "g",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ɡ": "g", "ɑ": "a", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
#: Sequences with the shape of one letter; the longer match wins over the letter that they begin with.
SEQUENCES = {"ı\u0307": "i", "ȷ\u0307": "j"}
#: Hyphens and minus signs with the shape of the ASCII one.
HYPHENS = "‐‑‒⁃−˗﹣－"
#: Kinds of compatibility character that look like what they decompose to.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Characters without any ink besides those of category Cf.
INVISIBLE = [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0]
_CLUSTER = regex.compile(r"\X")


def _same_look(char: str) -> str:
    """What a character decomposes to as far as the look stays."""
    parts = unicodedata.decomposition(char)
    if parts.startswith("<"):
        kind, _, points = parts.partition(" ")
        if kind not in SAME_LOOK:
            return char
        out = "".join(map(_same_look, (chr(int(p, 16)) for p in points.split())))
        # A spacing accent decomposes to a space and a mark; it is a sign of its own.
        return char if len(out) > 1 and out[0] == " " and unicodedata.combining(out[1]) else out
    if parts:
        return "".join(_same_look(chr(int(p, 16))) for p in parts.split())
    return char


@functools.lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Output of every code point that does not stay as it is. Raises if rules contradict each other."""
    table: dict[str, str] = {}

    def put(char: str, out: str) -> None:
        if table.setdefault(char, out) != out:
            raise ValueError(f"{char!r} has two outputs: {table[char]!r} and {out!r}")

    for char, out in LOOK_ALIKES.items():
        put(char, out)
    for chars, out in SEQUENCES.items():
        put(chars, out)
    for char in HYPHENS:
        put(char, "-")
    for point in INVISIBLE:
        put(chr(point), "")
    for point in range(sys.maxunicode + 1):
        if 0xD800 <= point < 0xE000 or 0xAC00 <= point < 0xD7A4:  # surrogates; Hangul composes by rule
            continue
        char = chr(point)
        if char in table:
            continue
        kind = unicodedata.category(char)
        if kind == "Zs" or char in "\t\n\v\f\r\x85  ":
            put(char, " ")
        elif kind == "Cf":
            put(char, "")
        elif (out := _same_look(char)) != char:
            put(char, "".join(table.get(c, c) for c in out))
    for char, out in list(table.items()):  # images are final: applying the mapping again changes nothing
        again = "".join(table.get(c, c) for c in out)
        if "".join(table.get(c, c) for c in again) != again:
            raise ValueError(f"{char!r} does not settle")
        table[char] = again
    return {c: o for c, o in table.items() if c != o}


class Transducer:
    """Applies a mapping of strings (of any length, the longest match wins) to grapheme clusters."""

    def __init__(self, table: dict[str, str]):
        self.single = {k: v for k, v in table.items() if len(k) == 1}
        self.trie: dict = {}
        for key, out in table.items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = out
        self.known: dict[str, str] = {}

    def cluster(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            node, k, best, stop = self.trie, at, None, at + 1
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    best, stop = node[""], k
            out.append(text[at] if best is None else best)
            at = stop
        return unicodedata.normalize("NFC", "".join(out))

    def __call__(self, text: str) -> str:
        if text.isascii() and not any(c in text for c in "\t\n\v\f\r"):
            return text.strip(" ")
        out = []
        for piece in _CLUSTER.findall(text):
            if len(piece) == 1 and piece.isascii():
                out.append(self.single.get(piece, piece))
                continue
            if (made := self.known.get(piece)) is None:
                made = self.cluster(piece)
                if len(self.known) < 100_000:
                    self.known[piece] = made
            out.append(made)
        # A mark that followed a removed character joins the letter before it.
        return unicodedata.normalize("NFC", "".join(out)).strip(" ")


@functools.lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(mapping())


def one_form(text: str | None) -> str | None:
    """The consistent form of a text; null stays null, blank becomes empty."""
    return None if text is None else transducer()(text)


@F.pandas_udf(T.StringType())
def _one_form(texts: pd.Series) -> pd.Series:
    walk = transducer()
    return texts.map(walk, na_action="ignore")


def consistent(text: Column) -> Column:
    """The consistent form of a text column.

    Two texts get equal forms exactly if they look the same. Null gives null; empty and blank texts
    give the empty text; texts of any length are walked whole.
    """
    return _one_form(text)


def same_look(df: DataFrame, left: str, right: str) -> DataFrame:
    """``df`` with left_form, right_form and verdict: 'equal', 'same look', 'different' or null.

    'equal' are identical strings, 'same look' different strings of one form. The verdict is null
    where either text is null or empty. Rows that repeat stay repeated; an empty table stays empty.
    Columns of ``df`` with the names of the new ones are replaced.
    """
    a, b = F.col(left), F.col(right)
    told = F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), F.lit(None).cast("string"))
    return (
        df.withColumns({"left_form": consistent(a), "right_form": consistent(b)})
        .withColumn("verdict", told.when(a == b, "equal").when(F.col("left_form") == F.col("right_form"), "same look").otherwise("different"))
    )
