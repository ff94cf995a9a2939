"""Names of entities: canonical forms, equivalence, anchors, and compatibility of attributes, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessarine.functions import similarity
from tessarine.functions.text import plain_words, signature_text, spaced_words

# Words that tell no entity from another, and other names of whole entities.
GENERIC = ["fc", "afc", "cf", "the", "team", "club", "jr", "sr", "ii", "iii", "iv"]
ALIASES = {
    "man utd": "manchester united",
    "man united": "manchester united",
    "man city": "manchester city",
    "psg": "paris saint germain",
    "inter milan": "internazionale",
    "inter": "internazionale",
    "ny": "new york",
    "la": "los angeles",
    "jd vance": "j d vance",
}
SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]
#: Source words that name no authority.
BOILERPLATE = ["http", "https", "www", "com", "org", "source", "official"]
#: Ways to state one comparison, and one that is not told.
OPERATOR_NAMES = {"ge_structured": "ge", "le_structured": "le", "structured": "unspecified", "threshold_unspecified": "unspecified"}


def canonical_entity(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """A name without generic words and single middle initials, with initials that follow one another joined.

    ``aliases`` extend and override the known other names. '' for null.
    """
    known = {**ALIASES, **(aliases or {})}
    t = F.trim(F.regexp_replace(F.replace(signature_text(F.coalesce(name, F.lit(""))), F.lit("."), F.lit(" ")), r"\s+", " "))
    t = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), t), t)
    words = F.filter(F.split(t, " "), lambda w: (w != "") & ~w.isin(GENERIC))
    joined = F.split(F.regexp_replace(F.array_join(words, " "), r"\b(\S) (\S)(?= |$)", "$1$2"), " ")
    last = F.size(joined) - 1
    kept = F.filter(joined, lambda w, i: ~((F.length(w) == 1) & (i > 0) & (i < last)))
    return F.array_join(F.when(last >= 2, kept).otherwise(joined), " ")


def equivalence(a: Column, b: Column) -> Column:
    """Score of two canonical names: 1 equal, .98 the same two or more words, .92 all but nearly alike, else a blend under 1.

    0 where one is empty. Names count as one entity from .92 on: see ``equivalent``.
    """
    x, y = F.split(a, " "), F.split(b, " ")
    share, ratio = similarity.jaccard(x, y), similarity.sequence_ratio(a, b)
    same = (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0) & (F.size(F.array_distinct(x)) >= 2)
    near = (F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y))) >= 2) & (share >= 0.8) & (ratio >= 0.88)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(same, 0.98).when(near, 0.92).otherwise(0.7 * share + 0.3 * ratio)


def equivalent(a: Column, b: Column) -> Column:
    """Whether two canonical names are one entity, without the near ones: equal, or the same two or more words."""
    x, y = F.split(a, " "), F.split(b, " ")
    same = (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0) & (F.size(F.array_distinct(x)) >= 2)
    return (a != "") & (b != "") & ((a == b) | same)


def entity_verdict(a: Column, b: Column) -> Column:
    """Three-valued: null where a name is empty, true where one name's words hold the other's or all but spell them, else false."""
    return canonical_verdict(canonical_entity(a), canonical_entity(b))


def canonical_verdict(x: Column, y: Column) -> Column:
    """``entity_verdict`` of two canonical names."""
    p, q = F.split(x, " "), F.split(y, " ")
    subset = (F.size(F.array_except(p, q)) == 0) | (F.size(F.array_except(q, p)) == 0)
    # Texts whose lengths alone keep them apart are not compared: the ratio is at most twice the shorter over both.
    long = 2.0 * F.least(F.length(x), F.length(y)) / (F.length(x) + F.length(y)) >= 0.88
    near = lambda c: F.when((x != "") & (y != "") & long & (x != y), c)
    alike = (x == y) | F.coalesce(similarity.sequence_ratio(near(x), near(y)) >= 0.88, F.lit(False))
    return F.when((x != "") & (y != ""), subset | alike)


def anchor_overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller of two sets; 0 if it is empty."""
    return similarity.containment(a, b)


def person_words(name: Column) -> Column:
    """Distinct words of a name without generation suffixes, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(plain_words(name), " "), lambda w: (w != "") & ~w.isin(SUFFIXES))))


def first_year(text: Column) -> Column:
    """The first year that a text states; '' if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(20[0-9]{2})\b", 1)


def same_person(a: Column, b: Column) -> Column:
    """Whether two names have the same words but for a generation suffix; false for empty ones."""
    return same_words(person_words(a), person_words(b))


def same_words(x: Column, y: Column) -> Column:
    """Whether two sorted sets of words are equal and not empty."""
    return (F.size(x) > 0) & (x == y)


def same_year(a: Column, b: Column) -> Column:
    """False only where both texts state a year and the first ones differ."""
    return years_agree(first_year(a), first_year(b))


def years_agree(x: Column, y: Column) -> Column:
    """``same_year`` of two years, '' for none."""
    return (x == "") | (y == "") | (x == y)


def subject_compatible(a: Column, b: Column) -> Column:
    """Equal words, one of five or more letters inside the other, or a Jaccard of .6; false where one is empty."""
    x, y = spaced_words(F.coalesce(a, F.lit(""))), spaced_words(F.coalesce(b, F.lit("")))
    inside = (F.length(x) >= 5) & (F.length(y) >= 5) & (x.contains(y) | y.contains(x))
    long = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 1)
    return (x != "") & (y != "") & ((x == y) | inside | (similarity.jaccard(long(x), long(y)) >= 0.6))


def operator_name(op: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in OPERATOR_NAMES.items() for x in pair]), op), op)


def thresholds_compatible(a_op: Column, a_low: Column, a_high: Column, b_op: Column, b_low: Column, b_high: Column) -> Column:
    """Bounds that are missing alike or equal to 1e-9, and comparisons that are equal or not told; true without any bound."""
    none = a_low.isNull() & a_high.isNull() & b_low.isNull() & b_high.isNull()
    same = lambda x, y: F.coalesce(F.abs(x - y) <= 1e-9, x.isNull() & y.isNull())
    x, y = operator_name(a_op), operator_name(b_op)
    return none | (same(a_low, b_low) & same(a_high, b_high) & (x.eqNullSafe(y) | F.coalesce(x == "unspecified", F.lit(False)) | F.coalesce(y == "unspecified", F.lit(False))))


def same_domain(a: Column, b: Column) -> Column:
    """Equal, or one is missing or 'other'."""
    wild = lambda c: F.coalesce(c, F.lit("other")) == "other"
    return wild(a) | wild(b) | (a == b)


def source_key(source: Column) -> Column:
    """Up to twelve words of a source that name an authority; null if there are none."""
    t = F.regexp_replace(F.replace(signature_text(source), F.lit("."), F.lit(" ")), r"\s+", " ")
    words = F.filter(F.split(t, " "), lambda w: (F.length(w) > 2) & ~w.isin(BOILERPLATE))
    return F.nullif(F.array_join(F.slice(words, 1, 12), " "), F.lit(""))


def sources_compatible(a: Column, b: Column) -> Column:
    """False only where both are stated and have next to nothing in common."""
    x, y = signature_text(a), signature_text(b)
    words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 1)
    alike = 0.7 * similarity.jaccard(words(x), words(y)) + 0.3 * similarity.sequence_ratio(x, y)
    return F.coalesce((x == "") | (y == "") | (alike >= 0.12), F.lit(True))


def identity_similarity(a: Column, b: Column) -> Column:
    """The blend of words and sequence, or with character trigrams and containment where that is more."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 1)
    grams = lambda c: F.array_distinct(F.regexp_extract_all(F.concat(F.lit("  "), c, F.lit("  ")), F.lit("(?=(.{3}))"), 1))
    given = F.struct(signature_text(a).alias("x"), signature_text(b).alias("y"))
    ratio = similarity.sequence_ratio(given["x"], given["y"])

    def parts(s: Column) -> Column:
        x, y = s["x"], s["y"]
        inside = (F.least(F.length(x), F.length(y)) >= 10) & (x.contains(y) | y.contains(x))
        return F.struct(
            ((x == "") | (y == "") | x.isNull() | y.isNull()).alias("none"), s["ratio"].alias("ratio"),
            similarity.jaccard(words(x), words(y)).alias("words"), similarity.jaccard(grams(x), grams(y)).alias("grams"), F.when(inside, 0.1).otherwise(0.0).alias("inside"),
        )

    def blend(s: Column) -> Column:
        base = 0.7 * s["words"] + 0.3 * s["ratio"]
        rich = F.least(F.lit(1.0), 0.62 * base + 0.28 * s["grams"] + s["inside"])
        return F.when(s["none"], 0.0).otherwise(F.greatest(base, rich))

    # Arrays of one hold what is used more than once: as a plain expression it would be worked out at each use.
    held = F.transform(F.array(F.struct(given["x"].alias("x"), given["y"].alias("y"), ratio.alias("ratio"))), parts)
    return F.element_at(F.transform(held, blend), 1)


def context_key(title: Column, subject: Column) -> Column:
    """The words of a title without its subject, years and words that every title has."""
    t = F.concat(F.lit(" "), signature_text(title), F.lit(" "))
    s = signature_text(subject)
    t = F.when(s != "", F.replace(t, F.concat(F.lit(" "), s, F.lit(" ")), F.lit("  "))).otherwise(t)
    t = F.regexp_replace(t, r"\b20[0-9]{2}(?:\s*-\s*(?:20)?[0-9]{2})?\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(?:will|who|be|become|the|in|market|yes|no)\b", " "), r"\s+", " "))


def packed(sources: Column, names: Sequence[str]) -> Column:
    """A bitmap of the names that an array holds, first name in the lowest bit."""
    bits = [F.when(F.array_contains(sources, n), F.lit(1 << k)).otherwise(F.lit(0)) for k, n in enumerate(names)]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return F.when(sources.isNotNull(), total.cast("long"))


def unpacked(mask: Column, names: Sequence[str]) -> Column:
    """The names whose bits a bitmap has, in order."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, F.lit(n)) for k, n in enumerate(names)]))


def pair_score(a: str, b: str) -> Column:
    """Cheap evidence for a pair of signature structs ``a`` and ``b``: bonuses for equal attributes, penalties for different ones.

    Attributes that one side lacks count nothing.
    """
    # Bonus and penalty of each attribute.
    weights = {"proposition": (1.0, -2.0), "domain": (0.75, -1.5), "metric": (2.0, -2.0), "office_scope": (2.0, -2.0), "season_year": (1.5, -1.5), "competition": (2.0, -2.0)}
    total = F.lit(0.0)
    for c, (bonus, penalty) in weights.items():
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        apart = F.lit(penalty) if c != "domain" else F.when((x != "other") & (y != "other"), penalty).otherwise(0.0)
        total = total + F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0).when(x == y, bonus).otherwise(apart)
    low = F.col(f"{a}.threshold_low"), F.col(f"{b}.threshold_low")
    return total + F.when(low[0].isNull() | low[1].isNull(), 0.0).when(F.abs(low[0] - low[1]) <= 1e-9, 3.0).otherwise(-3.0)
