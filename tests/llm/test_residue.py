import random
import re

import pytest

from tessarine.llm import residue

RNG = random.Random(11)
SUBJECTS = ["Alba Noor", "Milo Vant", "Iris Calder", "Otto Brandt", "Lena Fjord", "Hugo Pym"]
CONTENT = [
    "The contract closes early if {s} withdraws from the open before the final.",
    "Only figures published before {n}:30 PM on the day count towards settlement.",
    "Volume rose to {n} contracts while the spread narrowed to {m} cents.",
    "A tie between {s} and {s} settles every outcome at an equal fraction.",
    "Weather over the bay turned in May {n}: gusts, then a long calm.",
    "Open interest on the {n} ladder is {m} contracts, most of them at the low rungs.",
    "Disputes have to be filed within {m} hours of the first notice by {s}.",
    "An interim appointment of {s} does not count; a full term is required.",
]
TRAPS = [
    "Quotes were missing for {n} minutes because the feed answered 502 Bad Gateway, then trading went on.",
    "The live chart requires JavaScript; the rules above apply with or without it.",
    "null votes and blank votes are counted apart in district {n}.",
    "The list of outcomes is {{Yes, No}} and no further outcome will be added [{n}].",
]
CHROME = ["Home | Markets | Help", "Menu", "Log in   Sign up", ""]
PAGES = [
    "You need to enable JavaScript to view this market.",
    "Please turn on scripts and reload. This app does not work without it.",
    "502 Bad Gateway",
    "Sorry! The page could not be found. Reload the page.",
    "Lorem ipsum dolor sit amet. Magna sem risus nibh elit congue viverra.",
    "Your headline here",
]
SLOTS = ["{{ winner }}", "${TIME}", "%(margin)s", "<%= city %>", "[INSERT DATE]", "__year__", "<<unit>>", "[object Object]", "{0:source}", "@@time@@", "%date%"]


def content():
    return " ".join(RNG.choice(CONTENT if RNG.random() < 0.85 else TRAPS).format(s=RNG.choice(SUBJECTS), n=RNG.randint(2, 900), m=RNG.randint(2, 99)) for _ in range(RNG.randint(2, 7)))


def corpus(n):
    rows = []
    for k in range(n):
        draw = RNG.random()
        if draw < 0.06:
            rows.append((k, "\n".join([RNG.choice(CHROME), RNG.choice(PAGES), RNG.choice(CHROME)]), True))
        elif draw < 0.10:
            rows.append((k, content().replace(RNG.choice(["the", "is", "before"]), RNG.choice(SLOTS), 1) + " Won by " + RNG.choice(SLOTS) + ".", True))
        elif draw < 0.12:
            text = RNG.choice(CONTENT).format(s=RNG.choice(["7 7", *SUBJECTS]), n="7", m="7")
            rows.append((k, content() + " " + re.sub(r"\b7( 7)?\b", RNG.choice(["null", "None", "NaN", "undefined"]), text), "7" in text))
        else:
            rows.append((k, content() + RNG.choice([""] * 16 + ["\n" + PAGES[0], "\nMenu"]), False))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus(2500)
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string").repartition(4)
    return residue.fit(residue._features(df, "doc_id", "text"))


def test_held_out_accuracy(learned):
    held = corpus(1500)
    told = [(learned.is_residue(t), want) for _, t, want in held]
    hits = sum(a and b for a, b in told)
    assert hits / sum(b for _, b in told) > 0.95
    assert hits / max(1, sum(a for a, _ in told)) > 0.95


def test_table_with_every_odd_row(spark, learned):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, PAGES[0]), (4, PAGES[0]), (5, "a " * 100_000), (None, "pays {{ amount }} now"), (6, content())]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, kind string")
    got = sorted((r.doc_id or 0, r.kind) for r in residue.find_residue(df, model=learned).collect())
    assert [g for g in got if g[0] != 5] == [(0, "slot"), (4, "page"), (4, "page")]
    assert residue.find_residue(df.limit(0)).count() == 0


def test_most_records_are_found_by_what_was_learned(spark):
    rows = corpus(3000) + [(5000 + k, f"Whoops, this {w} was refused again.", True) for k, w in enumerate(["chart", "listing", "event"] * 12)]
    rows += [(6000 + k, f"Error {500 + k % 4}, whoops, this event was refused", True) for k in range(30)]
    found = residue.find_residue(spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in found if not r.trusted and r.kind == "page"} >= set(range(5000, 5036))


def test_slots_are_told_from_look_alikes():
    for slot in SLOTS:
        assert residue.slots(f"before {slot} after")[0], slot
    for text in ("outcomes {Yes, No}", "see [12] and [sic]", "[see section 4]", 'field "end_date"', "about 5% of 7%", "<b>bold</b>", "bracket <19 kg> is open", "a | b | c", "snake_case words"):
        assert not residue.slots(text)[0], text


def test_every_record_takes_part_in_learning(spark):
    def word(k):
        return "".join(chr(97 + k // 26**i % 26) for i in range(4))

    rows = [(k, f"venue {word(k)} settles {word(k)}") for k in range(24_000)] + [(k, "502 Bad Gateway") for k in range(24_000, 24_050)]
    # A hot text and a notice whose wording stands in a few records only.
    rows += [(k, "The contract closes early.") for k in range(25_000, 37_000)] + [(37_000 + k, "502 Bad Gateway\nquorvex ziltane") for k in range(5)]
    model = residue.fit(residue._features(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), "doc_id", "text"))
    # A few of the words share a bucket with one of the notice.
    assert sum(model.page[residue._bucket(word(k))] < 0 for k in range(24_000)) >= 23_990
    assert model.page[residue._bucket("quorvex")] > 0 and model.page[residue._bucket("ziltane")] > 0
    assert model.page[residue._bucket("contract")] < 0
