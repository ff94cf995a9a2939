import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tessarine.llm import lookalike as L

SAME = [
    ("ﬁnal", "final"), ("Ｍｅｄａｌ", "Medal"), ("Derby​", "Derby"), ("N­orth", "North"), ("a b", "a b"), ("2027 ‐ x", "2027 - x"),
    ("Béla", "Béla"), ("аео", "aeo"), ("Τarn", "Tarn"), ("cոt", "cnt"), ("ї", "ï"), ("Ⅱ Cup", "II Cup"), ("K", "K"),
    ("ộ", "ộ"), ("ộ", "ộ"), (" padded ", "padded"), ("g", "ɡ"), ("premⅰere", "premiere"),
]
DIFFERENT = [("ø", "o"), ("ł", "l"), ("ı", "i"), ("é", "e"), ("Final", "final"), ("2026", "2027"), ("a?", "a"), ("ß", "ss"), ("й", "и"), ("ё", "е"), ("а", "б"), ("x²", "x2"), ("½", "1/2")]


def test_pairs():
    for a, b in SAME:
        assert L.one_form(a) == L.one_form(b), (a, b)
    for a, b in DIFFERENT:
        assert L.one_form(a) != L.one_form(b), (a, b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable_and_ignores_composition(text):
    text = "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000)
    form = L.one_form(text)
    assert L.one_form(form) == form
    assert L.one_form(unicodedata.normalize("NFD", text)) == L.one_form(unicodedata.normalize("NFC", text))


def test_longest_match_wins():
    walk = L.Transducer({"a": "1", "ab": "2", "abc": "3"})
    assert walk.cluster("abcab a") == "32 1"


def test_table_with_every_odd_row(spark):
    rows = [(1, "Derby", "Dеrby", "x"), (1, "Derby", "Dеrby", "x"), (2, "", "", "x"), (3, None, "a", "x"), (4, "a", "a", "x"), (5, "b" * 50_000, "b" * 50_000 + "​", "x"), (6, "a", "b", "x")]
    df = spark.createDataFrame(rows, "audit_id bigint, l string, r string, verdict string")
    out = [(r.audit_id, r.verdict) for r in L.same_look(df, "l", "r").orderBy("audit_id").collect()]
    assert out == [(1, "same look"), (1, "same look"), (2, None), (3, None), (4, "equal"), (5, "same look"), (6, "different")]
    assert L.same_look(df.limit(0), "l", "r").count() == 0


def test_the_longest_match_wins():
    assert L.one_form("ı\u0307n") == "in" and L.one_form("ın") == "ın"
