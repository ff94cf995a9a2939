import random

import pyspark.sql.types as T
import pytest
from tokenizers import Tokenizer

from tessarine.llm import encoding

JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def twin():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def cases():
    rng = random.Random(5)
    words = ["price", "Über", "日本語", "1234", "don't", " ", "  ", "\n\n", "\t", "🤦‍♀️", "a" * 40, "<|endoftext|>", "—", " ", "x" * 300, " " * 90]
    return ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]


def test_chunks_stitch_to_the_ids_of_the_whole_text(twin):
    for text in cases():
        want = twin(text)
        for size, overlap in ((7, 3), (50, 20), (64, 64), (500, 40)):
            parts = []
            whole = encoding.chunks(text, size, overlap)
            for k, (start, part) in enumerate(whole):
                cuts, counts, ids = encoding.pieces(part, k + 1 == len(whole), encoding.TOKENIZER)
                parts.append({"start": start, "text": part, "cuts": cuts, "counts": counts, "ids": ids})
            assert encoding.stitch(parts) == want == encoding.encode(text)
        assert encoding.decode(want) == text


def test_corpus_with_every_odd_row(spark, twin):
    texts = ["", None, " ", "word", "w" * 5000, "many words here " * 400, "word", "\n" * 3000 + "end"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "no id", "clash"), (3, "word", "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    out = encoding.encode_corpus(df, chunk_chars=200, overlap_chars=50)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = out.collect()
    assert len(got) == len(rows)
    for row in got:
        text = "no id" if row.doc_id is None else texts[row.doc_id]
        assert row.ids == (twin(text) if text else [])


def test_empty_table(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert encoding.encode_corpus(df).count() == 0


def test_repeated_long_texts_stay_repeated(spark, twin):
    long = "many words here " * 400
    rows = [(1, long), (1, long), (None, long), (None, long), (None, long), (2, "word"), (2, "word")]
    got = encoding.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), chunk_chars=200, overlap_chars=50).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, 0, 1, 1, 2, 2]
    assert all(r.ids == twin("word" if r.doc_id == 2 else long) for r in got)
