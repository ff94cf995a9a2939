import unicodedata

from pyspark.sql import functions as F

from tessarine.functions import text


def test_ascii_form_of_every_character(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["x" + "".join(chars[k : k + 50]) + "y" for k in range(0, len(chars), 50)]
    df = spark.createDataFrame([(r,) for r in [*rows, "", None, "Café ﬁn №5 … 𝐀𝐛"]], "t string")
    got = [(r.t, r.a) for r in df.select("t", text.ascii_form(F.col("t")).alias("a")).collect()]
    for t, a in got:
        assert a == (None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())
