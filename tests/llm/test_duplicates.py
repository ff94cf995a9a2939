import random

from tessarine.llm import duplicates

RNG = random.Random(13)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(400)]


def sentence(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def changed(words, n):
    out = list(words)
    for _ in range(n):
        out[RNG.randrange(len(out))] = "changed" + str(RNG.randrange(1000))
    return out


def brute_force(texts):
    found = {k: {tuple(t.split(" ")[i : i + 5]) for i in range(max(1, len(t.split(" ")) - 4))} for k, t in texts.items() if t}
    parent = {k: k for k in found}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in found:
        for b in found:
            if a < b and len(found[a] & found[b]) >= 0.8 * len(found[a] | found[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in found if any(root(k) == root(j) for j in found if j != k)}


def test_clusters_against_brute_force(spark):
    texts = {}
    for g in range(60):
        base = sentence(RNG.randint(40, 300))
        for _ in range(RNG.randint(1, 5)):
            # Far above or far below the limit, where the signatures decide with next to no chance of error.
            texts[len(texts)] = " ".join(changed(base, RNG.choice([0, 1, len(base) // 4])))
            if g % 7 == 0:
                base = changed(base, 1)  # a chain: neighbours are alike, its ends need not be
    texts |= {1000: "", 1001: "two words", 1002: "two words", 1003: "one", 1004: "word " * 5000}
    rows = [(k, t.strip()) for k, t in texts.items()]
    got = {r.form_id: r.cluster for r in duplicates.clusters(spark.createDataFrame(rows + rows[:50], "form_id bigint, form string").repartition(3)).collect()}
    want = brute_force({k: t.strip() for k, t in rows})
    assert len(got.items() & want.items()) >= 0.99 * len(want) and set(got) <= set(want)


def shifted(words, kept, tag):
    """A text that shares exactly ``kept`` of the 96 shingles of 100 words with the base, from its end."""
    return [f"{tag}{k}" for k in range(96 - kept)] + words[96 - kept :]


def test_no_link_is_left_out(spark):
    # Ten texts are like the first one, and each is met by others that are like it alone, at and just over the limit of 0.8.
    base = [f"w{k}" for k in range(100)]
    texts = {0: base}
    for g in range(10):
        texts[100 + g] = shifted(base, 88, f"a{g}x")  # 88 / 104
        texts[200 + g] = [*texts[100 + g][:90], *(f"b{g}x{k}" for k in range(10))]  # 86 of 106 with it, fewer with the first
        lone = [f"c{g}x{k}" for k in range(22)]
        texts[300 + g], texts[400 + g] = lone, [*lone[:-2], f"d{g}", f"e{g}"]  # 16 of 20
        texts[500 + g], texts[600 + g] = lone[:12] + [f"f{g}x{k}" for k in range(14)], [f"f{g}x{k}" for k in range(14)] + [f"h{g}"]
    texts = {k: " ".join(t) for k, t in texts.items()}
    got = {r.form_id: r.cluster for r in duplicates.clusters(spark.createDataFrame(list(texts.items()), "form_id bigint, form string").repartition(3)).collect()}
    assert got == brute_force(texts)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100)], "form_id bigint, rep bigint")
    assert {(r.form_id, r.cluster) for r in duplicates.components(links).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_empty_table(spark):
    assert duplicates.clusters(spark.createDataFrame([], "form_id bigint, form string")).count() == 0
