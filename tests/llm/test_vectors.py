import numpy as np
import pandas as pd
import pytest

from tessarine.llm import vectors

SCHEMA = "vec_id bigint, text string, embedding array<float>, cosine string"


def crowds(seed=4, n=900, dim=16):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    while len(rows) < n:
        centre = rng.normal(size=dim)
        for _ in range(int(rng.choice([1, 1, 1, 2, 6, 30]))):
            v = (centre + rng.normal(scale=0.12, size=dim)) * rng.uniform(0.1, 50)
            rows.append((i, "t", [float(np.float32(x)) for x in v], "clash"))
            i += 1
    copy = rows[7][2]
    rows += [(10_000 + k, "copy", copy, "clash") for k in range(400)]  # a third of all rows
    rows += rows[:40]  # delivered twice
    rows += [(20_001, "zero", [0.0] * dim, "x"), (20_002, "null", None, "x"), (20_003, "nan", [float("nan")] * dim, "x"), (20_004, "short", [1.0, 2.0], "x"), (20_005, "hole", [None] * dim, "x"), (None, "no id", copy, "x")]
    return rows


@pytest.mark.parametrize("least", [-1.0, 0.9])
def test_recall_against_brute_force(spark, least):
    rows = crowds()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    recall = 0.98
    got = vectors.nearest(df, "vec_id", "embedding", k=5, least=least, leaf_rows=60, recall=recall).collect()
    pairs = {(r.vec_id, r.neighbour_id) for r in got}
    assert len(pairs) == len(got)
    frame = pd.DataFrame([r for r in rows if r[0] is not None and r[2] is not None and len(r[2]) == 16], columns=["vec_id", "text", "embedding", "c"])
    want = vectors.brute_force(frame, "vec_id", "embedding", 5, least)
    assert len(pairs & want) >= 0.95 * len(want)
    if least > 0:
        assert len(pairs & want) >= 0.97 * len(pairs)
    own = {r.vec_id: [] for r in got}
    for r in got:
        own[r.vec_id].append(r.neighbour_id)
    assert sorted(own[10_399]) == sorted([7, 10_000, 10_001, 10_002, 10_003])


def test_query_set_against_all_rows(spark):
    df = spark.createDataFrame(crowds(n=300), SCHEMA)
    some = vectors.nearest(df, "vec_id", "embedding", k=3, least=0.5, queries="vec_id % 50 = 0")
    every = vectors.nearest(df, "vec_id", "embedding", k=3, least=0.5)
    a = {tuple(r) for r in some.select("vec_id", "neighbour_id").collect()}
    b = {tuple(r) for r in every.where("vec_id % 50 = 0").select("vec_id", "neighbour_id").collect()}
    assert a and len(a & b) >= 0.9 * len(b)


def test_empty_tables(spark):
    df = spark.createDataFrame(crowds(n=20), SCHEMA)
    assert vectors.nearest(df.limit(0), "vec_id", "embedding").count() == 0
    assert vectors.nearest(df.where("vec_id = 20001"), "vec_id", "embedding").count() == 0
    one = spark.createDataFrame([(1, "t", [1.0, 0.0], "x")], SCHEMA)
    assert vectors.nearest(one, "vec_id", "embedding").count() == 0


def test_leaves_of_many_queries_at_once_are_those_of_the_queue(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(60, 12)), 40, axis=0) + rng.normal(scale=0.4, size=(2_400, 12))
    tree = vectors.fit_tree(x, 6)
    for count in (1, 2, 7, 33, tree.leaves - 1, tree.leaves, tree.leaves + 5):
        want = [sorted(tree.visit(q, count)) for q in x[:300]]
        assert [sorted(found.tolist()) for found in tree.visits(x[:300], count)] == want
    one = vectors.fit_tree(x[:3], 6)
    assert [found.tolist() for found in one.visits(x[:2], 1)] == [[0], [0]]
    # Queries of the search are answered at once, not one by one.
    monkeypatch.setattr(vectors.Tree, "visit", None)
    assert len(tree.visits(x, 5)) == len(x)


def test_the_calibration_walks_no_further_than_to_the_leaves_it_ranks():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8))
    tree = vectors.fit_tree(x, 6)
    for q in x[:40]:
        whole = tree.visit(q, tree.leaves)
        assert tree.visit(q, tree.leaves, {whole[3], whole[9]}) == whole[:10]
        assert tree.visit(q, tree.leaves, set()) == []


def test_borders_tell_the_leaves_that_a_query_visits():
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(60, 12)), 40, axis=0) + rng.normal(scale=0.4, size=(2_400, 12))
    tree = vectors.fit_tree(x, 6)
    own = tree.assign(x)
    assert not tree.reach(x, own).any()
    row, leaf = tree.within(x, 0.0)
    assert row[np.argsort(row)].tolist() == list(range(len(x))) and (leaf == own[row]).all()
    other = own[rng.permutation(len(x))]
    far = tree.reach(x, other)
    for end in np.quantile(far, [0.1, 0.5, 0.9]):
        found = set(zip(*(a.tolist() for a in tree.within(x, end))))
        assert [(k, int(one)) in found for k, one in enumerate(other)] == (far <= end).tolist()
    alone = vectors.fit_tree(x[:3], 6)
    assert [a.tolist() for a in alone.within(x[:2], 0.0)] == [[0, 1], [0, 0]]
    # A query deep inside its leaf visits fewer leaves than one between many.
    visits = np.bincount(tree.within(x, float(np.median(far)))[0])
    assert visits.min() < visits.mean() / 2


@pytest.mark.parametrize("least", [0.5, 0.9])
def test_blocks_by_single_precision_give_the_same_neighbours(least, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(50, 16)), 6, axis=0) + rng.normal(scale=0.25, size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(300)
    few = [a.tolist() for a in vectors.block_neighbours(ids[:90], x[:90], ids, x, 5, least)]
    monkeypatch.setattr(vectors, "DENSE", 0)
    every = [a.tolist() for a in vectors.block_neighbours(ids[:90], x[:90], ids, x, 5, least)]
    assert few[:2] == every[:2] and np.allclose(few[2], every[2]) and few[0]
