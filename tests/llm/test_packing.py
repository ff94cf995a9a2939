import math
import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessarine.llm.packing import best_fit, pack


def plain_best_fit(sizes, sources, clusters, capacity, conflicts):
    """The same packing by looking at every container."""
    boxes, items, out = [], [], []
    for k, size in enumerate(sizes):
        piece = 0
        while size > capacity:
            out.append((k, piece, capacity, len(boxes)))
            boxes.append([0, [], []])
            piece, size = piece + 1, size - capacity
        items.append((size, clusters[k], k, piece))
    least = max(1, math.ceil(sum(i[0] for i in items) / capacity))
    members = Counter(i[1] for i in items if i[0])
    shut = len(boxes)
    limit = {c: math.ceil(m / least) for c, m in members.items()}
    hot = {c: m for c, m in members.items() if m > 1}
    for size, c, k, piece in sorted(items, key=lambda i: (-hot.get(i[1], 0) if i[0] else 0, -i[0], i[1], i[2])):
        room = [(b[0], n) for n, b in enumerate(boxes) if n >= shut and b[0] >= size and not any(conflicts.get(sources[k], 0) >> s & 1 for s in b[2])]
        fits = [x for x in room if size == 0 or boxes[x[1]][1].count(c) < limit[c]]
        if fits:
            n = min(fits)[1]
        else:
            boxes.append([capacity, [], []])
            n = len(boxes) - 1
        boxes[n][0] -= size
        boxes[n][1] += [c] if size else []
        boxes[n][2].append(sources[k])
        out.append((k, piece, size, n))
    return out


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_against_plain_search(data):
    n = data.draw(st.integers(0, 40))
    kinds = data.draw(st.lists(st.integers(0, 60), min_size=1, max_size=6))
    clusters = [data.draw(st.integers(0, len(kinds) - 1)) for _ in range(n)]
    sizes = [kinds[c] if data.draw(st.booleans()) else data.draw(st.integers(0, 60)) for c in clusters]
    sources = [data.draw(st.integers(0, 2)) for _ in range(n)]
    conflicts = data.draw(st.sampled_from([{}, {0: 0b010, 1: 0b001}]))
    assert sorted(best_fit(sizes, sources, clusters, 25, conflicts)) == sorted(plain_best_fit(sizes, sources, clusters, 25, conflicts))


def test_little_room_is_left_with_a_hot_cluster():
    rng = random.Random(2)
    sizes = [17] * 3000 + [rng.randint(1, 500) for _ in range(6000)]
    clusters = [0] * 3000 + list(range(1, 6001))
    placed = best_fit(sizes, [0] * 9000, clusters, 512)
    load = Counter()
    for k, _, t, box in placed:
        load[box] += t
    assert max(load.values()) <= 512 and sum(load.values()) == sum(sizes)
    assert len(load) <= 1.02 * math.ceil(sum(sizes) / 512)


def test_no_container_holds_two_of_a_cluster_that_has_fewer_members_than_containers():
    rng = random.Random(4)
    sizes = [rng.randint(1, 300) for _ in range(4000)]
    clusters = [rng.randrange(2500) for _ in range(3960)] + [9999] * 40
    held = Counter((box, clusters[k]) for k, _, _, box in best_fit(sizes, [0] * 4000, clusters, 512))
    assert max(held.values()) == 1
    opened, least = len({box for box, _ in held}), math.ceil(sum(sizes) / 512)
    assert opened <= 1.01 * least


def test_table_with_every_odd_row(spark):
    rows = [(k, t, s, "x") for k, (t, s) in enumerate([(None, "a"), ("", None), ("word " * 1500, "a"), ("short one", "b"), ("short one", "b"), ("SHORT  one", "c"), ("other text here", "a")])]
    rows += [(None, "no id", "a", "x"), (3, "short one", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens string")
    out = pack(df, [(1, 512), (2, 8192)], apart=[("a", "c")]).collect()
    by_budget = defaultdict(list)
    for r in out:
        by_budget[r.budget_id].append(r)
    for budget, capacity in ((1, 512), (2, 8192)):
        own = by_budget[budget]
        assert {r.doc_id for r in own} == {r[0] for r in rows}
        load = Counter()
        for r in own:
            load[r.container_id] += r.tokens
        assert max(load.values()) <= capacity
        pieces = [r for r in own if r.doc_id == 2]
        assert len(pieces) == math.ceil(sum(r.tokens for r in pieces) / capacity)
        apart = defaultdict(set)
        for r in own:
            apart[r.container_id].add("c" if r.doc_id == 5 else "a" if r.doc_id in (0, 2, 6, None) else "")
        assert not any({"a", "c"} <= v for v in apart.values())
    assert pack(df.limit(0), [(1, 512)]).count() == 0
