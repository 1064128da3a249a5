import pytest

from factloom.errors import RequestError
from factloom.operators.neardup import connected_components, near_duplicate_clusters, near_duplicate_pairs
from tests.helpers import FUTURE, NOW, PAST, active, blends, memories, score


def table(n=150):
    vecs = blends(11, n)
    rows = []
    for i, v in enumerate(vecs):
        v = vecs[0] if i % 3 == 0 else v              # a third of the rows are copies
        rows.append({"embedding": v, "user_id": "u" if i % 10 else "other",
                     "deleted_at": PAST if i % 13 == 5 else None,
                     "expires_at": PAST if i % 17 == 3 else FUTURE if i % 17 == 4 else None})
    return rows


def model_pairs(rows, threshold, k):
    live = [(i + 1, r) for i, r in enumerate(rows) if active(r)]
    out = {}
    for i, r in live:
        near = sorted((-score(r["embedding"], o["embedding"]), j) for j, o in live
                      if j != i and o["user_id"] == r["user_id"])[:k]
        for s, j in near:
            if -s >= threshold:
                out[(r["user_id"], min(i, j), max(i, j))] = -s
    return out


@pytest.mark.parametrize("strategy", ["scan", "cells"])
@pytest.mark.parametrize("threshold", [0.6, 0.92])
def test_pairs(spark, strategy, threshold):
    rows = table()
    got = near_duplicate_pairs(memories(spark, rows), NOW, threshold, 4, strategy, block_rows=16).collect()
    want = model_pairs(rows, threshold, 4)
    assert {(r.user_id, r.id_a, r.id_b): r.similarity for r in got} == pytest.approx(want)
    assert len(got) == len(want)


def test_clusters(spark):
    rows = table()
    pairs = model_pairs(rows, 0.92, 10)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for (_, a, b), s in pairs.items():
        g = groups.setdefault(root(a), [set(), 0.0, 0])
        g[0] |= {a, b}
        g[1], g[2] = max(g[1], s), g[2] + 1
    order = sorted(groups, key=lambda g: (-groups[g][1], g))[:2]
    got = {}
    for r in near_duplicate_clusters(memories(spark, rows), NOW, max_groups=2).collect():
        g = got.setdefault(r.cluster_id, [set(), r.max_similarity, r.pair_count, r.rank])
        g[0].add(r.id)
        assert r.total_pairs == len(pairs)
    assert got == {g: [*groups[g], i + 1] for i, g in enumerate(order)}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(chain + star + [(500, 501)], "id_a long, id_b long")
    got = {r.id: r.label for r in connected_components(edges).collect()}
    want = {i: 1 for i in range(1, 61)} | {1000 + i: 1000 for i in range(200)} | {500: 500, 501: 500}
    assert got == want


def test_bounds(spark):
    m = memories(spark, table(5))
    with pytest.raises(RequestError):
        near_duplicate_pairs(m, NOW, 0.3)
    with pytest.raises(RequestError):
        near_duplicate_clusters(m, NOW, max_groups=0)
