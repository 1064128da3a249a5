"""Vectors without groups: the cells would multiply the rows, so the queries are scanned in rounds."""

import numpy as np
import pytest

from factloom.operators import knn


def points(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    vec = rng.normal(size=(n, dim)).astype(np.float32)
    vec[n // 2:n // 2 + 9] = vec[:9] + 0.1 * rng.normal(size=(9, dim)).astype(np.float32)
    unit = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    rows = [(i, f"p{i % 2}", [float(x) for x in v]) for i, v in enumerate(vec)]
    return spark.createDataFrame(rows, "id long, part string, vec array<float>"), np.round(unit @ unit.T, 9)


@pytest.mark.parametrize("floor", [0.8, None])
def test_rounds_give_what_all_pairs_give(spark, monkeypatch, floor):
    n, dim, k = 400, 16, 3
    base, score = points(spark, n, dim, 11)
    routed = []
    plain = knn._children
    monkeypatch.setattr(knn, "_children", lambda *a, **o: routed.append((a[3], o.get("counted", False))) or plain(*a, **o))
    monkeypatch.setattr(knn, "VISITS", 2)
    monkeypatch.setattr(knn, "SCAN_BYTES", 4 * dim * 150)
    asked = base.selectExpr("id as query_id", "part", "vec", f"cast({'null' if floor is None else floor} as double) as floor")
    got = {(r.query_id, r.id, r.score) for r in knn.knn_join(asked, base, k, exclude_self=True, block_rows=16).collect()}
    want = set()
    for i in range(n):
        best = sorted((-score[i, j], j) for j in range(n) if j != i and j % 2 == i % 2 and score[i, j] >= (floor or -2))
        want |= {(i, j, round(-s, 9)) for s, j in best[:k]}
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert [c for own, c in routed if not own] == [True]        # counted once, never written


def test_links_by_rounds_connect_the_same(spark, monkeypatch):
    n, dim = 300, 16
    base, score = points(spark, n, dim, 12)
    monkeypatch.setattr(knn, "VISITS", 2)
    monkeypatch.setattr(knn, "SCAN_BYTES", 4 * dim * 100)
    asked = base.selectExpr("id as query_id", "part", "vec", "0.8 as floor")
    links = {tuple(sorted((r.id_a, r.id_b))) for r in knn.knn_links(asked, base, block_rows=16).collect() if r.id_a != r.id_b}
    assert links == {(i, j) for i in range(n) for j in range(i + 1, n) if i % 2 == j % 2 and score[i, j] >= 0.8}
