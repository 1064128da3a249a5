"""What one worker of a kNN join holds is bounded, whatever the number of rows."""

import numpy as np

from factloom.functions import vectors as V
from factloom.operators import knn


def test_a_group_of_queries_is_no_larger_than_its_children_allow(spark, monkeypatch):
    dim, n = 8, 200
    rng = np.random.default_rng(3)
    rows = [(i, "p", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, dim)))]
    base = spark.createDataFrame(rows, "id long, part string, vec array<float>")
    q = base.selectExpr("id as query_id", "part", "vec", "cast(null as double) as floor")
    whole = {tuple(r) for r in knn.knn_join(q, base, 3, strategy="cells", block_rows=32, max_pivots=8).collect()}
    salts, plain = [], knn.join_unique
    monkeypatch.setattr(knn, "ROUTE_BYTES", 8 * dim * 4 * 10)       # ten queries that go on to eight children
    monkeypatch.setattr(knn, "join_unique", lambda left, right, *a, **o: ("salts" in right.columns and "nq" in right.columns
                        and salts.extend(r[0] / r[1] for r in right.select("nq", "salts").collect())) or plain(left, right, *a, **o))
    assert {tuple(r) for r in knn.knn_join(q, base, 3, strategy="cells", block_rows=32, max_pivots=8).collect()} == whole
    assert salts and max(salts) <= 80


def test_a_pass_keeps_no_more_than_k(monkeypatch):
    unit = np.eye(4)[np.zeros(50, int)]
    block = V.Block(np.arange(50), unit, np.ones(50, bool))
    monkeypatch.setattr(V, "_CELLS_PER_PASS", 100)
    sizes, plain = [], V.merge_top
    monkeypatch.setattr(V, "merge_top", lambda parts, k: sizes.append(sum(len(p[0]) for p in parts)) or plain(parts, k))
    got = V.top_pairs(block, block, 3, False)
    assert len(got[0]) == 150 and max(sizes) <= 150      # once all 2,500 equal pairs
