"""Scoring by leading numbers and in rounds gives what all pairs give, with less work."""

import numpy as np
import pytest

from factloom.functions import vectors as V
from factloom.operators import knn


def block(vec, floor=None, **more):
    norm = np.linalg.norm(vec, axis=1, keepdims=True)
    unit = np.divide(vec, norm, out=np.zeros_like(vec), where=norm > 0)
    return V.Block(np.arange(len(vec)), unit, norm[:, 0] > 0, floor=None if floor is None else np.full(len(vec), floor), **more)


def unrelated(n, dim, rank, seed):
    """Vectors without groups, some near copies, equal ones and a zero one among them."""
    rng = np.random.default_rng(seed)
    vec = np.take(rng.normal(size=(n, rank)), np.arange(dim) % rank, axis=1)
    vec[n // 2:n // 2 + 40] = vec[:40] + 0.3 * rng.normal(size=(40, dim))
    vec[-3:-1], vec[-1] = vec[0], 0
    return vec


@pytest.mark.parametrize("rank", [32, 64])
def test_leading_numbers_leave_out_no_pair(rank):
    vec = unrelated(900, 64, rank, 5)
    q, b = V.turned(block(vec, 0.9), block(vec))
    assert 0 < q.lead.shape[1] < 30
    score = np.round(q.unit @ q.unit.T, 9)
    able = q.usable[:, None] & q.usable[None, :]
    want = {(i, j) for i, j in zip(*np.nonzero((score >= 0.9) & able)) if i != j}
    got = V.top_pairs(q, b, 900, True)
    assert set(zip(got[0].tolist(), got[1].tolist())) == want
    assert len(V._reaching(q.lead, b.lead, np.full(900, 0.9, np.float32))[0]) < 900 * 900 / 50
    a, c, _ = V.link_pairs(q, b)
    label = V._joined(np.arange(900), a, c)
    assert all(label[i] == label[j] for i, j in want) and all((x, y) in want or label[x] == label[y] for x, y in zip(a, c))


def test_pieces_of_cells_leave_out_no_pair():
    vec = unrelated(3000, 32, 16, 9)
    b = block(vec)
    cell = (b.unit @ b.unit[:60].T).argmax(axis=1)
    one = np.flatnonzero(cell < 30)             # a batch holds some cells whole
    q, b = V.turned(block(vec[:800], 0.9), b.take(one))
    i, j = V.by_pieces(q, b, cell[one])
    score = np.round(q.unit @ b.unit.T, 9)
    want = {(x, y) for x, y in zip(*np.nonzero((score >= 0.9) & q.usable[:, None] & b.usable[None, :]))}
    assert want and want <= set(zip(i.tolist(), j.tolist()))
    got = V.top_pairs(q, b, 3000, False, cell[one])
    assert set(zip(got[0].tolist(), got[1].tolist())) == {(x, int(b.ids[y])) for x, y in want}
    links = V.link_pairs(q, b, cell[one])
    label = V._joined(np.arange(3000), links[0], links[1])
    assert all(label[x] == label[b.ids[y]] for x, y in want)


def test_floors_rise_with_what_was_found(monkeypatch):
    vec = unrelated(3000, 16, 16, 6)
    rng = np.random.default_rng(1)
    q, b = block(vec[:200], 0.1), block(vec)
    q.tags, b.tags = (rng.random((200, 2)) < 0.5).astype(np.float32), (rng.random((3000, 2)) < 0.4).astype(np.float32)
    seen, plain = [], V._few
    monkeypatch.setattr(V, "_few", lambda q, b, i, j, x: seen.append(len(i)) or plain(q, b, i, j, x))
    got = V.top_pairs(q, b, 5, False)
    score = np.round(q.unit @ b.unit.T, 9)
    free = (q.tags.sum(axis=1) == 0)[:, None] | (q.tags @ b.tags.T > 0)
    ok = (score >= 0.1) & free & b.usable[None, :]
    want = {(i, j) for i in range(200) for _, j in sorted((-score[i, j], j) for j in np.flatnonzero(ok[i]))[:5]}
    assert set(zip(got[0].tolist(), got[1].tolist())) == want
    assert sum(seen) < (score >= 0.1).sum() / 3       # a fixed floor would look at all of these
    assert (q.floor == 0.1).all()


def points(spark, n, dim, seed):
    vec = unrelated(n, dim, dim, seed).astype(np.float32)
    rows = [(i, f"p{i % 2}", [float(x) for x in v]) for i, v in enumerate(vec)]
    return spark.createDataFrame(rows, "id long, part string, vec array<float>")


def no_tree(monkeypatch):
    def grown(*a, **o):
        raise AssertionError("a tree was grown")
    monkeypatch.setattr(knn, "_grow", grown)


def test_a_probe_spares_the_tree_and_rounds_score_a_pair_once(spark, monkeypatch):
    n, dim = 600, 32
    base = points(spark, n, dim, 7)
    want = {(r.id_a, r.id_b) for r in knn.knn_links(base.selectExpr("id as query_id", "part", "vec", "0.8 as floor"), base, "cells", block_rows=16).collect()}
    no_tree(monkeypatch)
    for name, value in (("PROBE_ROWS", 100), ("VISITS", 2), ("SCAN_BYTES", 4 * dim * 100)):
        monkeypatch.setattr(knn, name, value)
    sides, plain = [], knn._scan
    monkeypatch.setattr(knn, "_scan", lambda q, b, *a: sides.append((q.count(), b.count())) or plain(q, b, *a))
    flagged = base.selectExpr("*", "id % 3 != 0 as both")
    asked = flagged.selectExpr("id as query_id", "part", "vec", "0.8 as floor", "both")
    got = {(r.id_a, r.id_b) for r in knn.knn_links(asked, flagged, block_rows=16, both="both").collect()}

    def groups(links):
        label = V._joined(np.arange(n), *(np.array([x[i] for x in links if x[0] != x[1]]) for i in (0, 1)))
        return label.tolist()
    assert groups(got) == groups(want)
    assert sum(q * b for q, b in sides) < 0.85 * (n - 1) ** 2


def test_rounds_over_a_sorted_base_give_the_same(spark, monkeypatch):
    n, dim, k = 1500, 16, 3
    base = points(spark, n, dim, 10)
    q = base.selectExpr("id as query_id", "part", "vec", "0.85 as floor")
    want = {tuple(r) for r in knn.knn_join(q, base, k, strategy="scan", exclude_self=True).collect()}
    no_tree(monkeypatch)
    for name, value in (("PROBE_ROWS", 1000), ("VISITS", 2), ("SCAN_BYTES", (4 * dim + 24 * k) * 400), ("SORTED_ROWS", 25)):
        monkeypatch.setattr(knn, name, value)
    cells, plain = [], knn._scan
    monkeypatch.setattr(knn, "_scan", lambda q, b, *a: cells.append(b.select("cell").distinct().count()) or plain(q, b, *a))
    assert {tuple(r) for r in knn.knn_join(q, base, k, exclude_self=True, block_rows=16).collect()} == want and want
    assert len(cells) == 4 and min(cells) > 20


def test_few_base_rows_are_held_for_many_queries(spark, monkeypatch):
    n, dim, k = 600, 32, 2
    rows = points(spark, n, dim, 8)
    q, base = rows.selectExpr("id as query_id", "part", "vec", "0.7 as floor"), rows.filter("id < 60")
    want = {tuple(r) for r in knn.knn_join(q, base, k, strategy="scan", exclude_self=True).collect()}
    no_tree(monkeypatch)
    for name, value in (("PROBE_ROWS", 100), ("VISITS", 2), ("SCAN_BYTES", 4 * dim * 40)):
        monkeypatch.setattr(knn, name, value)
    held, plain = [], knn._scan
    monkeypatch.setattr(knn, "_scan", lambda q, b, how, hold: held.append(hold) or plain(q, b, how, hold))
    assert {tuple(r) for r in knn.knn_join(q, base, k, exclude_self=True, block_rows=16).collect()} == want and want
    assert held == [True, True]
