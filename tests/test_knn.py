import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import knn
from factloom.operators.knn import knn_join
from tests.helpers import blends, score


def brute(queries, base, k, exclude_self=False, tags=False, seq=False):
    out = set()
    for qid, part, vec, floor, qtags, qseq in queries:
        if not np.any(vec):
            continue
        hits = []
        for bid, bpart, bvec, btags, bseq in base:
            if part != bpart or not np.any(bvec) or (exclude_self and qid == bid) or (seq and bseq >= qseq):
                continue
            if tags and qtags and not set(qtags) & set(btags):
                continue
            s = score(vec, bvec)
            if floor is None or s >= floor:
                hits.append((-s, bid))
        out |= {(qid, bid, -s, r + 1) for r, (s, bid) in enumerate(sorted(hits)[:k])}
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    vecs = blends(3, 240)
    vecs += [vecs[0]] * 120                    # a third of the rows are one and the same vector
    vecs[17] = [0.0] * 8
    names = ["a", "b", "c", "d"]
    base = [(i, "big" if rng.random() < 0.7 else f"p{rng.integers(6)}", v,
             [names[j] for j in rng.integers(0, 4, size=2)], int(rng.integers(400))) for i, v in enumerate(vecs)]
    queries = [(i, p, v, None if i % 3 else 0.9, t if i % 2 else [], s) for i, p, v, t, s in base]
    q = spark.createDataFrame(queries, "query_id long, part string, vec array<float>, floor double, "
                                       "tags array<string>, seq long")
    b = spark.createDataFrame(base, "id long, part string, vec array<float>, tags array<string>, seq long").repartition(3)
    return queries, base, q, b


@pytest.mark.parametrize("strategy", ["scan", "cells"])
@pytest.mark.parametrize("options", [{}, {"exclude_self": True}, {"tags": True}, {"seq": True, "exclude_self": True}])
def test_same_rows_as_brute_force(data, strategy, options):
    queries, base, q, b = data
    got = {tuple(r) for r in knn_join(q, b, 4, strategy=strategy, block_rows=32, max_pivots=8, **options).collect()}
    assert got == brute(queries, base, 4, **options)


@pytest.mark.parametrize("strategy", ["scan", "cells"])
def test_only_a_floor(data, strategy):
    queries, base, q, b = data
    q = q.withColumn("floor", F.lit(0.95))
    queries = [(*r[:3], 0.95, *r[4:]) for r in queries]
    got = {tuple(r) for r in knn_join(q, b, 3, strategy=strategy, block_rows=32, max_pivots=8).collect()}
    assert got == brute(queries, base, 3)


def test_no_queries(data):
    _, _, q, b = data
    assert knn_join(q.filter("false"), b, 3).isEmpty()


def test_wrong_dimension_is_an_error(data, spark):
    _, _, q, b = data
    short = spark.createDataFrame([(1, "big", [1.0, 2.0])], "id long, part string, vec array<float>")
    with pytest.raises(Exception, match="dimensions"):
        knn_join(q, short, 3, strategy="scan").collect()


def deep(tree):
    return max(r.cell.count("/") for r in tree.rows.select("cell").distinct().collect())


def clustered(spark, n, dim=8, per=250):
    """Groups of `per` rows around centres of their own: the more rows, the more groups."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(n // per, dim))
    vecs = (centres[np.arange(n) % len(centres)] + 0.03 * rng.normal(size=(n, dim))).astype(np.float32)
    rows = spark.createDataFrame(zip(range(n), vecs.tolist()), "id long, vec array<float>").withColumn("part", F.lit("p"))
    return rows.withColumn("floor", F.lit(0.95)).withColumn("query_id", F.col("id"))


@pytest.mark.parametrize("options", [{}, {"seq": True}])
def test_a_deep_tree_gives_the_same_rows(data, options):
    queries, base, q, b = data
    got = {tuple(r) for r in knn_join(q, b, 4, strategy="cells", block_rows=16, max_pivots=4, **options).collect()}
    assert got == brute(queries, base, 4, **options)
    how = knn._Join(4, 8, False, False, False)
    assert deep(knn._grow(b.select("id", "part", "vec"), how, 2, 16, 4)) >= 3


def test_scored_pairs_stay_flat(spark):
    """Four pivots a node: the cells that a query visits hold as many rows of 8,000 as of 2,000."""
    per_query = []
    for n in (2000, 8000):
        rows = clustered(spark, n)
        how = knn._Join(5, 8, False, False, False)
        tree = knn._grow(rows.select("id", "part", "vec"), how, 64, 128, 4)
        asked = knn._descend(rows.filter("id % 20 = 0").select("query_id", "part", "vec", "floor"), tree, how, False)
        held = tree.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        per_query.append(asked.join(held, "cell").agg(F.sum("n")).first()[0] / (n / 20))
    assert per_query[1] < 1.5 * per_query[0] and per_query[1] < 1600


@pytest.mark.parametrize("strategy", ["scan", "cells"])
def test_links_connect_what_is_near(spark, data, strategy):
    queries, _, q, b = data
    near = q.filter("query_id % 2 = 0").withColumn("floor", F.lit(0.97))
    links = knn.knn_links(near, b, strategy, block_rows=32, max_pivots=4).collect()
    group = {i: i for i in range(len(queries))}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for x in links:
        group[root(x.id_a)] = root(x.id_b)
    want = {i: i for i in range(len(queries))}

    def plain(i):
        while want[i] != i:
            i = want[i]
        return i

    for i, part, vec, *_ in queries:
        for j, part_j, vec_j, *_ in queries:
            if i % 2 == 0 and part == part_j and np.any(vec) and np.any(vec_j) and score(vec, vec_j) >= 0.97:
                want[plain(i)] = plain(j)
    assert {(root(i) == root(j)) == (plain(i) == plain(j)) for i in range(0, len(queries), 3) for j in range(len(queries))} == {True}
    assert len(links) < 20 * len(queries)
