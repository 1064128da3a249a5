import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from factloom.llm import simhash
from tests.llm import cases


def plain_print(text, k=3):
    w = cases.spaced((text or "").translate(cases.LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    """id -> least id reachable, over {id: fingerprint}."""
    label = {i: i for i in prints}
    while True:
        new = {i: min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= distance) for i in prints}
        if new == label:
            return label
        label = new


def test_all_cases(spark):
    got = simhash.near_duplicates(cases.table(spark)).collect()
    assert len(got) == len(cases.rows())
    assert sorted(r.fingerprint for r in got) == sorted(f"{plain_print(t[1]):016x}" for t in cases.rows())
    # id 9 is a repeated row, id 15 has two texts: rows with one id and several fingerprints link over the id's own rows
    known = {}
    for i, t, *_ in cases.rows():
        if i not in (None, 15):
            known[i] = plain_print(t)
    want = plain_components(known, 3)
    for r in got:
        if r.id in want:
            assert r.component_id == want[r.id], r
    assert {r.component_id for r in got if r.id is None} == {1, 5}      # they follow their fingerprint
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("cell_rows", [4096, 5])
def test_every_pair_within_three_bits(spark, cell_rows):
    """Random fingerprints with planted neighbours at every distance; cells of five rows force the split."""
    random.seed(cell_rows)
    prints = {}
    for _ in range(60):
        base = random.getrandbits(64)
        for d in range(7):
            value = base
            for b in random.sample(range(64), d):
                value ^= 1 << b
            prints[len(prints)] = value
    centre = random.getrandbits(64)
    for _ in range(80):                   # one dense group
        prints[len(prints)] = centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in prints.values()]
    pairs = simhash._pairs(spark.createDataFrame(signed, "print long").distinct(), 3, cell_rows).collect()
    values = sorted(set(prints.values()))
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for r in pairs:
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        group[root(a)] = root(b)
    want = plain_components({v: v for v in values}, 3)
    found = {}
    for v in values:
        found.setdefault(root(v), set()).add(v)
    wanted = {}
    for v in values:
        wanted.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_tables_and_shingles():
    text = cases.BASE.encode()
    prints = simhash.fingerprint(text, 5, 4)
    assert len(set(prints)) == 4 and simhash.fingerprint(text, 5, 1) == prints[:1]
    assert simhash.fingerprint(None, 5, 2) == [0, 0]
    assert np.int64(simhash.fingerprint(text, 3, 1)[0]).astype(np.uint64) == plain_print(cases.BASE)
