"""Prefix trie, repeated strings and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ranked, suffixes, trie
from tests.llm import cases

TURNS = "conv_id long, turn long, role string, text string, key string, path string, h int, shard int"


def turns_table(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", 1, 2) for r in rows], TURNS).repartition(3)


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), role, key, text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = [k for k in members if len(k) == len(node) + 1 and k[:len(node)] == node]
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(out[k][6] for k in kids)
        ends = sorted(c for c in members[node] if len(made[c]) == len(node))
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids),
                     sum(out[k][5] for k in kids) or 1, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=repr)


def some_turns(seed, n, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choices(words, k=2))) for c in rng.sample(range(3 * n), n) for t in range(rng.randrange(1, 9))]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_trie(spark, shards, monkeypatch):
    monkeypatch.setattr(trie, "ENDS", 3)
    rows = some_turns(1, 130, ["a", "b"])
    rows += [(1000 + i, t, "user", "the same") for i in range(40) for t in range(3)]         # one path of many conversations
    rows += [(5, None, None, None), (5, None, "user", ""), (7, 3, "user", "x"), (7, 3, "user", "x"), (-250, 1, "u", "neg"), (None, 1, "u", "lost"),
             (2000, 0, "user", "é" * 5000), (2001, 0, "user", "é" * 5000)] + [(2100, t, "user", f"turn {t}") for t in range(300)]
    got = trie.prefix_trie(turns_table(spark, rows), shards=shards)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(turns_table(spark, []).filter("false")).count() == 0
    only = trie.prefix_trie(turns_table(spark, [(1, 0, "u", "x")])).collect()       # its first turns are those of an absent conversation
    assert [tuple(r) for r in only] == plain_trie([(1, 0, "u", "x")])


def test_skeleton_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(trie, "SKELETON_BYTES", 40)
    rows = some_turns(2, 60, ["a", "b"])
    assert sorted(map(tuple, trie.prefix_trie(turns_table(spark, rows), shards=20).collect()), key=repr) == plain_trie(rows)


def plain_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(x[i:i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for (i, _), x in zip(rows, data):
        gone = np.zeros(len(x) + 1, bool)
        for s in range(len(x) - length + 1):
            if count[x[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone[:-1]])
        out.append((i, kept, len(x), len(x) - len(kept), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())))
    return sorted(out, key=repr)


def got_repeats(df):
    return sorted(((r.id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in df.collect()), key=repr)


def test_repeats_of_awkward_rows(spark):
    extra = [(200, "a" * 5000), (201, "ab" * 700), (202, "é" * 130), (203, "x" * 199), (204, "x" * 199), (205, "y" * 200), (206, "q" + "y" * 200)]
    docs = cases.table(spark).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r[0], r[1]) for r in cases.rows()] + extra
    assert got_repeats(suffixes.drop_repeats(docs)) == plain_repeats(rows, 200)
    assert suffixes.drop_repeats(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("batches, task_regions, small", [(1, 256, 1 << 24), (5, 3, 1 << 24), (8, 3, 0)])
def test_repeats_of_overlapping_passages(spark, monkeypatch, batches, task_regions, small):
    monkeypatch.setattr("factloom.operators.skew.SMALL_BYTES", small)
    monkeypatch.setattr(suffixes, "_PART", 150)            # long texts in several parts
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    rows = []
    for i in range(60):
        a, b = sorted(rng.sample(range(401), 2))
        rows.append((i, "".join(rng.choices("abcd", k=rng.randrange(60))) + passage[a:b] + "".join(rng.choices("abcd", k=rng.randrange(60)))))
    rows += [(60, passage + passage), (61, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_repeats(suffixes.drop_repeats(docs, length=50, gram=8, batches=batches, task_regions=task_regions)) == plain_repeats(rows, 50)


def test_levels_carry_like_a_counter(spark):
    family, seen, sizes = suffixes.SuffixLevels(), Counter(), []
    for k in range(7):
        batch = [(g, 1) for g in ([1, 2] if k == 0 else [2, 10 + k, 10 + k] if k == 5 else [100 + k, 1 if k == 6 else 200 + k])]
        found = {r.g for r in family.add(spark.createDataFrame(batch, "g long, times int")).collect()}
        new = Counter(g for g, _ in batch)
        assert found >= {g for g in new if new[g] + seen[g] > 1} and found <= {g for g in new if new[g] + seen[g] > 1} | {g for g in seen if seen[g] > 1}
        seen += new
        sizes.append([rank for rank, _ in family.levels])
    assert sizes == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]


def plain_ranking(docs, items, top=20):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(cases.LOWER))
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def search_cases(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(1000 + i, " ".join(rng.choices(vocab, weights=[1 / (j + 1) for j in range(300)], k=rng.choice([3, 30, 300])))) for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=8))) for i in range(12)] + [(3, "w1 W1 w2 The Stone bridge"), (None, "w5 zero"), (50, None), (51, "..."), (52, "unknownterm"),
                                                                        (3, "w1 W1 w2 The Stone bridge"), (53, "short")]
    return docs, items


@pytest.mark.parametrize("batch_terms, small", [(1 << 14, 1 << 24), (20, 0)])
def test_ranking(spark, tmp_path, monkeypatch, batch_terms, small):
    monkeypatch.setattr("factloom.operators.skew.SMALL_BYTES", small)
    monkeypatch.setattr(ranked, "BLOCK_CELLS", 1 << 14)
    docs, items = search_cases(spark)
    table = cases.table(spark).select("doc_id", "text").unionByName(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("bound", F.lit(1))
    asked = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, q int")
    path = str(tmp_path / "index")
    ranked.build_index(table, path)
    got = ranked.search(table, asked, path, batch_terms=batch_terms).collect()
    want = plain_ranking([(r[0], r[1]) for r in cases.rows()] + docs, items)
    assert sorted(((r.item_id, r["rank"], r.id, r.score) for r in got), key=repr) == want


def test_bounds_are_never_too_low(spark, tmp_path):
    docs, items = search_cases(spark)
    ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    held = {i: Counter(ranked.terms_of(t.encode())) for i, t in docs}
    df = Counter(t for c in held.values() for t in c)
    own = [list(Counter(ranked.terms_of((t or "").encode())).items()) for _, t in items]
    weights = {t: 10 + df[t] for x in own for t, _ in x}
    batch = ranked._Batch(list(weights), weights, own, len(docs), sum(sum(c.values()) for c in held.values()))
    for r in spark.read.parquet(str(tmp_path / "i")).filter("capacity > 0").collect():
        bounds = batch.bounds(r.capacity, r.levels, np.array(r.sizes), bytes(r.slices))
        for q in range(len(items)):
            for k, i in enumerate(r.ids):
                assert bounds[q, k] >= batch.score(q, held[i], r.sizes[k])


def test_search_of_nothing(spark):
    empty, items = cases.empty(spark), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.rank(empty, items).count() == 0
    assert ranked.rank(cases.table(spark), items.filter("false")).count() == 0
