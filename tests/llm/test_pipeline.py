"""Every stage of the pipeline against a plain version of its rule."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import mixing, simhash, toxicity
from factloom.llm.common import read
from tests.llm import cases


def test_stages_keep_columns_and_their_rules(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "decontamination", "mixing", "tokens"]
    docs = cases.table(spark)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert got.columns == docs.columns and got.count() <= 3 * docs.count()
        assert stage(spark, cases.empty(spark), sf_dir).count() == 0


def shingles(text):
    w = cases.spaced((text or "").translate(cases.LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_near(rows):
    """The rows that stay: of every component of similarity 0.8 the first by id (null last); of rows equal in id and text one."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                group[root(i)] = root(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        first.setdefault(root(i), []).append((doc is None, doc or 0))
    return sorted(min(x) for x in first.values())


def changed(words, share, rng):
    out = words.copy()
    for at in rng.sample(range(len(out)), int(share * len(out))):
        out[at] = f"new{rng.randrange(10 ** 6)}"
    return out


def test_near_duplicates_against_all_pairs(spark, sf_dir):
    rng = random.Random(11)
    rows = []
    for g in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 500]))]
        rows.append((len(rows), " ".join(words)))
        for share in rng.sample([0.0, 0.004, 0.01, 0.015, 0.02, 0.04, 0.08, 0.2], 3):
            rows.append((len(rows), " ".join(changed(words, share, rng))))
    rows += [(None, rows[0][1]), (None, "nobody else has this text at all"), (None, "nobody else has this text at all"), (3, "another text of an id that is taken"),
             (1000, None), (1001, ""), (1002, " \n"), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string").repartition(4)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == plain_near(rows)
    texts = Counter((i, t) for i, t in rows)
    assert all((r.doc_id, r.text) in texts for r in kept)


def test_rows_of_one_id_are_judged_by_their_texts(spark, sf_dir):
    long = " ".join(f"word{i}" for i in range(50))
    rows = [(1, "first text of the id one two three"), (1, long), (2, long), (None, long), (None, "only here and nowhere else at all"), (2, long)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([rows[0], rows[1], rows[4]], key=repr)


def test_near_copies_go_and_others_stay(spark):
    words = [f"word{i * 7919 % 1000}" for i in range(400)]
    near = words.copy()
    near[200] = "changed"
    other = [f"thing{i * 31 % 777}" for i in range(400)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(words[:100]))], "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.near_duplicates(
        df, shingle_words=corpus_pipeline.SHINGLE_WORDS, max_distance=corpus_pipeline.MAX_DISTANCE, tables=corpus_pipeline.TABLES).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_tables_in_one_pass_take_few_jobs(spark):
    """Eight tables cost about as many jobs as one, and link what the tables link one by one."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, (80, 3), dtype=np.int64)
    rows = [(i, [int(x) for x in r]) for i, r in enumerate(base)]
    rows += [(100 + i, [rows[i][1][0] ^ (1 << i % 60), *rows[i + 1][1][1:]]) for i in range(40)] + [(200 + i, [5, *rows[i][1][1:]]) for i in range(3)]
    linked = spark.createDataFrame(rows, "rep long, prints array<long>")

    def components(edges):
        label = {i: i for i, _ in rows}
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    got = [(r.id_a, r.id_b) for r in simhash.table_links(linked, 3, 3).collect()]
    want = [(a, b) for a, x in rows for b, y in rows if a < b and any((p ^ q).bit_count() <= 3 if (p ^ q) >= 0 else ((p ^ q) & (1 << 64) - 1).bit_count() <= 3
                                                                       for p, q in zip(x, y))]
    assert components(got) == components(want)


def test_toxic_rows_go(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    net = toxicity.train(docs, read(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text").collect()
    scores = net.scores([r.text for r in rows])
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    assert kept == {r.doc_id for r, s in zip(rows, scores) if s < toxicity.REJECT}


def windows_of(words):
    return {tuple(words[i:i + 10]) for i in range(len(words) - 9)} if len(words) >= 10 else {tuple(words)} if words else set()


def test_contaminated_rows_go(spark, sf_dir):
    items = set().union(*(windows_of(cases.alnum(r.text)) for r in read(spark, sf_dir, "benchmark").collect()))
    docs = read(spark, sf_dir, "documents")
    sizes = {len(w) for w in items}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        w = cases.alnum(r.text)
        if not any(tuple(w[i:i + n]) in items for n in sizes for i in range(len(w) - n + 1)):
            want.add(r.doc_id)
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, sf_dir).collect()} == want


def test_mix_takes_what_the_plan_says(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    want = {r.id: r.copies for r in mixing.copies(*mixing.plan(docs)).collect() if r.copies}
    assert dict(Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect())) == want and max(want.values()) <= 3


@pytest.mark.parametrize("rows", [cases.rows()])
def test_token_files_of_the_stage(spark, sf_dir, rows):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.write_token_files(spark, cases.table(spark), sf_dir).collect()
    ids = [(i, plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in rows]
    want = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want


def test_whole_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens >= 1
        at += r.n_tokens
    assert got
