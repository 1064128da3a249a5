"""The near-duplicate stage against a plain comparison of all pairs."""

import random

import corpus_pipeline
from factloom.llm import shingles

SHINGLE_WORDS, SIMILARITY = corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY


def plain_set(text):
    found = (text or "").lower().split()
    if len(found) < SHINGLE_WORDS:
        return {tuple(found)} if found else set()
    return set(zip(*(found[i:] for i in range(SHINGLE_WORDS))))


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_groups(texts):
    """Per text the number of the first text of its group."""
    sets, group = [plain_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= SIMILARITY:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def grouped(spark, texts, **settings):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: r.label for r in shingles.near_duplicates(
        df, SHINGLE_WORDS, SIMILARITY, corpus_pipeline.MAX_DISTANCE, corpus_pipeline.TABLES, **settings).collect()}
    first = {}
    return [first.setdefault(got[i], i) for i in range(len(texts))]


def pairs(changed, seed):
    """Texts of 300 words, each followed by a copy with so many words in a row replaced."""
    some, texts = random.Random(seed), []
    for n in changed:
        words = [f"w{some.randrange(100_000)}" for _ in range(300)]
        at = 10 + some.randrange(100)
        texts += [" ".join(words), " ".join(words[:at] + [f"x{some.randrange(100_000)}" for _ in range(n)] + words[at + n:])]
    return texts


def test_pairs_from_the_least_similarity_up_are_found(spark):
    texts = pairs([2 + i * 26 // 59 for i in range(60)], 1)
    near = [similarity(plain_set(a), plain_set(b)) for a, b in zip(texts[::2], texts[1::2])]
    assert min(near) < 0.81 and max(near) > 0.95 and all(s >= SIMILARITY for s in near)
    assert grouped(spark, texts) == plain_groups(texts)


def test_pairs_below_the_least_similarity_stay_apart(spark):
    texts = pairs([30 + i % 40 for i in range(60)], 2)
    near = [similarity(plain_set(a), plain_set(b)) for a, b in zip(texts[::2], texts[1::2])]
    assert min(near) > 0.5 and 0.75 < max(near) < SIMILARITY
    assert grouped(spark, texts) == list(range(len(texts)))


def test_bands_whose_owner_is_no_neighbour(spark):
    some = random.Random(3)
    words = [f"w{some.randrange(100_000)}" for _ in range(900)]
    chain = [" ".join(words[i:i + 300]) for i in range(0, 600, 25)]          # 0.85 from one to the next
    spread = [" ".join(words[i:i + 300]) for i in range(0, 600, 40)]
    short = ["", None, " \n", "One two", "one  two", "one", "a b c d", "a b c d e", "a b c d e f"]
    texts = chain + pairs([10] * 6, 4) + short
    want = plain_groups(texts)
    assert len(set(want[:len(chain)])) == 1
    assert grouped(spark, texts) == want and grouped(spark, texts, block_rows=2) == want
    assert grouped(spark, spread, block_rows=2) == plain_groups(spread)


def test_stage_keeps_the_rows_of_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    want = [r.doc_id for r, g, i in zip(rows, plain_groups([r.text for r in rows]), range(len(rows))) if g == i]
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).select("doc_id").collect()]
    assert sorted(got) == want


def test_a_group_that_bands_connect_is_not_compared_for_every_cell(spark, monkeypatch):
    some = random.Random(5)
    words = [f"w{some.randrange(100_000)}" for _ in range(300)]
    texts = [" ".join(words[:i] + ["changed"] + words[i + 1:]) for i in range(20, 260, 3)]
    joined, plain = [], shingles._with

    def counted(pairs, right, side, *rest):
        if right.columns[1] == "set" and side == "a":
            joined.append(pairs.count())
        return plain(pairs, right, side, *rest)

    monkeypatch.setattr(shingles, "_with", counted)
    assert grouped(spark, texts) == [0] * len(texts) == plain_groups(texts)
    owners = spark.createDataFrame([(t,) for t in texts], "text string").select(
        shingles._sketches(shingles.F.col("text"), SHINGLE_WORDS, 1).alias("s")).collect()
    least = {}
    for r in owners:
        for b in r.s.bands:
            least[b] = min(least.get(b, r.s.node), r.s.node)
    met = {(least[b], r.s.node) for r in owners for b in r.s.bands if least[b] != r.s.node}
    assert sum(joined) <= len(met) + corpus_pipeline.TABLES * len(texts)        # an owner for every band, and for every table
