"""Mixing, licences, line dedup and decontamination against plain Python on the awkward table."""

import hashlib
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.llm import decontaminate, licenses, lines, mixing
from tests.llm import cases


def test_mixing(spark):
    sizes, table = mixing.plan(cases.table(spark))
    got = mixing.copies(sizes, table).collect()
    assert sorted(r["size"] for r in got) == sorted(len(cases.spaced(t[1])) for t in cases.rows())
    per = {}
    for r in got:
        per.setdefault(r.source, []).append(r)
        assert r.copies * r["size"] <= 3 * r["size"]
    total = sum(r["size"] for r in got)
    assert abs(sum(rs[0].target for rs in per.values()) - total) < 1e-6
    for rs in per.values():
        taken = sum(r.copies * r["size"] for r in rs)
        assert abs(taken - rs[0].target) <= max(r["size"] for r in rs)
        assert rs[0].source_size == sum(r["size"] for r in rs) and rs[0].target <= 3 * rs[0].source_size + 1e-6
    # plain water filling
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    cap, open_ = {s: 3 * per[s][0].source_size for s in per}, set(per)
    target = dict.fromkeys(per, 0.0)
    while True:
        rest = total - sum(cap[s] for s in per if s not in open_)
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rest / w > cap[s]}
        if not over:
            break
        open_ -= over
    for s in per:
        target[s] = weight[s] * rest / w if s in open_ else cap[s]
        assert abs(per[s][0].target - target[s]) < 1e-6
    again = mixing.copies(*mixing.plan(cases.table(spark))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    mixed = mixing.mix(cases.table(spark))
    assert mixed.columns == cases.table(spark).columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_realised_inclusion_shares(spark):
    """Over many draws every document is taken as often as its inclusion probability says, and long ones less often than short ones."""
    rng = random.Random(1)
    sizes = [rng.choice([3, 12, 40, 200, 900, 3000]) for _ in range(150)]
    room = 0.4 * sum(sizes)
    rows = spark.createDataFrame([(i, "s", n) for i, n in enumerate(sizes)], "id long, source string, size long")
    p = mixing.inclusion(rows, spark.createDataFrame([("s", room)], "source string, room double")).first().p
    classes = [min(len(bin(n)) - 2, 31) // 4 for n in sizes]
    chance = [p[c] for c in classes]
    assert abs(sum(q * n for q, n in zip(chance, sizes)) - room) < 1e-6 * room
    assert all(chance[i] >= chance[j] for i in range(150) for j in range(150) if sizes[i] <= sizes[j]) and min(chance) < 0.45 < max(chance)
    frame = spark.range(300).select(F.col("id").alias("draw")).crossJoin(spark.createDataFrame(
        [(i, n, q) for i, (n, q) in enumerate(zip(sizes, chance))], "id long, size long, p double"))          # a simulation, not the operator
    odds = mixing.random_odds(F.col("draw") * 1000 + F.col("id"), F.lit(0))
    keyed = frame.withColumn("key", mixing.rank_key(odds, F.col("p")))
    upto = F.sum("size").over(Window.partitionBy("draw").orderBy("key", "id"))
    taken = keyed.withColumn("taken", (upto - F.col("size") / 2 <= room).cast("int")).groupBy("id").agg(F.avg("taken").alias("share")).collect()
    off = [r.share - chance[r.id] for r in taken]
    assert max(map(abs, off)) < 0.15 and sum(x * x for x in off) / len(off) < 0.0016
    for c in set(classes):
        own = [r.share - chance[r.id] for r in taken if classes[r.id] == c]
        assert abs(sum(own) / len(own)) < 0.03


def test_rows_without_an_id_are_drawn_apart(spark):
    docs = spark.createDataFrame([(None, f"text {i} " * 5, "a") for i in range(200)] + [(1, "b " * 4000, "b")], "doc_id long, text string, source string")
    sizes, table = mixing.plan(docs, weights=(1, 9))
    got = {r.copies for r in mixing.copies(sizes, table).filter("source = 'a'").collect()}
    assert len(got) == 2


def test_running_sums_and_hot_source(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    sizes, table = mixing.plan(docs)
    got = mixing.copies(sizes, table).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 50 for r in got)


def plain_base(text):
    w, found = cases.alnum(text), []
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        found += [(s, label) for s in range(len(w) - len(p) + 1) if w[s:s + len(p)] == p]
    return w, found


def test_licenses(spark):
    extra = [(100, "Released under the MIT License."), (101, "All rights, reserved; general public license"), (102, "the MIT of license"),
             (103, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0."), (104, "license mit"),
             (105, "MIT license at the end"), (106, "cc by cc by cc cc by by")]
    docs = cases.table(spark).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = licenses.scan(docs).collect()
    texts = [(r[0], r[1]) for r in cases.rows()] + extra
    want = []
    for i, t in texts:
        w, found = plain_base(t)
        starts = [s for s, _ in found]
        want.append((i, len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
    assert sorted(((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == sorted(want, key=repr)
    labels = {r.id: r.labels for r in got}
    assert labels[100] == "mit" and labels[103] == "apache-2.0,cc-by,cc-by-nc" and labels[102] == "" and labels[101] == "gpl,reserved"
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(cases.empty(spark)).count() == 0


def test_a_notice_is_found_by_the_rare_words_of_the_file(spark):
    """The notice's own rarest words are missing from the second file: its rarest licence words find it all the same."""
    mit = next(t for t in licenses.TEXTS if t.label == "mit").words
    bsd = next(t for t in licenses.TEXTS if t.label == "bsd").words
    n, df = licenses.frequencies(spark.createDataFrame([(" ".join(mit),), (" ".join(bsd),)], "text string"), sorted(set(mit)))
    rarest = sorted(set(mit) - set("permission is hereby granted free of charge to any person obtaining".split()), key=lambda x: (df[x], x))[:3]
    damaged = ["x" if x in rarest else x for x in mit]
    docs = [(1, " ".join(mit)), (2, "intro words " + " ".join(damaged) + " outro"), (3, " ".join(bsd)), (4, " ".join(mit[:12])), (5, " ".join(["x", *mit[1:]])),
            (6, " ".join(mit[20:])), (7, " ".join(reversed(mit)))]
    got = {r.id: r.labels for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "mit", 3: "bsd", 4: "", 5: "", 6: "", 7: ""}


def test_one_rare_word_proposes_nothing(spark):
    docs = [(1, "released under the mit license"), (2, "mit license")]
    looked = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), rarest=1)
    assert {r.labels for r in looked.collect()} == {""}


def test_line_dedup(spark):
    got = lines.drop_shared_lines(cases.table(spark)).collect()
    last = 1 << 62
    holders = {}

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(cases.LOWER)

    for i, t, *_ in cases.rows():
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(last if i is None else i)
    want = []
    for i, t, *_ in cases.rows():
        own = last if i is None else i
        split = (t or "").split("\n")
        kept = [x for x in split if len(key(x)) < 10 or len(holders[key(x)]) < 2 or own == min(holders[key(x)])]
        want.append((i, "\n".join(kept), len(split), len(split) - len(kept)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    three = lines.drop_shared_lines(cases.table(spark), min_docs=6).filter("n_dropped > 0")
    assert three.count() == 0
    assert lines.drop_shared_lines(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_decontamination(spark, small, monkeypatch):
    if small:         # all lookups by shuffle, as with a large benchmark
        monkeypatch.setattr("factloom.operators.skew.SMALL_BYTES", 0)
    items = [(1, "Jumps over the lazy dog, near the old stone bridge while seven birds"), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"),
             (3, "another text"), (10, "jumps over the lazy dog near the old stone bridge"), (4, None), (5, "..."), (None, "zero"), (6, "no such words anywhere")]
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, id int, h int")
    got = decontaminate.contamination(cases.table(spark), bench).collect()
    windows = {}
    for i, t in items:
        w = cases.alnum(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[s:s + n]), set()).add(i)
    want = []
    for i, t, *_ in cases.rows():
        w, hit, found = cases.alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        want.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == sorted(want, key=repr)
    assert decontaminate.contamination(cases.empty(spark), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(cases.table(spark), bench.filter("false")).collect()} == {0}


def test_sha_of_kept(spark):
    r = lines.drop_shared_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).select(F.sha2("kept", 256).alias("s")).first()
    assert r.s == hashlib.sha256(b"a\nb").hexdigest() and re.fullmatch("[0-9a-f]{64}", r.s)
