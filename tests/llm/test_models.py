"""Token codes, URL filter, secret scan, toxicity and embedding near duplicates."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import embedding_dups, secrets, tokens, toxicity, urls
from factloom.session import scratch_path
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = rng.choice([0, 1, 255, 256, 49_000, 65_535, 65_536, 4_000_000_000], n).astype(np.uint32)
        codes = tokens.Codes(tokens.encode_ids(ids))
        assert len(codes) == n and codes.tokens(0, n).tolist() == ids.tolist()
        for i in rng.integers(0, n, 40) if n else ():
            assert codes.token(int(i)) == ids[i]
            lo = int(rng.integers(0, i + 1))
            assert codes.tokens(lo, int(i)).tolist() == ids[lo:i].tolist()
        with pytest.raises(IndexError):
            codes.token(n)
    with pytest.raises(ValueError):
        tokens.Codes(b"none")


def test_encoder_equals_the_library():
    random.seed(4)
    signs = list("abcXYZ019'.,!?;:-_&%$#@()<>|/\\\"\t\n \r\x0b\x0c\x1c\x85\xa0éÉßÑİıſΣσς\u0338\u0327\u0301中가가🙂ﬁ\u2028\u200dA\u030a") + [
        "'s", "'ll", "<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", " the ", "Word, "]
    texts = [None, ""] + ["".join(random.choice(signs) for _ in range(random.randint(0, 30))) for _ in range(8000)]
    import pyarrow as pa
    plain = Tokenizer.from_file(PATH)
    for t, got in zip(texts, tokens.Encoder(PATH).encode(pa.array(texts), 1)):
        assert np.frombuffer(got, "<u4").tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 1], repr(t)


@pytest.mark.parametrize("segment", [50, 1 << 18])
def test_token_files(spark, segment):
    path = scratch_path(spark, "tokens-test")
    tokens.write_tokens(cases.table(spark), path, PATH, segment_tokens=segment)
    got = tokens.read_tokens(spark, path).collect()
    plain = Tokenizer.from_file(PATH)
    ids = [(i, plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in cases.rows()]
    want = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))
    rows = spark.read.parquet(path).collect()
    some = tokens.Segment(rows[0].payload)
    assert some.document(0)[-1] == 1 and some.codes.token(int(some.starts[1]) - 1) == 1
    tokens.write_tokens(cases.empty(spark), path + "-empty", PATH)
    assert tokens.read_tokens(spark, path + "-empty").count() == 0


def test_a_token_is_read_without_other_segments(spark):
    path = scratch_path(spark, "tokens-random")
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 97} x" for j in range(1 + i % 9))) for i in range(300)], "doc_id long, text string")
    tokens.write_tokens(docs, path, PATH, segment_tokens=200)
    plain = Tokenizer.from_file(PATH)
    each = [plain.encode(r.text, add_special_tokens=False).ids + [1] for r in docs.orderBy("doc_id").collect()]
    every = [t for x in each for t in x]
    held = spark.read.parquet(path)
    assert held.count() > 10
    for lo, hi in ((0, 1), (777, 778), (len(every) - 1, len(every)), (150, 900), (0, len(every)), (len(every), len(every) + 5)):
        got = tokens.read_range(spark, path, lo, hi).collect()
        assert [r.token for r in sorted(got)] == every[lo:hi] and [r.place for r in sorted(got)] == list(range(lo, min(hi, len(every))))
    for i in (0, 123, 299):
        assert [r.ids for r in tokens.document(spark, path, i).collect()] == [each[i]]
    assert tokens.document(spark, path, 300).count() == 0
    # With every other payload ruined, the read still works: it touches one segment.
    other = scratch_path(spark, "tokens-ruined")
    mine = held.select("part", "first", "last", "least_id", "most_id").orderBy("part", "first").collect()[3]
    base = next(r.base for r in tokens._bases(held).collect() if r.part == mine.part)
    own = (F.col("part") == mine.part) & (F.col("first") == mine["first"])
    held.withColumn("payload", F.when(own, F.col("payload")).otherwise(F.lit(b"ruined"))).write.option("compression", "none").parquet(other)
    place = base + mine["first"] + 5
    assert tokens.read_range(spark, other, place, place + 1).collect()[0].token == every[place]
    only = [i for i in range(mine.least_id, mine.most_id + 1)][1]
    assert tokens.document(spark, other, only).collect()[0].ids == each[only]


def test_urls(spark):
    pages = [(1, "http://a.example.com/en/x"), (2, "HTTP://WWW.Example.COM/en/"), (3, "https://b.net/es/1?q"), (4, "https://b.net/de/1"), (5, None),
             (6, "no scheme"), (7, "x://host"), (8, "x://host?q=/a"), (9, "http://com/"), (10, "http://notexample.com/en/"), (None, "http://b.net/fr/#x"),
             (3, "https://b.net/es/1?q"), (11, "http://good.org/a"), (12, "ftp://u@h.co.uk:80/p/q?r#s"), (13, "http://example.com"), (14, "a://b://c.net/es/")]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id long, url string, host string, n int")
    got = {(r.id, r.host, r.path, r.rule): r.verdict for r in urls.judge(df).collect()}
    assert len(got) == len(pages) - 1
    assert got[1, "a.example.com", "/en/x", "example.com/en/"] == "block" and got[2, "www.example.com", "/en/", "www.example.com/en/"] == "allow"
    assert got[9, "com", "/", "com/"] == "allow" and got[10, "notexample.com", "/en/", "com/"] == "allow" and got[None, "b.net", "/fr/", "net/fr/"] == "block"
    assert {(5, "", "", None), (6, "", "", None), (7, "host", "", None), (8, "host", "", None), (13, "example.com", "", None)} <= set(got)
    assert (12, "u@h.co.uk:80", "/p/q", None) in got and (14, "b:", "//c.net/es/", None) in got
    assert urls.judge(df.filter("false")).count() == 0


def test_reputation_shrinks(spark):
    hosts = spark.createDataFrame([("a.bad.net", 50, 50), ("new.bad.net", 0, 0), ("one.good.org", 1, 1), ("x.good.org", 60, 0), ("y.other.org", 40, 0)],
                                  "host string, n long, bad long")
    got = {r.host: r for r in urls.reputation(hosts).collect()}
    assert got["a.bad.net"].low > 0.5 and got["new.bad.net"].rate > 0.5 and got["one.good.org"].low < 0.5 and got["x.good.org"].rate < 0.2
    assert all(r.low < r.rate for r in got.values())
    # A host without pages is less sure than one with many, and than its domain's pages would make it.
    assert got["new.bad.net"].rate - got["new.bad.net"].low > 2 * (got["a.bad.net"].rate - got["a.bad.net"].low)


def test_hosts_of_one_domain_are_told_apart(spark):
    """Unruled pages of a host that block rules catch often are blocked, those of its clean sibling stay."""
    pages = [f"http://bad.site.net/{lang}/{i}" for lang in ("es", "fr", "en") for i in range(40)]
    pages += [f"http://good.site.net/{lang}/{i}" for lang in ("de", "en") for i in range(60)] + [f"http://other.org/{i}" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {(r.host, r.verdict) for r in urls.judge(df).filter("rule is null").collect()}
    assert got == {("bad.site.net", "block"), ("good.site.net", "allow"), ("other.org", "allow")}


def plain_spans(text):
    value = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(value, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def test_rule_spans():
    random.seed(2)
    parts = ["password", "PassWd", "toKen", "ſecret", "apikey", "API_KEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef" * 2, "x", "é", "🙂", "\n", "abcdef", "-"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert [(s.kind, s.start, s.end) for s in secrets.rule_spans(text)] == plain_spans(text), text


def test_secret_network(spark):
    random.seed(3)

    def value(n):
        return "".join(random.choice("0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    texts = [(i, f"words before token = {value(24)} and after") for i in range(300)]
    texts += [(i, f"mail number{i} is aaaaaaaaaaaaaa{i} or user-name-{i}-again here") for i in range(300, 700)]
    texts += [(1000 + i, f"plain text {value(32)} in between") for i in range(40)] + [(None, None), (2000, ""), (2001, "x" * 100_000 + "1")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, spans string").repartition(3)
    net = secrets.fit(*secrets.findings(docs))
    got = {r.id: r.spans for r in secrets.scan(docs, net).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind != "net"] == plain_spans(t or "")
    assert sum(not got[i] for i in range(300, 700)) >= 390
    assert got[None] == [] and got[2000] == []
    nothing = secrets.fit(*secrets.findings(docs.filter("false")))
    assert secrets.scan(docs.filter("false"), nothing).count() == 0 and nothing.threshold > 1


def test_keys_of_letters_alone_are_candidates(spark):
    """Keys without a digit, in texts that the network has not seen: those that no rule finds are scored and found, words are not."""
    random.seed(5)

    def key():
        return "".join(random.choice("bcdfghjkQXZVWKRTPqxzvwk") for _ in range(28))

    hidden = [(5000 + i, f"see {key()} for it") for i in range(40)]
    texts = [(i, f"the token: {key()} is here") for i in range(400)]
    texts += [(1000 + i, f"an {'un' * (i % 3)}{random.choice(['believably', 'comfortable', 'remarkable', 'questionable'])}ness{'es' * (i % 2)} of words{i} everywhere") for i in range(600)]
    docs = spark.createDataFrame(texts + texts[:5], "doc_id long, text string").repartition(3)
    assert secrets.candidates(hidden[0][1], []) == [(4, 32)]
    net = secrets.fit(*secrets.findings(docs))
    got = {}
    for r in secrets.scan(docs.unionByName(spark.createDataFrame(hidden, docs.schema)), net).collect():
        got.setdefault(r.id, []).append([(s.kind, s.start, s.end) for s in r.spans])
    assert all(len(got[i]) == 2 and got[i][0] == got[i][1] for i in range(5))
    assert sum(got[i][0] == [("net", 4, 32)] for i, _ in hidden) >= 34
    assert sum(any(k == "net" for k, *_ in got[1000 + i][0]) for i in range(600)) <= 6


def test_the_threshold_leaves_the_wanted_recall():
    random.seed(8)
    values = ["".join(random.choice("0123456789abcdef") for _ in range(30)) for _ in range(300)]
    mixed = values[:200] + ["wordlikerunofletters"[:14 + i % 6] + "x" * (i % 5) for i in range(100)]       # a third of the secrets look harmless
    views = [secrets.pieces(f"key {v} end", 4, 4 + len(v))[0] for v in mixed]
    harmless = [secrets.pieces(f"key {w} end", 4, 4 + len(w))[0] for w in ("wordlikerunofletters"[:14 + i % 6] + "x" * (i % 7) for i in range(300))]
    net = secrets.fit(views + harmless, [1] * 300 + [0] * 300)
    found = net.probabilities(secrets._codes(views)) >= net.threshold
    assert found.mean() >= 0.85


def test_long_candidate_is_read_whole():
    views = secrets.pieces("a" * 10 + "B1" * 200, 10, 410)
    assert all(len(v) == secrets.LENGTH for v in views) and "".join(sorted(set("".join(views)) - {"\0"})) == "1Ba"


@pytest.fixture(scope="module")
def toxic_docs(spark):
    random.seed(6)
    common = ["the", "tree", "river", "walks", "green", "stone", "under", "light", "house", "old", "bird", "cloud", "paper", "music"]
    bad = ["dreadfulo", "nastyish", "vilemark"]
    rows, labels = [], []
    for i in range(900):
        w = [random.choice(common) for _ in range(random.randint(20, 160))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                w.insert(random.randrange(len(w)), random.choice(bad))
        rows.append((i, " ".join(w), 5))
        labels.append((i, int(toxic)))
    rows += [(5000, None, 1), (5001, "", 1), (None, "the river", 1), (5002, "tree " * 40_000 + "nastyish vilemark dreadfulo " * 3 + "tree " * 1000, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, toxic_docs):
    docs, labels = toxic_docs
    got = {r.id: r for r in toxicity.judge(docs, labels).collect()}
    assert len(got) == 904
    held = [r for r in got.values() if r.held_out and r.id < 5000]
    assert {r.id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(r.predicted == (r.id % 3 == 0) for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[5002].predicted == 1 and got[5001].score == got[5000].score and not got[None].held_out


def test_toxicity_without_labels(spark, toxic_docs):
    docs, labels = toxic_docs
    assert {r.predicted for r in toxicity.judge(docs.limit(20), labels.filter("false")).collect()} == {0}
    assert toxicity.judge(docs.filter("false"), labels.filter("false")).count() == 0


def test_a_long_text_in_parts_scores_the_same(spark, monkeypatch):
    net = toxicity.Network.fresh(2)
    random.seed(9)
    texts = [" ".join(random.choice(["tree", "stone", "odd", "bad"]) for _ in range(n)) for n in (0, 1, 31, 48, 56, 57, 200, 1000)]
    whole = net.logits([toxicity.split_words(t) for t in texts])
    monkeypatch.setattr(toxicity, "_CHUNK", 2 * toxicity.STRIDE)
    for t, logit in zip(texts, whole):
        parts = list(toxicity._parts(toxicity.split_words(t)))
        assert max(len(p) for p in parts) <= 2 * toxicity.STRIDE + 8
        assert abs(net.logits(parts).max() - logit) < 1e-5
        assert len(toxicity.windows(parts).of) == len(toxicity.windows([toxicity.split_words(t)]).of)


def test_probabilities_do_not_follow_the_sample(spark, toxic_docs):
    """A sample of equal classes out of a table with few toxic rows: scores say how likely a row of the table is toxic."""
    random.seed(7)
    common, bad = ["tree", "river", "green", "stone"], ["mild", "harsh"]

    def text(toxic):
        w = [random.choice(common) for _ in range(25)]
        if random.random() < (0.8 if toxic else 0.3):           # a sign that is often misleading
            w.insert(random.randrange(25), random.choice(bad))
        return " ".join(w)

    rows = [(i, text(i % 10 == 0), int(i % 10 == 0)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.train(docs, docs, per_class=200)
    scores = net.scores([t for _, t, _ in rows])
    assert abs(scores.mean() - 0.1) < 0.05


def test_repeated_rows_are_scored_again(spark, toxic_docs):
    docs, labels = toxic_docs
    some = docs.filter("doc_id < 40")
    got = toxicity.judge(some.unionByName(some), labels.unionByName(labels)).groupBy("id").agg(F.count("score").alias("n"), F.count_distinct("score").alias("k")).collect()
    assert {(r.n, r.k) for r in got} == {(2, 1)}


def test_windows_overlap_and_cover():
    w = toxicity.windows([[b"a"] * 100, [], [b"b"] * toxicity.WINDOW])
    assert np.bincount(w.of).tolist() == [4, 1, 1] and w.mask.sum(axis=1).tolist()[:4] == [32, 32, 32, 28] and not w.mask[4].any()


def test_gradients():
    """The way back against small changes of the weights."""
    net = toxicity.Network.fresh(1)
    texts, labels = [[b"one", b"two", b"three"] * 9, [b"four", b"five"], []], np.array([1.0, 0.0, 0.0])

    def loss(n):
        w = toxicity.windows(texts)
        vectors, _ = n.inputs(w.words)
        gates = [vectors @ n.into[k] + n.bias[k] for k in (0, 1)]
        logit, _ = n.forward(gates, w.ids, w.mask.astype(np.float32))
        top = np.array([logit[w.of == i].max() + np.log(np.exp(logit[w.of == i] - logit[w.of == i].max()).mean()) for i in range(3)])
        p = 1 / (1 + np.exp(-top))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    seen = {}
    net._move = lambda name, at, grad, rate: seen.setdefault(name, grad.copy())
    net.learn(texts, labels, 1.0, 0.0)
    for name, at in (("out", 3), ("attend", 5), ("bias", (1, 4)), ("into", (0, 2, 7)), ("back", (1, 3, 20)), ("back", (0, 2, 30))):
        weights = getattr(net, name).astype(np.float64)
        setattr(net, name, weights)
        old = weights[at]
        weights[at] = old + 1e-3
        up = loss(net)
        weights[at] = old - 1e-3
        down = loss(net)
        weights[at] = old
        assert abs((up - down) / 2e-3 - seen[name][at]) < 2e-3 * max(1, abs(seen[name][at])) + 2e-4, name


def plain_links(rows):
    ok = [(i, lab, np.array(v, float)) if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v) else None for i, v, lab in rows]
    links = [[] for _ in rows]
    for a, x in enumerate(ok):
        for b, y in enumerate(ok):
            if a != b and x and y and x[1] == y[1] and len(x[2]) == len(y[2]) and x[2] @ y[2] / np.linalg.norm(x[2]) / np.linalg.norm(y[2]) >= 0.98:
                links[a].append(b)
    label = [r[0] for r in rows]
    while True:
        new = [min([label[a], *(label[b] for b in links[a])]) if links[a] else label[a] for a in range(len(rows))]
        if new == label:
            return [len(x) for x in links], label
        label = new


@pytest.mark.parametrize("cell_rows", [2048, 8])
def test_embedding_links(spark, cell_rows):
    rng = np.random.default_rng(cell_rows)
    rows = []
    for g in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 7))):
            rows.append((len(rows), [float(x) for x in (centre + rng.normal(size=16) * 0.04 * rng.integers(0, 4)).astype(np.float32)], int(g % 3)))
    same = [float(x) for x in rng.normal(size=16).astype(np.float32)]
    rows += [(1000 + i, same, 1) for i in range(30)] + [(2000, [2 * x for x in same], 1), (2001, same, 2), (2002, same, None), (None, same, 1)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [], 1), (3003, [None] + same[1:], 1), (3004, [float("nan")] + same[1:], 1),
             (3005, [float("inf")] + same[1:], 1), (3006, same[:8], 1), (3007, same[:8], 1), (1000, same, 1)]
    df = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, rep int").repartition(4)
    got = embedding_dups.near_duplicates(df, target_recall=1.0, cell_rows=cell_rows).collect()
    n, label = plain_links(rows)
    want = [(r[0], k, c) for r, k, c in zip(rows, n, label)]
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert embedding_dups.near_duplicates(df.filter("false")).count() == 0
    only_null = embedding_dups.near_duplicates(df.filter("vec_id between 3000 and 3005")).collect()
    assert {(r.n_links, r.id == r.component_id) for r in only_null} == {(0, True)}


def test_visits_go_by_summed_distance():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (5, 7), (30, 20)):
        a, b = np.sort(rng.random(n)), np.sort(rng.random(m))
        b[:2] = b[0]
        got = list(embedding_dups.visits(a.tolist(), b.tolist(), 0.9))
        sums = [s for _, _, s in got]
        assert sums == sorted(sums) and len({(i, j) for i, j, _ in got}) == len(got)
        assert {(i, j) for i, j, _ in got} == {(i, j) for i in range(n) for j in range(m) if a[i] + b[j] <= 0.9}
    assert list(embedding_dups.visits([], [1.0], 5)) == []


def test_cells_meet_what_lies_within_reach():
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(400, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    grid = embedding_dups.Grid(unit, 9, 0.98, 1.0)
    own, gaps = grid._look(unit)
    name = grid._names(own)
    rows, cells, looks = grid.cells(unit)
    want = {(r, i * 9 + j) for r in range(400) for i in range(9) for j in range(9) if gaps[0][r, i] + gaps[1][r, j] <= grid.reach and i * 9 + j < name[r]}
    assert {(r, c) for r, c, k in zip(rows.tolist(), cells.tolist(), looks) if k} == want
    assert cells[:400].tolist() == name.tolist()


def test_embedding_recall(spark):
    """Neighbours at just the least similarity, found with the fitted reach."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(axis=1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    y = 0.981 * x + np.sqrt(1 - 0.981 ** 2) * e
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    found = embedding_dups.near_duplicates(df).filter(F.col("n_links") > 0).count() / len(rows)
    assert found >= 0.98
