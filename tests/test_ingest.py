import json
import random

import pytest

from factloom.errors import RequestError
from factloom.operators import chunks as K
from factloom.operators import closest, ingest
from factloom.operators.prepare import MockEmbedding
from factloom.streaming import remember_stream as stream_module
from factloom.streaming.remember_stream import remember_stream, stream_results, stream_table
from tests.helpers import NOW, memories


def pieces(text, size):
    return [text[a:b] for a, b in ingest.cut_points(text, size)]


def test_cuts():
    assert pieces("short", 500) == ["short"]
    para = "a" * 300 + "\n\n" + "b" * 400
    assert pieces(para, 500) == ["a" * 300 + "\n\n", "b" * 400]
    assert pieces("a" * 100 + "\n\n" + "b" * 600, 500)[0] == "a" * 100 + "\n\n" + "b" * 398     # first half: not used
    text = "a" * 280 + ". " + "b" * 100 + "! " + "c" * 300
    assert pieces(text, 500)[0] == "a" * 280 + ". " + "b" * 100 + "! "
    assert [len(p) for p in pieces("x" * 1200, 500)] == [500, 500, 200]
    edge = "a" * 500 + ". b" + "c" * 50
    assert "".join(pieces(edge, 500)) == edge and pieces(edge, 500)[0] == "a" * 500 + ". "


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "a" * 600 + "\n\n" + " " * 700 + "tail"), (2, ""), (3, None)], "doc_id long, text string")
    got = [tuple(r) for r in ingest.chunk_documents(docs, 500).orderBy("doc_id", "seq").collect()]
    assert got == [(1, 0, "a" * 500), (1, 1, "a" * 100 + "\n\n" + " " * 398), (1, 2, "tail")]
    with pytest.raises(RequestError):
        ingest.chunk_documents(docs, 499)


def test_extraction(spark):
    rows = [(1, 0, "obj"), (1, 1, "boom"), (2, 0, "bare"), (2, 1, "none"), (3, 0, "junk")]
    chunks = spark.createDataFrame(rows, "doc_id long, seq int, text string")

    def call(text):
        if "boom" in text:
            raise RuntimeError
        return {"obj": json.dumps({"facts": [{"text": "one", "tags": ["a"]}, {"text": ""}, {"text": 5}, {"tags": []},
                                             {"text": "two"}]}),
                "bare": json.dumps([{"text": "three"}]), "none": json.dumps({"facts": "x"}), "junk": "{not json"}[text]

    facts = ingest.extract_facts(chunks, call, ["a", "b"])
    got = [(r.doc_id, r.seq, r.pos, r.text, r.tags) for r in facts.orderBy("doc_id", "seq", "pos").collect()]
    assert got == [(1, 0, 0, "one", ["a", "b"]), (1, 0, 4, "two", ["a", "b"]), (2, 0, 0, "three", ["a", "b"])]
    assert ingest.failed_chunks(chunks, call).first().n == 3
    assert [r.text for r in ingest.extract_facts(chunks, call, max_facts=2).collect()] == ["one", "two"]


def test_loading_keeps_the_order(spark):
    facts = spark.createDataFrame([(2, 0, 0, "b", []), (1, 0, 1, "B", []), (1, 0, 0, "a", []), (3, 0, 0, "A ", [])],
                                  "doc_id long, seq int, pos int, text string, tags array<string>")
    done = ingest.load_facts(memories(spark, []), facts.repartition(3), NOW, MockEmbedding(16))
    assert [r.text for r in done.inserted.orderBy("id").collect()] == ["a", "B"]
    assert done.inserted.first().source_provider == ingest.SOURCE_LABEL


def test_chunk_table(spark):
    cols = "chunk_id string, document_id string, sequence_number int, text string, embedding array<float>, extra map<string,string>"
    t = spark.createDataFrame([("1", "d", 0, "x", [1.0, 0.0], {"k": "v"}), ("2", "d", 1, "y", [1.0, 0.0], {})], cols)
    p = spark.createDataFrame([("2", "d", 5, "z", [0.0, 1.0], None), (None, "e", 0, "n", [1.0, 1.0], None)], cols)
    t2 = K.upsert_chunks(t, p).cache()
    assert t2.count() == 3 and K.get_chunk(t2, "2").first().text == "z"
    assert len(t2.filter("document_id = 'e'").first().chunk_id) == 36
    hits = K.search_chunks(t2, [0.0, 2.0], 2).collect()
    assert [(r.text, r.score) for r in hits] == [("z", 1.0), ("n", 0.707106781)]
    assert [r.text for r in K.search_chunks(t, [1.0, 0.0], 1, t["extra"]["k"] == "v").collect()] == ["x"]
    assert K.delete_chunks(t2, p).filter("chunk_id = '2'").isEmpty()


def test_jaro_winkler():
    assert closest.jaro_winkler("same", "same") == 1.0
    assert closest.jaro_winkler("abc", "xyz") == 0.0
    assert closest.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert closest.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    # The whole common prefix counts, not only four letters.
    assert closest.jaro_winkler("abcdefgh", "abcdefgx") == pytest.approx(0.9167 + 0.1 * 7 * 0.0833, abs=1e-3)
    assert closest.jaro_winkler("", "a") == 0.0


@pytest.mark.parametrize("held", [100, 0])
def test_closest_match(spark, held):
    left = spark.createDataFrame([(1, "New  York"), (2, "bostn"), (3, None), (4, "zzz")], "id long, t string")
    right = spark.createDataFrame([(1, "Boston"), (2, "new york"), (3, "NEWYORK"), (4, None)], "o long, name string")
    got = {r.id: r.match for r in closest.closest_match_join(left, right, "t", "name", "o", held=held).collect()}
    assert got == {1: "new york", 2: "Boston", 3: None, 4: "Boston"}


def test_stream_and_replay(spark, tmp_path):
    root, src = str(tmp_path / "root"), str(tmp_path / "in")
    schema = "input_index long, text string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], schema).coalesce(1).write.parquet(src)

    def go():
        items = spark.readStream.schema(schema).parquet(src)
        remember_stream(items, root, MockEmbedding(16), NOW).awaitTermination()
        return {r.id: r.text for r in stream_table(spark, root).collect()}

    assert go() == {1: "a", 2: "b"}
    spark.createDataFrame([(1, "B"), (2, "c")], schema).coalesce(1).write.mode("append").parquet(src)
    assert go() == {1: "a", 2: "b", 3: "c"}
    # The last batch again, as after a failure between its write and its commit.
    commit = max((tmp_path / "root/progress/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert commit.name == "1"
    for f in (commit, commit.with_name(f".{commit.name}.crc")):
        f.unlink(missing_ok=True)
    assert go() == {1: "a", 2: "b", 3: "c"}
    assert stream_results(spark, root).count() == 5


def test_a_half_written_batch_inserts_nothing_twice(spark, tmp_path, monkeypatch):
    root, items = str(tmp_path), spark.createDataFrame([(1, "a"), (2, "b")], "input_index long, text string")
    plain = stream_module._commit

    def lost(*args):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(stream_module, "_commit", lost)
    with pytest.raises(RuntimeError):
        stream_module.take_batch(items, 0, root, MockEmbedding(16), NOW)
    assert stream_table(spark, root).count() == 0        # the part is there, but it does not count
    monkeypatch.setattr(stream_module, "_commit", plain)
    for _ in range(3):                                    # and once it was committed, running it again changes nothing
        stream_module.take_batch(items, 0, root, MockEmbedding(16), NOW)
    assert sorted(r.id for r in stream_table(spark, root).collect()) == [1, 2] and stream_results(spark, root).count() == 2


def test_parts_grow_with_the_logarithm_of_the_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_module, "FOLD", 2)
    root, held = str(tmp_path), []
    for k in range(5):
        items = spark.createDataFrame([(1, f"new {k}"), (2, f"new {max(0, k - 1)}")], "input_index long, text string")
        stream_module.take_batch(items, k, root, MockEmbedding(16), NOW)
        held.append([(r.first, r["last"]) for r in stream_module.parts(spark, root)])
    assert held[-1] == [(0, 3), (4, 4)] and held[2] == [(0, 1), (2, 2)] and held[3] == [(0, 3)]
    assert sorted(r.text for r in stream_table(spark, root).collect()) == [f"new {k}" for k in range(5)]
    assert sorted(r.text for r in stream_table(spark, root, before=3).collect()) == ["new 0", "new 1", "new 2"]
    assert stream_results(spark, root).count() == 10


def test_few_candidates_are_scored(monkeypatch):
    """The same best candidates as by scoring all pairs, with a tenth of the calls at most."""
    rnd = random.Random(4)
    parts = ["ka", "lo", "min", "ter", "sch", "ou", "ra", "en", "vi", "qu", "ö"]
    cands = sorted({"".join(rnd.choices(parts, k=rnd.randrange(1, 6))) for _ in range(700)} | {""})
    rows = list(enumerate(cands))
    rnd.shuffle(rows)
    forms = [c[:k] + rnd.choice("abcdeö") + c[k + 1:] for c in rnd.sample(cands, 120) for k in [rnd.randrange(len(c) + 1)]] + ["", "a", "zzz", cands[5]]
    want = {f: min((-closest.jaro_winkler(f, c), o) for o, c in rows) for f in forms}
    calls = []
    plain = closest.jaro_winkler
    monkeypatch.setattr(closest, "jaro_winkler", lambda a, b: calls.append(1) or plain(a, b))
    known = closest._Candidates(rows)
    got = {f: known.best(f) for f in forms}
    assert got == {f: (o, -s) for f, (s, o) in want.items()}
    assert len(calls) * 10 <= len(forms) * len(cands)
    assert closest._Candidates([]).best("a") is None
