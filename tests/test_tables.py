import pytest

from factloom.operators.chunks import upsert_chunks
from factloom.operators.components import connected_components
from factloom.operators.search import recall, recall_batch
from factloom.operators.changes import confirm, forget
from factloom.operators.ledger import entries, resume
from factloom.operators.maintain import reembed
from factloom.operators.prepare import MockEmbedding
from factloom.sources import changelog
from factloom.sources.tables import load_snapshot, save_snapshot
from tests.helpers import NOW, memories


def test_snapshots_keep_the_mark_of_ids(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        load_snapshot(spark, root)
    m = memories(spark, [{}, {}, {}])
    assert save_snapshot(m, root).next_id == 4
    assert save_snapshot(m.filter("id < 3"), root).next_id == 4
    now = load_snapshot(spark, root)
    assert (now.version, now.next_id, now.memories.count()) == (2, 4, 2)


def test_a_query_without_a_usable_vector_takes_the_lowest_ids(spark):
    m = memories(spark, [{"embedding": [1.0, 0.0]}, {"embedding": [0.0, 1.0]}, {}, {"embedding": [0.0, 0.0]}, {"user_id": "v"}])
    for vector in ([0.0, 0.0], [1.0, 0.0]):
        one = [(r.id, r.score) for r in recall(m, vector, "u", NOW, 3).collect()]
        q = spark.createDataFrame([(1, "u", vector)], "query_id long, user_id string, embedding array<float>")
        many = [(r.id, r.score) for r in recall_batch(m, q, NOW, 3).orderBy("rank").collect()]
        assert one == many
    assert [i for i, _ in one] == [1, 2, 3]


def test_the_last_point_of_an_id_stays(spark):
    schema = "chunk_id string, document_id string, sequence_number int, text string, embedding array<float>, extra map<string,string>, n int"
    points = spark.createDataFrame([("a", "d", 1, "old", None, None, 1), ("a", "d", 1, "new", None, None, 2), (None, "d", 2, "x", None, None, 3)], schema)
    got = upsert_chunks(points.filter("false").drop("n"), points, "n").collect()
    assert sorted(r.text for r in got) == ["new", "x"]


def test_components_in_few_rounds(spark, monkeypatch):
    """A chain whose ids jump, 0, n-1, n-2, ..., 1: rounds must not follow its length."""
    from factloom.operators import components
    rounds = []
    plain = components._mark
    monkeypatch.setattr(components, "_mark", lambda e: rounds.append(1) or plain(e))
    n = 1600
    chain = [0, *range(n - 1, 0, -1)]
    edges = spark.createDataFrame(list(zip(chain, chain[1:])) + [(5000, 5001), (7000, 7000)], "id_a long, id_b long")
    got = {r.id: r.label for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {5000: 5000, 5001: 5000, 7000: 7000}
    assert len(rounds) <= 25


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recall_is_one_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    memories(spark, [{"embedding": [1.0, float(i)], "text": f"t{i}"} for i in range(20)]).write.parquet(path)
    got = recall(spark.read.parquet(path), [1.0, 3.0], "u", NOW, 4, min_score=0.9)
    assert plan_of(got).count("FileScan") == 1 and "TakeOrderedAndProject" in plan_of(got)
    assert [r.text for r in got.collect()] == ["t3", "t4", "t5", "t2"]


def Failing(folder, bad=()):
    """A provider that counts its calls in files, and fails for texts that it is told."""
    class Counting(MockEmbedding):        # local, so that its code travels with the job
        def embed_batch(self, texts):
            import os
            import uuid
            open(os.path.join(folder, f"{len(texts)}-{uuid.uuid4().hex}"), "w").close()
            if set(texts) & set(bad):
                raise RuntimeError("no answer")
            return MockEmbedding.embed_batch(self, texts)

    return Counting(4)


def asked(folder):
    import os
    return sum(int(f.split("-")[0]) for f in os.listdir(folder))


def test_paid_vectors_survive_a_failed_call(spark, tmp_path):
    first, second, third = (tmp_path / n for n in ("one", "two", "three"))
    for f in (first, second, third):
        f.mkdir()
    m = memories(spark, [{"text": f"fact {i}", "embedding_provider": "old"} for i in range(60)])
    path = str(tmp_path / "ledger")
    with pytest.raises(Exception, match="no answer"):
        reembed(m, Failing(str(first), ["fact 7"]), NOW, ledger=path, parts=8)
    log = entries(spark, path).collect()
    failed = sum(r.n_failed for r in log)
    assert asked(first) == 60 and sum(r.n_ok for r in log) == 60 - failed and 0 < failed < 60
    done = reembed(m, Failing(str(second)), NOW, ledger=path, parts=8)
    assert asked(second) == failed
    assert done.filter("embedding is null").count() == 0
    again = reembed(m, Failing(str(third)), NOW, ledger=path, parts=8)
    assert asked(third) == 0 and again.exceptAll(done).count() == 0 and done.exceptAll(again).count() == 0
    plain = reembed(m, MockEmbedding(4), NOW)
    assert plain.exceptAll(done).count() == 0 and plain.count() == done.count() == 60


def test_a_changed_text_is_sent_again(spark, tmp_path):
    path = str(tmp_path / "ledger")
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    reembed(memories(spark, [{"text": f"fact {i}", "embedding_provider": "old"} for i in range(6)]), Failing(str(a)), NOW, ledger=path)
    m = memories(spark, [{"text": f"fact {i}" if i else "new", "embedding_provider": "old"} for i in range(6)])
    got = reembed(m, Failing(str(b)), NOW, ledger=path)
    assert asked(b) == 1 and got.count() == 6


def test_parts_without_an_entry_do_not_count(spark, tmp_path):
    path, calls = str(tmp_path / "ledger"), []
    rows = spark.range(20).select("id")

    def work(part):
        calls.append(part.count())
        if len(calls) == 3:
            raise RuntimeError("crash")
        return part.withColumn("twice", 2 * part["id"])

    with pytest.raises(RuntimeError):
        resume(rows, ["id"], "w", work, "twice is not null", path, parts=4)
    before, calls[:] = sum(calls[:2]), [0, 0, 0]
    got = resume(rows, ["id"], "w", work, "twice is not null", path, parts=4)
    assert sum(calls) == 20 - before and sorted(r.twice for r in got.collect()) == list(range(0, 40, 2))
    assert resume(rows.filter("false"), ["id"], "other", lambda d: d.withColumn("twice", d["id"]), "true", path).count() == 0


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_small_changes_are_logged_and_merged(spark, tmp_path):
    root = str(tmp_path / "table")
    m = memories(spark, [{"text": f"fact {i} " + "x" * 3000 * (i % 2) + str(i * 7919), "embedding": [float(i), 1.0]} for i in range(2000)])
    save_snapshot(m, root)
    now = changelog.load_merged(spark, root)
    assert (now.version, now.entry, now.memories.count()) == (1, 0, 2000)

    ids = spark.createDataFrame([(i, i * 100 + 1) for i in range(10)], "input_index long, id long")
    rewritten = confirm(now.memories, ids, NOW).memories
    assert changelog.append_changes(spark, root, changelog.changed_rows(now.memories, rewritten, ids)) == 1
    assert folder_bytes(tmp_path / "table" / "changes") < 30_000 < folder_bytes(tmp_path / "table" / "rows") / 3
    merged = changelog.load_merged(spark, root)
    assert merged.entry == 1 and same_rows(merged.memories, rewritten)

    gone = spark.createDataFrame([(0, 101), (1, 5), (2, 2000)], "input_index long, id long")
    after = forget(merged.memories, gone, NOW, hard=True).memories
    changelog.append_changes(spark, root, changelog.changed_rows(merged.memories, after, gone))
    merged = changelog.load_merged(spark, root)
    assert same_rows(merged.memories, after) and merged.memories.count() == 1997 and merged.next_id == 2001

    whole = changelog.compact(spark, root)
    assert (whole.version, whole.next_id) == (2, 2001) and same_rows(whole.memories, after)
    now = changelog.load_merged(spark, root)
    assert (now.version, now.entry) == (2, 2) and same_rows(now.memories, after)
    back = after.filter("id = 7").withColumn("text", after["text"].substr(1, 3))
    assert changelog.append_changes(spark, root, back) == 3
    assert changelog.load_merged(spark, root).memories.filter("id = 7").first().text == "fac"


def same_rows(a, b):
    names = [c for c in a.columns]
    return a.select(names).exceptAll(b.select(names)).isEmpty() and b.select(names).exceptAll(a.select(names)).isEmpty()
