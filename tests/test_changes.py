import pytest

from factloom.errors import RequestError
from factloom.operators import changes as E
from factloom.operators import maintain as M
from factloom.operators.prepare import MockEmbedding
from tests.helpers import FUTURE, NOW, PAST, memories


@pytest.fixture(scope="module")
def table(spark):
    return memories(spark, [
        {"text": "One", "tags": ["a"]}, {"text": "Two", "expires_at": PAST}, {"text": "Three", "deleted_at": PAST},
        {"text": "Four", "user_id": "v"}])


ITEM = "input_index long, id long, text string, tags array<string>, importance double, expires_at timestamp"


def test_updates_in_order(spark, table):
    items = spark.createDataFrame([
        (0, 1, "First", None, 0.1, None), (1, 2, None, ["Tech"], None, FUTURE), (2, 3, "x", None, None, None),
        (3, 1, None, ["b"], 0.9, None), (4, 1, " Last ", None, None, None), (5, 9, "x", None, None, None),
        (6, None, "x", None, None, None), (7, 2, None, None, None, None), (8, 2, " ", None, None, None)], ITEM)
    done = E.update_memory_batch(table, items, NOW, MockEmbedding(16))
    r = {x.input_index: (x.ok, x.changed_fields, x.error_code) for x in done.results.collect()}
    assert r[0] == (True, ["text", "importance"], None) and r[1] == (True, ["tags", "expires_at"], None)
    assert [r[i][2] for i in (2, 5, 6, 7, 8)] == ["NOT_FOUND", "NOT_FOUND"] + ["INVALID_INPUT"] * 3
    m = {x.id: x for x in done.memories.collect()}
    assert (m[1].text, m[1].normalized_text, m[1].tags, m[1].importance) == ("Last", "last", ["b"], 0.9)
    assert m[1].embedding_model == "mock-sha256" and len(m[1].embedding) == 16 and m[1].updated_at == NOW
    assert (m[2].text, m[2].tags, m[2].expires_at) == ("Two", ["software"], FUTURE)     # expired rows can be changed
    assert m[3].updated_at == m[4].updated_at == PAST


def test_a_text_of_someone_else_is_refused(spark, table):
    items = spark.createDataFrame([(0, 1, "TWO", None, None, None), (1, 4, "two", None, None, None),
                                   (2, 1, "New", None, None, None), (3, 2, "new", None, None, None),
                                   (4, 1, "three", None, None, None)], ITEM)
    done = E.update_memory_batch(table, items, NOW, MockEmbedding(16))
    codes = [x.error_code for x in done.results.orderBy("input_index").collect()]
    assert codes == ["DATABASE_ERROR", None, None, "DATABASE_ERROR", None]    # another user's and deleted rows do not clash
    assert {x.id: x.text for x in done.memories.collect()} == {1: "three", 2: "Two", 3: "Three", 4: "two"}


def test_updates_run_as_if_one_after_the_other(spark):
    import random
    random.seed(5)
    for trial in range(3):
        start = {i: random.choice("abcdefgh") for i in range(1, 7)}
        asked = [(n, random.randint(1, 6), random.choice("abcdefghij")) for n in range(24)]
        texts, want = dict(start), []
        for _, i, t in asked:
            ok = all(j == i or x != t for j, x in texts.items())
            want.append(ok)
            if ok:
                texts[i] = t
        table = memories(spark, [{"text": start[i]} for i in range(1, 7)])
        items = spark.createDataFrame([(n, i, t, None, None, None) for n, i, t in asked], ITEM)
        done = E.update_memory_batch(table, items, NOW, MockEmbedding(4))
        assert [r.ok for r in done.results.orderBy("input_index").collect()] == want
        assert {r.id: r.text for r in done.memories.collect()} == texts


def test_dry_run_and_single_update(spark, table):
    items = spark.createDataFrame([(0, 1, "New", None, None, None)], ITEM)
    done = E.update_memory_batch(table, items, NOW, dry_run=True)
    assert done.memories is table and done.results.first().dry_run
    assert E.update_memory(table, 1, NOW, tags=["code"]).memories.filter("id = 1").first().tags == ["software"]
    with pytest.raises(RequestError, match="NOT_FOUND"):
        E.update_memory(table, 3, NOW, importance=0.1)
    with pytest.raises(RequestError, match="nothing to change"):
        E.update_memory(table, 1, NOW)


def ids(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "input_index long, id long")


def test_confirm(spark, table):
    done = E.confirm(table, ids(spark, [1, 3, 8, 1]), NOW)
    assert [r.ok for r in done.results.orderBy("input_index").collect()] == [True, False, False, True]
    assert {r.id: r.last_confirmed_at for r in done.memories.collect()} == {1: NOW, 2: None, 3: None, 4: None}


def test_forget_batch_repeats(spark, table):
    req = ids(spark, [1, 3, None, 7, 1])
    for dry_run, last in ((False, True), (True, False)):
        done = E.forget_batch(table, req, NOW, " old ", dry_run)
        r = done.results.orderBy("input_index").collect()
        assert [x.already_deleted for x in r] == [False, True, None, None, last]
        assert [x.error_code for x in r] == [None, None, "INVALID_INPUT", "NOT_FOUND", None]
    rows = {x.id: x for x in E.forget_batch(table, req, NOW, " old ").memories.collect()}
    assert (rows[1].deleted_at, rows[1].forget_reason) == (NOW, "old") and rows[3].deleted_at == PAST
    with pytest.raises(RequestError, match="allowed"):
        E.forget_batch(table, req, NOW, "x" * 1025)


def test_forget_soft_and_hard(spark, table):
    req = spark.createDataFrame([(0, 1, " wrong ", 4), (1, 3, None, 1), (2, 9, None, None)],
                                "input_index long, id long, reason string, replaced_by_id long")
    done = E.forget(table, req, NOW)
    rows = {x.id: x for x in done.memories.collect()}
    assert (rows[1].forget_reason, rows[1].replaced_by_id, rows[3].replaced_by_id) == ("wrong", 4, 1)
    assert {r.id: r.final_id for r in E.current_version(done.memories).collect()} == {1: 4, 3: 4}
    hard = E.forget(table, ids(spark, [1, 1, 9]), NOW, hard=True)
    assert [r.ok for r in hard.results.orderBy("input_index").collect()] == [True, False, False]
    assert sorted(r.id for r in hard.memories.collect()) == [2, 3, 4]
    assert not E.forget(table, req, NOW, hard=True).results.filter("input_index = 0").first().ok


def test_circle_of_replacements_has_no_end(spark):
    m = memories(spark, [{"deleted_at": PAST, "replaced_by_id": n} for n in (2, 3, 1, 5)] + [{}])
    assert {r.id: r.final_id for r in E.current_version(m).collect()} == {1: None, 2: None, 3: None, 4: 5}


def test_row_changes(spark):
    t = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 6), (2, 1, "c", 7)], "k long, n long, x string, y int")
    ch = spark.createDataFrame([("update", 1, 1, None, 9, ["x"]), ("update", 1, 2, "B", 8, None), ("delete", 2, 1, None, None, None),
                                ("insert", 3, 1, "d", 1, None)], "op string, k long, n long, x string, y int, columns array<string>")
    assert sorted(map(tuple, E.apply_row_changes(t, ["k", "n"], ch).rows.collect())) == [
        (1, 1, None, 5), (1, 2, "B", 8), (3, 1, "d", 1)]
    with pytest.raises(RequestError):
        E.apply_row_changes(t, [], ch)


def test_row_changes_that_are_refused(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, x string")
    ch = spark.createDataFrame([("insert", 2, "B"), ("update", 1, "A"), ("delete", 1, None), ("delete", 3, None), ("insert", None, "n"), ("update", 9, "z")],
                               "op string, k long, x string")
    done = E.apply_row_changes(t, ["k"], ch)
    assert sorted(map(tuple, done.rows.collect())) == [(1, "a"), (2, "b")]
    assert sorted((r.op, r.k, r.reason) for r in done.refused.collect() if r.k) == [
        ("delete", 1, "several changes of one key"), ("insert", 2, "the key is taken"), ("update", 1, "several changes of one key")]


def test_reembed_is_resumable(spark, table):
    once = M.reembed(table, MockEmbedding(8), NOW)
    assert {len(r.embedding) for r in once.collect()} == {8}
    again = M.reembed(once, MockEmbedding(8), FUTURE)
    assert {r.updated_at for r in again.collect()} == {NOW}


def test_version_rules(spark, table):
    step = M.Upgrader(1, 2, "s", lambda df: df)
    with pytest.raises(ValueError):
        M.upgrade_records(table, [], 2, NOW)
    with pytest.raises(ValueError):
        M.upgrade_records(table, [step, M.Upgrader(3, 4, "gap", lambda df: df)], 4, NOW)
    with pytest.raises(ValueError):
        M.upgrade_records(table, [M.Upgrader(1, 2, "", lambda df: df)], 2, NOW)
    assert M.upgrade_records(table, [], 1, NOW).filter("upgrade_error is not null").isEmpty()
    done = M.upgrade_records(table, [step], 2, NOW)
    assert {r.record_version for r in done.collect()} == {2}
    with pytest.raises(ValueError):
        M.upgrade_schema(table, version=5)
    old = table.drop("expires_at", "forget_reason", "record_version")
    assert set(M.upgrade_schema(old).columns) == set(table.columns)
    assert "forget_reason" not in M.upgrade_schema(old, version=1, target=3).columns
