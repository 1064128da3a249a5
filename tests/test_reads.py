from datetime import datetime

import pytest

from factloom.errors import RequestError
from factloom.operators import predicates as C
from factloom.operators import reports as R
from factloom.operators import search as Q
from tests.helpers import FUTURE, NOW, PAST, memories


@pytest.fixture(scope="module")
def table(spark):
    return memories(spark, [
        {"text": "Discount: 10% off", "tags": ["software"], "embedding": [1.0, 0.0], "source_provider": "p"},
        {"text": "Plain ten percent", "embedding": [0.6, 0.8], "created_at": datetime(2024, 2, 1)},
        {"text": "a_b\\c", "embedding": [0.0, 0.0], "last_confirmed_at": PAST},
        {"text": "gone 10%", "embedding": [1.0, 0.1], "deleted_at": PAST},
        {"text": "old 10%", "embedding": [1.0, 0.0], "expires_at": PAST},
        {"text": "soon", "tags": ["work", "software"], "embedding": [-1.0, 0.0], "expires_at": FUTURE},
        {"text": "none", "embedding": None}, {"text": "x", "user_id": "v", "embedding": [1.0, 0.0]}])


def ids(df):
    return [r.id for r in df.collect()]


def test_recall(table):
    hits = Q.recall(table, [2.0, 0.0], "u", NOW).collect()
    assert [(r.id, r.score) for r in hits] == [(1, 1.0), (2, 0.60000001), (6, -1.0), (3, None), (7, None)]
    assert ids(Q.recall(table, [2.0, 0.0], "u", NOW, limit=2, min_score=0.9)) == [1]
    assert ids(Q.recall(table, [1.0, 0.0], "u", NOW, tags=["Tech"])) == [1, 6]
    assert ids(Q.recall_tombstones(table, [1.0, 0.0], "u")) == [4]
    for bad in (0, 51):
        with pytest.raises(RequestError):
            Q.recall(table, [1.0, 0.0], "u", NOW, limit=bad)


@pytest.mark.parametrize("strategy", ["scan", "cells"])
def test_recall_batch_fills_up_with_unscored_rows(spark, table, strategy):
    q = spark.createDataFrame([(1, "u", [1.0, 0.0], None, []), (2, "u", [1.0, 0.0], None, ["work"]),
                               (3, "u", [1.0, 0.0], 0.5, []), (4, "nobody", [1.0, 0.0], None, [])],
                              "query_id long, user_id string, embedding array<float>, min_score double, tags array<string>")
    got = {}
    for r in Q.recall_batch(table, q, NOW, strategy=strategy).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {1: [1, 2, 6, 3, 7], 2: [6], 3: [1, 2]}


def test_prompt(spark, table):
    prompts = spark.createDataFrame([(1, "u", "Hi?", [1.0, 0.0], 34), (2, "nobody", "Hi?", [1.0, 0.0], None),
                                     (3, "u", "Hi?", [1.0, 0.0], 33), (4, "u", "Hi?", [1.0, 0.0], 5)],
                                    "query_id long, user_id string, user_prompt string, embedding array<float>, max_chars int")
    got = {r.query_id: r.prompt for r in Q.build_context_prompt(table, prompts, NOW).collect()}
    end = "-----------------\n\nThe following is the user's prompt:\n\nHi?"
    head = "The following are previously known facts:\n\n"
    assert got[1] == head + "Discount: 10% off\n\nPlain ten percent\n\n" + end
    assert got[3] == head + "Discount: 10% off\n\n" + end
    assert got[2] == got[4] == head + "No relevant previously known facts were found.\n\n" + end
    with pytest.raises(RequestError):
        Q.build_context_prompt(table, prompts, NOW, max_chars=0)


def test_text_search_takes_wildcards_as_text(table):
    assert ids(R.text_search(table, "u", "10%", NOW)) == [1]
    assert ids(R.text_search(table, "u", "A_B\\", NOW)) == [3]
    assert ids(R.text_search(table, "u", "PERCENT", NOW)) == [2]


def test_listing(table):
    assert ids(R.list_memories(table, "u", NOW)) == [2, 7, 6, 3, 1]
    assert ids(R.list_memories(table, "u", NOW, limit=2, offset=1)) == [7, 6]
    assert ids(R.list_memories(table, "u", NOW, offset=-3, include_deleted=True)) == [2, 7, 6, 5, 4, 3, 1]
    tidy = C.Cleanup(untagged_only=True, min_chars=5, max_chars=17, not_confirmed_since=datetime(2024, 3, 1))
    assert ids(R.list_memories(table, "u", NOW, cleanup=tidy)) == [2, 3]
    assert "embedding" not in R.list_memories(table, "u", NOW).columns


def test_filter_bounds():
    for a, b in ((-1, None), (None, -1), (5, 4)):
        with pytest.raises(RequestError):
            C.text_length_between(a, b)
    with pytest.raises(RequestError):
        C.not_confirmed_since(FUTURE, NOW)


def test_counts(table):
    assert R.count_memories(table, "u", NOW).first().n == 5
    assert R.count_memories(table, "u", NOW, include_deleted=True, tags=["code"], provider=" p ").first().n == 1
    s = R.memory_stats(table.filter("user_id = 'u'"), NOW).first()
    assert (s.total, s.active, s.soft_deleted, s.expired, s.avg_importance) == (7, 5, 1, 1, 0.5)
    assert s.newest_created_at == datetime(2024, 2, 1)
    assert [tuple(r) for r in R.list_tags(table, "u", NOW).collect()] == [("software", 2), ("work", 1)]
    assert [tuple(r) for r in R.count_by_provider(table, "u").collect()] == [("(none)", 5), ("p", 1)]
    with pytest.raises(RequestError):
        R.list_tags(table, "u", NOW, limit=501)


def test_lookup_and_export(table):
    assert R.get_memory(table, 4).deleted_at == PAST
    with pytest.raises(RequestError, match="NOT_FOUND"):
        R.get_memory(table, 99)
    assert ids(R.export_memories(table, "u", NOW)) == [1, 3, 4, 5, 6, 7, 2]
    assert ids(R.export_memories(table, "u", NOW, include_deleted=False)) == [1, 3, 6, 7, 2]
    with pytest.raises(RequestError, match="LIMIT_EXCEEDED"):
        R.export_memories(table, "u", NOW, max_rows=6)
    assert ids(R.page_after(table, 3, 2)) == [4, 5]
    assert ids(R.page(table.orderBy("id"), 1, 3)) == [4, 5, 6] and R.page(table, 0, 0).count() == 8
