"""Listings, lookups and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.errors import LIMIT_EXCEEDED, NOT_FOUND, RequestError, check_limit, no_row, over
from factloom.operators.predicates import (Cleanup, active, expired, for_user, from_provider, stale_embedding,
                                           tags_overlap, text_contains, tombstone, visible)
from factloom.operators.skew import join_unique, only_ids
from factloom.session import cut_lineage


def list_memories(memories: DataFrame, user_id: str, as_of, limit: int | None = None, offset: int | None = None,
                  include_deleted: bool = False, cleanup: Cleanup | None = None) -> DataFrame:
    """Latest rows first; equal creation times go by id, largest first. A negative offset is 0."""
    n = check_limit(limit, S.DEFAULT_LIST_ROWS, S.MAX_RESULT_ROWS)
    rows = memories.filter(for_user(user_id) & visible(as_of, include_deleted))
    if cleanup is not None:
        rows = rows.filter(cleanup.column(as_of))
    rows = rows.select([c for c in S.READ_COLUMNS if c in memories.columns])
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(max(offset or 0, 0)).limit(n)


def text_search(memories: DataFrame, user_id: str, pattern: str, as_of, limit: int | None = None) -> DataFrame:
    """Active rows whose text holds `pattern` in any case, latest first."""
    n = check_limit(limit, S.DEFAULT_LIST_ROWS, S.MAX_RESULT_ROWS)
    rows = memories.filter(for_user(user_id) & active(as_of) & text_contains(pattern))
    rows = rows.select([c for c in S.READ_COLUMNS if c in memories.columns])
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def page_after(rows: DataFrame, last_id: int, limit: int) -> DataFrame:
    """The next `limit` rows by id."""
    return rows.filter(F.col("id") > last_id).orderBy("id").limit(limit)


def export_memories(memories: DataFrame, user_id: str, as_of, include_deleted: bool = True,
                    max_rows: int | None = None) -> DataFrame:
    """All rows of a user without vectors, oldest first. `max_rows` makes a larger export an error."""
    rows = memories.filter(for_user(user_id) & visible(as_of, include_deleted))
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise RequestError(LIMIT_EXCEEDED, over("rows", "more", max_rows))
    return rows.select([c for c in S.READ_COLUMNS if c in memories.columns]).orderBy("created_at", "id")


def get_memory(memories: DataFrame, id: int) -> Row:
    """One row by id, tombstones included."""
    row = memories.filter(F.col("id") == id).select(
        [c for c in S.READ_COLUMNS if c in memories.columns]).first()
    if row is None:
        raise RequestError(NOT_FOUND, no_row(id))
    return row


def get_memories(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """`ids` (input_index, id) with `found` and the read columns."""
    rows = only_ids(memories.select([c for c in S.READ_COLUMNS if c in memories.columns]), ids)
    rows = cut_lineage(rows.withColumn("found", F.lit(True)))       # measured, weighed and joined: the table is read once
    return join_unique(ids, rows, ["id"], "input_index").fillna(False, ["found"])


def count_memories(memories: DataFrame, user_id: str, as_of, include_deleted: bool = False,
                   tags: list[str] | None = None, provider: str | None = None,
                   cleanup: Cleanup | None = None) -> DataFrame:
    """`n`: how many rows match."""
    rows = memories.filter(for_user(user_id) & visible(as_of, include_deleted) & tags_overlap(tags)
                           & from_provider(provider))
    if cleanup is not None:
        rows = rows.filter(cleanup.column(as_of))
    return rows.agg(F.count(F.lit(1)).alias("n"))


def memory_stats(memories: DataFrame, as_of, by: list[str] | None = None) -> DataFrame:
    """Counts by state, mean importance and creation span of undeleted rows, in one pass."""
    kept = F.col("deleted_at").isNull()
    return memories.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(active(as_of)).alias("active"),
        F.count_if(tombstone()).alias("soft_deleted"), F.count_if(expired(as_of)).alias("expired"),
        F.avg(F.when(kept, F.col("importance"))).alias("avg_importance"),
        F.min(F.when(kept, F.col("created_at"))).alias("oldest_created_at"),
        F.max(F.when(kept, F.col("created_at"))).alias("newest_created_at"))


def list_tags(memories: DataFrame, user_id: str, as_of, include_deleted: bool = False,
              limit: int | None = None) -> DataFrame:
    """`tag, n`, most used first."""
    n = check_limit(limit, S.MAX_TAG_ROWS, S.MAX_TAG_ROWS)
    rows = memories.filter(for_user(user_id) & visible(as_of, include_deleted))
    tags = rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.orderBy(F.desc("n"), "tag").limit(n)


def count_by_provider(memories: DataFrame, user_id: str) -> DataFrame:
    """`provider, n` over undeleted rows, expired ones included; no provider reads `(none)`."""
    rows = memories.filter(for_user(user_id) & F.col("deleted_at").isNull())
    provider = F.coalesce("source_provider", F.lit("(none)")).alias("provider")
    return rows.groupBy(provider).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "provider")


def embedding_model_counts(memories: DataFrame, provider: str, model: str) -> DataFrame:
    """`embedding_provider, embedding_model, n, stale`: progress of a re-embedding."""
    return memories.groupBy("embedding_provider", "embedding_model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(stale_embedding(provider, model)).alias("stale"))


def remember_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("ok and not already_existed")).alias("inserted"),
                       F.count_if(F.expr("ok and already_existed")).alias("duplicates"),
                       F.count_if(~F.col("ok")).alias("errors"))


def update_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ok")).alias("updated"),
                       F.count_if(~F.col("ok")).alias("errors"))


def forget_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"),
                       F.count_if(F.expr("ok and not already_deleted")).alias("deleted"),
                       F.count_if(F.expr("ok and already_deleted")).alias("already_deleted"),
                       F.count_if(~F.col("ok")).alias("errors"))


def fetch_count(df: DataFrame) -> DataFrame:
    """`n`, one row."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def exists(df: DataFrame) -> Column:
    """Whether there is a row, as a scalar subquery of the plan it stands in."""
    return df.limit(1).agg(F.count(F.lit(1)) > 0).scalar()


def fetch_one(df: DataFrame, column: str, order: list[str]) -> Column:
    """The first row's value of a column, null without rows, as a scalar subquery."""
    return df.orderBy(*order).limit(1).agg(F.first(column)).scalar()


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 0) of `size` rows of a totally ordered frame; size < 1 gives all rows."""
    return df if size < 1 else df.offset(number * size).limit(size)
