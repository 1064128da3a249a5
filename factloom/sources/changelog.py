"""Small changes without a new copy of the table: a log of changed rows beside the snapshots, merged when read.

Layout below `root`, beside the rows and pointers of the snapshots:

    changes/entry=N/        the new rows, and the ids of deleted rows, of change N
    applied/version=V/      one row: the last change that version V already holds

A change is one folder, visible when Spark has committed it; two writers of one number: the second fails. A reader merges the changes
that came after its version. `compact` writes the merged table as the next version.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schema as S
from factloom.operators.skew import broadcast_if_small, only_ids
from factloom.sources.tables import Snapshot, load_snapshot, save_snapshot

_APPLIED = "version int, entry int"


class Merged(NamedTuple):
    memories: DataFrame
    next_id: int        # the least id never given out
    version: int
    entry: int          # the last change that is merged in


def _entries(spark: SparkSession, root: str):
    """The changed rows with the number of their change and whether they are deletions; None before the first."""
    columns = T.StructType([*S.MEMORIES.fields, T.StructField("gone", T.BooleanType()), T.StructField("entry", T.IntegerType())])
    try:
        return spark.read.schema(columns).parquet(f"{root}/changes")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _applied(spark: SparkSession, root: str, version: int) -> int:
    try:
        found = spark.read.schema(_APPLIED).parquet(f"{root}/applied").filter(F.col("version") == version).agg(F.max("entry")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    return found or 0


def changed_rows(before: DataFrame, after: DataFrame, ids: DataFrame) -> DataFrame:
    """What a change did to the rows `ids`: the rows of `after`, and as `gone` those of `before` that are no longer there."""
    now = S.as_memories(only_ids(after, ids))
    was = S.as_memories(only_ids(before, ids)).select("id")
    gone = was.join(broadcast_if_small(now.select("id")), "id", "left_anti")
    return now.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True)


def append_changes(spark: SparkSession, root: str, rows: DataFrame) -> int:
    """Add a change (rows as `changed_rows` gives them) to the log; returns its number. Only the changed rows are written."""
    log = _entries(spark, root)
    entry = 1 + (log.agg(F.max("entry")).first()[0] or 0 if log is not None else 0)
    marked = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
    whole = S.as_memories(marked.drop("gone")).columns
    marked.select(*[F.col(c).cast(S.MEMORIES[c].dataType).alias(c) for c in whole], "gone").write.mode("error").parquet(f"{root}/changes/entry={entry}")
    return entry


def log_change(spark: SparkSession, root: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Run `change` on the rows `ids` of the merged table alone and log what it did to them; the other rows are only read past."""
    held = only_ids(load_merged(spark, root).memories, ids)
    return append_changes(spark, root, changed_rows(held, change(held), ids))


def load_merged(spark: SparkSession, root: str) -> Merged:
    """The newest version with all later changes: of every id the last change counts.

    The ids of the log are few beside the table, so the table is read without a shuffle while they are small, and
    only they are sorted.
    """
    base = load_snapshot(spark, root)
    start = _applied(spark, root, base.version)
    log = _entries(spark, root)
    if log is None:
        return Merged(base.memories, base.next_id, base.version, start)
    log = log.filter(F.col("entry") > start)
    last = log.withColumn("_nth", F.row_number().over(W.partitionBy("id").orderBy(F.desc("entry")))).filter("_nth = 1").drop("_nth")
    old = only_ids(base.memories, log, keep=False)
    top = log.agg(F.max("entry").alias("entry"), F.max("id").alias("id")).first()
    rows = old.unionByName(last.filter("not gone").select(*base.memories.columns))
    return Merged(rows, max(base.next_id, (top.id or 0) + 1), base.version, top.entry or start)


def compact(spark: SparkSession, root: str) -> Snapshot:
    """Write the merged table as the next version, which holds all changes so far.

    The number of the last change is written before the pointer, so no reader applies a change twice; changes that come meanwhile stay in the log.
    """
    now = load_merged(spark, root)
    row = spark.createDataFrame([(now.version + 1, now.entry)], _APPLIED)
    row.coalesce(1).write.mode("append").parquet(f"{root}/applied")
    return save_snapshot(now.memories, root, now.next_id)
