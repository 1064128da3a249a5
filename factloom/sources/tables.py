"""The memories table as Parquet."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema as S

_POINTER = "version int, path string, next_id long"


def load_memories(spark: SparkSession, path: str) -> DataFrame:
    """The table with all columns; defaults stand in for columns that the files lack."""
    return S.as_memories(spark.read.option("mergeSchema", True).parquet(path))


def save_memories(memories: DataFrame, path: str, mode: str = "error", by_user: bool = False) -> None:
    """Write the table to a new folder. Change jobs read one folder and write another, never the same."""
    out = S.as_memories(memories).write.mode(mode)
    (out.partitionBy("user_id") if by_user else out).parquet(path)


class Snapshot(NamedTuple):
    memories: DataFrame
    next_id: int        # the least id never given out
    version: int


def save_snapshot(memories: DataFrame, root: str, next_id: int | None = None) -> Snapshot:
    """Write the table as the next version below `root` and point to it; returns what a reader now sees.

    The rows are written first and the pointer, one row, last, so a reader never sees half a version. Two writers
    of one version: the second pointer fails. The mark of ids never goes back, also when the rows with the
    largest ids have been deleted.
    """
    spark = memories.sparkSession
    before = _pointer(spark, root)
    version = (before.version if before else 0) + 1
    path = f"{root}/rows/v{version}-{uuid.uuid4().hex}"
    save_memories(memories, path)
    found = load_memories(spark, path)
    top = found.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    mark = max(top, next_id or 1, before.next_id if before else 1)
    row = spark.createDataFrame([(version, path, mark)], _POINTER)
    row.coalesce(1).write.mode("error").parquet(f"{root}/pointers/version={version}")
    return Snapshot(found, mark, version)


def load_snapshot(spark: SparkSession, root: str) -> Snapshot:
    """The newest version that was written to its end."""
    now = _pointer(spark, root)
    if now is None:
        raise FileNotFoundError(f"no snapshot below {root}")
    return Snapshot(load_memories(spark, now.path), now.next_id, now.version)


def _pointer(spark: SparkSession, root: str):
    try:
        return spark.read.schema(_POINTER).parquet(f"{root}/pointers/*").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
