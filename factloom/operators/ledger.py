"""Paid work that survives a crash: results are committed part by part and entered in a ledger.

Layout below `path`, a folder all executors share:

    todo/run=R/part=K/      what run R has to do, written once, by part
    done/run=R/part=K/      the results of a part, failed calls included
    ledger/                 one row for every part whose results are complete

A part counts when its ledger row is there, so half-written results are never read. The next run takes every good result
of every earlier one and does the rest only: parts that never finished, and calls that failed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 16
_ENTRY = "run string, part int, what string, n_ok long, n_failed long, path string"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: `run, part, what, n_ok, n_failed, path`."""
    try:
        return spark.read.schema(_ENTRY).parquet(f"{path}/ledger")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _ENTRY)


def resume(rows: DataFrame, key: list[str], what: str, work: Callable[[DataFrame], DataFrame], ok: str, path: str, parts: int = PARTS) -> DataFrame:
    """`work(rows)`, one row for each row of `rows`, where calls that an earlier run made well are not made again.

    `key` names the columns that make a call (they should hold a hash of what is sent); `what` says what does the work, for results of
    another model don't count; `ok` is an SQL condition on the results. `work` keeps the columns of `rows` and marks failed rows
    instead of raising. An error that it does raise ends the run; what was committed before stays.
    """
    spark = rows.sparkSession
    held = [r.path for r in entries(spark, path).filter(F.col("what") == what).collect()]       # a row per part and run
    known = None
    if held:
        known = spark.read.parquet(*held).filter(ok).dropDuplicates(key)
        rest = rows.join(known.select(*[F.col(c).alias(f"_{c}") for c in key]), _same(key), "left_anti")
    else:
        rest = rows
    run = uuid.uuid4().hex
    todo = f"{path}/todo/run={run}"
    place = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
    rest.withColumn("_part", place).write.partitionBy("_part").parquet(todo)
    there = sorted(r["_part"] for r in spark.read.schema(T.StructType([*rest.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(todo).select("_part").distinct().collect())
    for part in there:
        out = f"{path}/done/run={run}/part={part}"
        work(spark.read.schema(rest.schema).parquet(f"{todo}/_part={part}")).write.parquet(out)
        found = spark.read.parquet(out).agg(F.count_if(F.expr(ok)).alias("good"), F.count(F.lit(1)).alias("n")).first()
        entry = spark.createDataFrame([(run, part, what, found.good, found.n - found.good, out)], _ENTRY)
        entry.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    fresh = [f"{path}/done/run={run}/part={part}" for part in there]
    if known is None:
        return spark.read.parquet(*fresh) if fresh else work(rows.filter("false"))
    kept = known.join(rows.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct(), _same(key), "left_semi")
    return kept.unionByName(spark.read.parquet(*fresh)) if fresh else kept


def _same(key: list[str]) -> Column:
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return same
