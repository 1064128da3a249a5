"""Remembering items as they arrive, each micro-batch seeing all earlier ones.

Layout below `root`, a folder all executors share:

    base/                              the table at the start (may be absent)
    parts/<name>/inserted, results     what a batch added and what became of its items, under a name of its own
    commits/first=F/last=L/            one row: the part that holds batches F to L

Nothing is ever overwritten. A part counts when its commit is there, so a reader never sees half a batch, and a batch that is run
again after a failure writes a new part, or nothing if its commit was made. FOLD parts of neighbouring batches are folded into one, and FOLD of
those again, so after n batches a reader opens a few parts for each power of FOLD, however many micro-batches there were.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factloom import schema as S
from factloom.operators.prepare import EmbeddingProvider
from factloom.operators.remember import remember_batch
from factloom.session import shuffle_partitions

FOLD = 8
_COMMIT = "path string, first long, last long"


def _read(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(*paths)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def parts(spark: SparkSession, root: str, before: int | None = None) -> list[Row]:
    """The commits (`path, first, last`) that together hold all batches done, or those before one: the widest first."""
    made = _read(spark, [f"{root}/commits"], _COMMIT)
    if before is not None:
        made = made.filter(F.col("last") < before)
    widest: dict[int, Row] = {}
    for r in made.collect():                    # a row for every part
        if r.first not in widest or r["last"] > widest[r.first]["last"]:
            widest[r.first] = r
    chosen, upto = [], -1
    for first in sorted(widest):
        if first > upto:
            chosen.append(widest[first])
            upto = widest[first]["last"]
    return chosen


def stream_table(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The table as of the batches done, or as batch `before` sees it."""
    base = S.as_memories(_read(spark, [f"{root}/base"], S.MEMORIES))
    held = [f"{r.path}/inserted" for r in parts(spark, root, before)]
    return base.unionByName(_read(spark, held, S.MEMORIES)) if held else base


def stream_results(spark: SparkSession, root: str) -> DataFrame:
    """What became of the items of all batches done."""
    held = [f"{r.path}/results" for r in parts(spark, root)]
    if not held:
        raise FileNotFoundError(f"no batch below {root}")
    return spark.read.parquet(*held)


def _commit(spark: SparkSession, root: str, path: str, first: int, last: int) -> None:
    """One row, visible when Spark has committed it; a second commit of the same batches fails."""
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("error").parquet(f"{root}/commits/first={first}/last={last}")


def take_batch(batch: DataFrame, batch_id: int, root: str, provider: EmbeddingProvider | None, now, **options) -> None:
    """Remember the items of one micro-batch, once."""
    spark = batch.sparkSession
    if any(r.first <= batch_id <= r["last"] for r in parts(spark, root)):
        return
    done = remember_batch(stream_table(spark, root, before=batch_id), batch, now, provider, **options)
    path = f"{root}/parts/{uuid.uuid4().hex}"
    done.inserted.write.parquet(f"{path}/inserted")
    done.results.write.parquet(f"{path}/results")
    _commit(spark, root, path, batch_id, batch_id)
    fold(spark, root)


def fold(spark: SparkSession, root: str) -> None:
    """Fold the last FOLD parts of one width into one, as long as there are so many."""
    while True:
        held = parts(spark, root)
        width = held[-1]["last"] - held[-1].first + 1 if held else 0
        last = [r for r in held[-FOLD:] if r["last"] - r.first + 1 == width]
        if len(last) < FOLD:
            return
        path = f"{root}/parts/{uuid.uuid4().hex}"
        for kind in ("inserted", "results"):
            spark.read.parquet(*[f"{r.path}/{kind}" for r in last]).coalesce(shuffle_partitions(spark)).write.parquet(f"{path}/{kind}")
        _commit(spark, root, path, last[0].first, last[-1]["last"])


def remember_stream(items: DataFrame, root: str, provider: EmbeddingProvider | None, as_of=None, *,
                    default_policy: str = "skip_if_near", user_id: str = "default",
                    available_now: bool = True, **options) -> StreamingQuery:
    """Start a stream that remembers the items of each micro-batch in `input_index` order.

    `as_of` fixes the clock; by default it is the time of the batch.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        now = as_of if as_of is not None else batch.sparkSession.sql("select current_timestamp() as t").first().t
        take_batch(batch, batch_id, root, provider, now, user_id=user_id, default_policy=default_policy, **options)

    writer = items.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
