"""Pages of a sorted table, read from the files that hold them.

Layout below `path`:

    rows/           the table in a total order, in files of at most `rows_per_file` rows
    directory/      one row per file: its name, its number of rows, how many rows stand before it

The table is sorted once, when it is written. A page then costs the directory and the one or two files it lies in, whatever its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import shuffle_partitions

ROWS_PER_FILE = 1_000_000


def write_pages(df: DataFrame, path: str, order: list, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write `df` in the order of `order` (columns that tell all rows apart) with its directory."""
    spark = df.sparkSession
    files = max(1, -(-df.count() // rows_per_file))
    tasks = min(files, max(shuffle_partitions(spark), -(-files * rows_per_file // ROWS_PER_FILE)))       # a task writes its range file after file
    placed = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("_place").alias("place"), F.count(F.lit(1)).alias("n"))
    before = W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)           # one row per file
    held = held.select("file", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    held.coalesce(1).write.parquet(f"{path}/directory")


def read_page(spark: SparkSession, path: str, number: int, size: int, order: list) -> DataFrame:
    """Page `number` (from 0) of `size` rows, in order. Only the files that hold some of its rows are read."""
    lo, hi = number * size, (number + 1) * size
    found = spark.read.parquet(f"{path}/directory").filter((F.col("first") < hi) & (F.col("first") + F.col("n") > lo))
    files = sorted((r["first"], r.file) for r in found.collect())               # those of one page
    rows = spark.read.parquet(f"{path}/rows")
    if not files:
        return rows.filter("false").drop("_place")
    held = spark.read.schema(rows.schema).parquet(*[f for _, f in files])
    return held.orderBy(*order).offset(lo - files[0][0]).limit(size).drop("_place")
