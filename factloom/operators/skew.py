"""Joins and numbering that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import cut_lineage

HOT_SHARE = 1000        # a key with more than 1/1000 of the rows is hot, so there are fewer than 1000 of them
BITMAP_BYTES = 4096     # of one bitmap
SMALL_BYTES = 1 << 20   # a side measured to have at most so many bytes is broadcast; a job may hold several at once


def value_bytes(value: Column, kind: T.DataType) -> Column | int:
    """About the bytes of a value in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.MapType):
        return value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        each = value_bytes(F.lit(None).cast(kind.elementType), kind.elementType)
        if isinstance(each, int):
            return F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)).cast("long") * each + 16
        total = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + value_bytes(x, kind.elementType))
        return F.coalesce(total, F.lit(0).cast("long")) + 16
    if isinstance(kind, T.StructType):
        parts = [value_bytes(value[f.name], f.dataType) for f in kind.fields]
        fixed = sum(x for x in parts if isinstance(x, int))
        return sum((x for x in parts if not isinstance(x, int)), fixed)
    return 8


def _weighed(df: DataFrame) -> tuple:
    """(count, bytes) as aggregates over `df`."""
    parts = [value_bytes(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields]
    fixed = 16 + sum(x for x in parts if isinstance(x, int))
    varying = sum((x for x in parts if not isinstance(x, int)), F.lit(0).cast("long"))
    n = F.count(F.lit(1))
    return n.alias("n"), (n * fixed + F.coalesce(F.sum(varying), F.lit(0))).alias("b")


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether `df` is measured to fit into SMALL_BYTES (and has at most `max_rows` rows)."""
    found = df.agg(*_weighed(df)).first()
    return found.b <= SMALL_BYTES and (max_rows is None or found.n <= max_rows)


def join_unique(left: DataFrame, right: DataFrame, on: list[str], row_key: str, weight: str | None = None,
                small: int | None = None) -> DataFrame:
    """`left` with the columns of `right`, where `on` is unique in `right`; unmatched left rows keep nulls.

    A `right` measured to be small (and of at most `small` rows) is broadcast. Otherwise, where no key is hot, it is an ordinary join.
    Hot keys of `left` are joined by broadcast: fewer than HOT_SHARE right rows can be hot, so that side has a
    fixed bound. The rest is a shuffled join, where a row that is already served
    gets a key of its own (from `row_key`, a long column) that matches nothing, so no
    partition collects the hot rows. `weight` names a column of `right` that already holds
    the number of left rows per key. One job measures all this.
    """
    payload = [c for c in right.columns if c not in on]
    counted = right
    if weight is None:
        if is_small(right, small):
            return left.join(F.broadcast(right), on, "left").select(*left.columns, *payload)
        weight = "_weight"
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias(weight))
        counted = right.join(counts, on, "left").fillna(0, [weight])
    found = counted.agg(*_weighed(right), F.coalesce(F.sum(weight), F.lit(0)).alias("all"), F.coalesce(F.max(weight), F.lit(0)).alias("most")).first()
    if found.b <= SMALL_BYTES and (small is None or found.n <= small):
        return left.join(F.broadcast(right), on, "left").select(*left.columns, *payload)
    limit = found["all"] / HOT_SHARE
    if found.most <= limit:
        return left.join(right, on, "left").select(*left.columns, *payload)
    is_hot = F.col(weight) > limit
    hot = counted.filter(is_hot).select(*on, F.struct(*payload).alias("_hot"))
    cold = counted.filter(~is_hot).select(F.struct(*on).alias("_key"), F.lit(0).cast("long").alias("_none"),
                                          F.struct(*payload).alias("_cold"))
    served = left.join(F.broadcast(hot), on, "left")
    own = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.col(row_key) + 1)
    served = served.withColumn("_join", F.struct(*on)).withColumn("_own", own.cast("long"))
    joined = served.join(cold, (F.col("_join") == F.col("_key")) & (F.col("_own") == F.col("_none")), "left")
    return joined.select(*left.columns,
                         *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in payload])


def running_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """`df` with running totals (the row included) of columns in a total order, without one sorted task.

    Rows are range-partitioned by the order; each part sums its own rows, and what the parts before it hold, one
    row per part, is added. The order must tell all rows apart for a repeatable result.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    whole = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{o}") for o, c in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)         # one row per part
    offsets = whole.select("_part", *[F.coalesce(F.sum(f"_all_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in sums])
    upto = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = parts.select("*", *[F.sum(c).over(upto).alias(f"_in_{o}") for o, c in sums.items()])
    joined = inside.join(F.broadcast(offsets), "_part")                       # at most n rows
    return joined.select(*df.columns, *[(F.col(f"_in_{o}") + F.col(f"_off_{o}")).alias(o) for o in sums])


def dense_position(df: DataFrame, order: str, out: str, start=None) -> DataFrame:
    """`df` with `out` = start, start+1, ... in the order of the unique column `order`."""
    numbered = running_sums(df.withColumn("_one", F.lit(1).cast("long")), [order], {"_nth": "_one"})
    first = F.lit(0) if start is None else start
    return numbered.withColumn(out, (first + F.col("_nth") - 1).cast("long")).drop("_one", "_nth")


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint when it is measured to be small, else as it is.

    For change sets joined to the whole table: a small one spares the shuffle of the table,
    a large one is joined by shuffle.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def only_ids(df: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of `df` whose long `id` is in `ids` (or with `keep` false the others), without a shuffle where `ids` is small or dense.

    Ids beyond SMALL_BYTES go as bitmaps of 32,768 neighbouring ids each while these are measured to fit; ids spread too thinly
    for that are joined by shuffle.
    """
    how = "left_semi" if keep else "left_anti"
    ids = ids.select("id").filter("id is not null").distinct()
    if is_small(ids):
        return df.join(F.broadcast(ids), "id", how)
    ids = cut_lineage(ids)
    maps = ids.groupBy(F.bitmap_bucket_number("id").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("_bits"))
    if ids.select(F.bitmap_bucket_number("id").alias("_bucket")).distinct().count() * BITMAP_BYTES > SMALL_BYTES:
        return df.join(ids, "id", how)
    at = F.bitmap_bit_position("id")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    marked = df.withColumn("_bucket", F.bitmap_bucket_number("id")).join(F.broadcast(maps), "_bucket", "left")
    return marked.filter(there if keep else ~there).select(*df.columns)
