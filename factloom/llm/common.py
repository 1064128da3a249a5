"""Text expressions and joins that several operators here share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.skew import join_unique, running_sums  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"                                  # what stands between words
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"                 # what stands between words of letters and digits


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    while name in df.columns:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. `lower` is quicker and the same on ASCII text."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, LOWER)))


def words(text: Column, between: str) -> Column:
    """The words between matches of `between`; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def lookup(left: DataFrame, right: DataFrame, on: list[str], spread: str) -> DataFrame:
    """`left` with the columns of `right` (unique in `on`), nulls where it has none, whatever share of the rows one key
    holds. `spread` is any column of `left` that differs between rows of one key."""
    rows = left.withColumn("_row", F.pmod(F.xxhash64(spread), F.lit(1 << 40)))
    return join_unique(rows, right, on, "_row").drop("_row")


def let(value: Column, use) -> Column:
    """`use` of `value` as one bound value: lambdas inside see it computed once per row, not once per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def two_hashes(value: Column) -> list[Column]:
    """128 bits that stand for a text in shuffles: chance meetings don't occur at any size."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit("second"), value).alias("h2")]


def block_pairs(spread: Column, blocks: Column, looks: Column) -> Column:
    """The block pairs (i, j) of its group that a row takes part in, as an array of structs i, j, side.

    Owners (`looks` 0) of a group meet each other and all lookers (`looks` 1); lookers don't meet. A group of `blocks`
    blocks is split by hash of `spread`; owner block i meets owner block j >= i and the lookers of every
    block once, so a pair meets in one task and no task holds more than two blocks.
    Side 0 is compared with its whole block, side 1 with side 2 only; sorted by side, partners come after.
    """
    n = F.coalesce(blocks, F.lit(1))
    own = F.pmod(F.xxhash64(spread), n).cast("int")

    def at(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    every = F.sequence(F.lit(0), n - 1)
    left = F.transform(every, lambda j: at(own, j, F.when(j == own, 0).otherwise(1)))
    right = F.transform(F.filter(every, lambda i: i < own), lambda i: at(i, own, F.lit(2)))
    looking = F.transform(every, lambda i: at(i, own, F.lit(2)))
    return (F.when(n == 1, F.array(at(F.lit(0), F.lit(0), 2 * looks)))
            .when(looks == 1, looking).otherwise(F.concat(left, right)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the given links connect: from each row to the least of its group."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]
