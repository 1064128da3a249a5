import pytest
from pyspark.sql import functions as F

from factloom.operators import skew
from factloom.operators.neardup import near_duplicate_pairs
from tests.helpers import NOW, memories
from tests.test_neardup import model_pairs, table


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_join_unique(spark, monkeypatch, small):
    monkeypatch.setattr(skew, "SMALL_BYTES", small)
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000).alias("k"))
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.lit("x").alias("w"))
    got = {r.id: (r.k, r.v, r.w) for r in skew.join_unique(left, right, ["k"], "id").collect()}
    want = {}
    for i in range(3000):
        k = 7 if i % 3 == 0 else i % 2000
        want[i] = (k, k * 10, "x") if k < 1500 else (k, None, None)
    assert got == want


def test_hot_keys_do_not_meet_in_one_partition(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    left = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    right = spark.range(4000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = skew.join_unique(left, right, ["k"], "id")
    plan = joined._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    assert joined.agg(F.sum("v")).first()[0] == 4000


def test_pairs_without_small_sides(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    rows = table(90)
    got = near_duplicate_pairs(memories(spark, rows), NOW, 0.92, 4, "cells", block_rows=16).collect()
    assert {(r.user_id, r.id_a, r.id_b): r.similarity for r in got} == pytest.approx(model_pairs(rows, 0.92, 4))


def test_dense_position(spark):
    df = spark.range(5000).select((F.col("id") * 991 % 5003 * 100).alias("o"))
    got = [r.p for r in skew.dense_position(df, "o", "p", F.lit(5)).orderBy("o").collect()]
    assert got == list(range(5, 5005))


def test_broadcast_only_when_small(spark):
    df = spark.range(100)
    assert skew.broadcast_if_small(df, 10) is df
    assert "hint" in skew.broadcast_if_small(df, 100)._jdf.queryExecution().logical().toString().lower()


def test_size_is_measured_in_bytes(spark, monkeypatch):
    few = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("ab"), F.lit(None)).alias("a"),
                                 F.struct(F.lit(1).alias("n"), F.lit("y").alias("s")).alias("st"), F.create_map(F.lit("k"), F.lit(2)).alias("m"))
    many = spark.range(300).select("id")
    empty = few.filter("false")
    monkeypatch.setattr(skew, "SMALL_BYTES", 9000)
    assert not skew.is_small(few) and skew.is_small(many) and skew.is_small(empty)
    assert skew.is_small(few.drop("t")) and not skew.is_small(many, 299)
    assert skew.is_small(spark.createDataFrame([(None, None, None)], "a array<string>, b string, c array<array<long>>"))
