import pytest
from pyspark.sql import functions as F

from factloom.operators import reports, skew
from tests.helpers import memories


@pytest.mark.parametrize("small, shuffled", [(1 << 20, False), (1 << 14, False), (0, True)])
@pytest.mark.parametrize("keep", [True, False])
def test_only_ids(spark, monkeypatch, small, shuffled, keep):
    rows = spark.range(-3000, 40_000).select(F.when(F.col("id") != 5, F.col("id")).alias("id"), F.lit("x").alias("t"))
    asked = spark.range(-9000, 60_000, 7).select("id").union(spark.createDataFrame([(None,), (0,), (0,)], "id long"))
    monkeypatch.setattr(skew, "SMALL_BYTES", small)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = skew.only_ids(rows, asked, keep)
        assert ("SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()) == shuffled
        got = [r.id for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    wanted = set(range(-9000, 60_000, 7)) | {0}
    have = [i if i != 5 else None for i in range(-3000, 40_000)]
    assert sorted(got, key=str) == sorted((i for i in have if (i in wanted) == keep), key=str) and found.columns == ["id", "t"]


def test_looked_up_rows_are_read_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    table = memories(spark, [{} for _ in range(40)]).withColumn("text", seen.asNondeterministic()("text"))
    ids = spark.range(30, 50).select(F.col("id").alias("input_index"), F.least("id", F.lit(45)).alias("id"))
    rows = reports.get_memories(table, ids).collect()
    assert {(r.input_index, r.id, r.found) for r in rows} == {(i, min(i, 45), min(i, 45) <= 40) for i in range(30, 50)}
    assert 0 < read.value <= 40
