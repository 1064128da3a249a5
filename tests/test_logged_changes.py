from pyspark.sql import functions as F

from factloom.operators import changes as E
from factloom.plans.fixture import AS_OF
from factloom.sources import changelog, tables
from tests.helpers import memories


def test_a_logged_change_sees_its_rows_only(spark, tmp_path):
    root = str(tmp_path / "log")
    tables.save_snapshot(memories(spark, [{"text": f"t{i}"} for i in range(30)]), root)
    ids = spark.range(5, 9).select(F.col("id").alias("input_index"), "id")
    held = []

    def confirm(rows):
        held.append(rows.count())
        return E.confirm(rows, ids, AS_OF).memories

    changelog.log_change(spark, root, ids, confirm)
    gone = spark.range(8, 40).select(F.col("id").alias("input_index"), "id")
    changelog.log_change(spark, root, gone, lambda rows: E.forget(rows, gone, AS_OF, hard=True).memories)
    now = changelog.load_merged(spark, root).memories.collect()
    assert held == [4]
    assert sorted((r.id, r.last_confirmed_at) for r in now) == [(i, AS_OF if i >= 5 else None) for i in range(1, 8)]
