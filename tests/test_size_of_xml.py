from pyspark.sql import functions as F

from factloom.sources import files


def test_xml_files_are_bounded(spark, tmp_path):
    df = spark.range(70).select("id", F.lit("x").alias("name")).coalesce(1)
    path = tmp_path / "xml"
    files.write_xml_rows(df, str(path), "item", rows_per_file=20)
    assert len(list(path.glob("part-*"))) == 4
    assert sorted(r.id for r in files.read_xml_rows(spark, str(path), "item", schema=df.schema).collect()) == list(range(70))
