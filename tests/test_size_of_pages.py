from pathlib import Path

from pyspark.sql import functions as F

from factloom.sources import pages


def test_no_page_file_holds_more_than_its_rows(spark, tmp_path):
    path = str(tmp_path / "pages")
    df = spark.range(9000).select((F.col("id") * 7919 % 9000).alias("id"))
    pages.write_pages(df, path, [F.desc("id")], rows_per_file=100)
    held = spark.read.parquet(f"{path}/directory").collect()
    assert max(r.n for r in held) == 100 and sum(r.n for r in held) == 9000
    assert len({Path(r.file).name.split("-c")[0] for r in held}) <= 4       # so many tasks wrote them
    assert [r.id for r in pages.read_page(spark, path, 77, 30, [F.desc("id")]).collect()] == list(range(8999 - 77 * 30, 8999 - 78 * 30, -1))
