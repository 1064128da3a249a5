import json

import pytest
from pyspark.sql import functions as F

from factloom.errors import RequestError
from factloom.sources import files, pages, tables
from tests.helpers import memories


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_fact_lines(spark, tmp_path):
    path = write(tmp_path, "f.txt", "  one \r\n# note\n\n\t \ntwo\t\n #x\nthree # not a note")
    got = files.read_facts(spark, path, tags_csv="a, b").orderBy("input_index").collect()
    assert [(r.text, r.tags) for r in got] == [(t, ["a", "b"]) for t in ("one", "two", "three # not a note")]


def test_fact_json(spark, tmp_path):
    items = [{"text": "one", "tags": ["x"], "importance": 0.7, "expires_at": "2027-01-01T00:00:00Z"}, {"text": "two"}]
    path = write(tmp_path, "f.json", "\n  " + json.dumps(items, indent=1))
    got = files.read_facts(spark, path).orderBy("input_index").collect()
    assert [(r.text, r.tags, r.importance) for r in got] == [("one", ["x"], 0.7), ("two", None, None)]
    assert got[0].expires_at.year == 2027
    bad = write(tmp_path, "bad.json", json.dumps([{"text": "a", "expires_at": "tomorrow"}]))
    with pytest.raises(Exception, match="ISO 8601"):
        files.read_fact_json(spark, bad).collect()
    with pytest.raises(RequestError):
        files.read_facts(spark, path, fmt="yaml")


def test_read_delimited(spark, tmp_path):
    path = write(tmp_path, "d.csv", 'Name;AGE;Note\n\n "Ann ""A"" B";5; plain \n;;\nBob;6\n"two\nlines";7;"a;b"\n')
    df = files.read_delimited(spark, path, ";", required=["age", "NAME"])
    assert df.columns == ["name", "age", "note"]
    assert sorted(tuple(r) for r in df.collect()) == [
        ('Ann "A" B', "5", "plain"), ("Bob", "6", ""), ("two\nlines", "7", "a;b")]
    with pytest.raises(RequestError, match="size"):
        files.read_delimited(spark, path, ";", required=["name", "size"])
    with pytest.raises(Exception):
        files.read_delimited(spark, path, ";", field_count=3).collect()
    with pytest.raises(RequestError):
        files.read_delimited(spark, path, ";", field_count=4)


def test_a_large_quoted_file_is_read_in_parts(spark, tmp_path):
    """Fields over several lines, blocks that begin inside one: the rows of the whole-file reader, from many tasks."""
    rows = []
    for i in range(4000):
        note = [f"plain {i}", f"two\nlines {i}", f'a ""quoted"" word; {i}', f"\n\n{i}\n;\n", ""][i % 5]
        rows.append(f'{i};"{note}";{i % 7}' if i % 5 else f"{i};{note};{i % 7}")
    path = write(tmp_path, "big.csv", "Id;Note;N\n" + "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        held = files.records(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() >= 8
        got = files.read_delimited(spark, path, ";", field_count=3).collect()
        assert sorted(r.nr for r in held.collect()) == list(range(4001))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.read.csv(path, header=True, sep=";", quote='"', escape='"', multiLine=True, emptyValue="")
    want = sorted((r[0], (r[1] or "").strip(), r[2]) for r in whole.collect())
    assert sorted(tuple(r) for r in got) == want and len(got) == 4000


def test_headers_of_a_folder(spark, tmp_path):
    write(tmp_path, "a.csv", "\ufeffName;Age\r\nAnn;5\r\n")
    write(tmp_path, "b.csv", "Name;Age\n\"Bob\r\nby\";6")
    got = files.read_delimited(spark, str(tmp_path), ";")
    assert got.columns == ["name", "age"] and sorted(tuple(r) for r in got.collect()) == [("Ann", "5"), ("Bob\r\nby", "6")]
    write(tmp_path, "c.csv", "Age;Name\n7;Cy\n")
    with pytest.raises(RequestError, match="another header"):
        files.read_delimited(spark, str(tmp_path), ";")
    empty = tmp_path / "none"
    empty.mkdir()
    write(empty, "a.csv", "\n \n")
    with pytest.raises(RequestError, match="no header"):
        files.read_delimited(spark, str(empty), ";")


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path):
    lines = [[f"{name} fact {i}" if i % 3 else "# note" for i in range(n)] for name, n in (("a", 2000), ("b", 3), ("c", 1500))]
    for name, own in zip("abc", lines):
        write(tmp_path, f"{name}.txt", "\n".join(own))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.read_fact_lines(spark, str(tmp_path))
        plan = got._jdf.queryExecution().toString()
        rows = sorted(got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [t for own in lines for t in own if not t.startswith("#")]
    assert [(r.input_index, r.text) for r in rows] == list(enumerate(want)) and "rangepartitioning" not in plan


def test_a_late_page_reads_one_or_two_files(spark, tmp_path):
    path = str(tmp_path / "pages")
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("id"), F.lit("x").alias("t"))
    pages.write_pages(df, path, ["id"], rows_per_file=1500)
    for number, size in ((0, 15), (1000, 15), (1333, 15), (1334, 15), (3, 4000)):
        got = pages.read_page(spark, path, number, size, ["id"])
        assert [r.id for r in got.collect()] == list(range(number * size, min((number + 1) * size, 20_000)))
        if size == 15 and number < 1334:
            assert 1 <= len(got.inputFiles()) <= 2
    assert got.columns == ["id", "t"]


def test_write_delimited(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', 2.345, 0, "2024-03-05"), (2, " x,y ", 1.0, 7, None), (3, None, None, 1, None)],
                               "id int, t string, d double, z int, day string").withColumn("day", F.col("day").cast("date"))
    path = str(tmp_path / "out")
    files.write_delimited(df.coalesce(1), path, no_zero=("z",), char_limit={"t": 4}, upper=("t",), date_format="M/d/yyyy")
    part = next((tmp_path / "out").glob("*.csv"))
    assert part.read_bytes() == b'1,"A ""B",2.35,,3/5/2024\r\n2,"X,Y",1.0,7,\r\n3,,,1,\r\n'


def test_json_rows(spark):
    df = spark.createDataFrame([('1, "a ""b"", c",x',), ("2,,",)], "line string")
    got = [r.j for r in df.select(files.rows_to_json(F.col("line"), ["k", "t", "u"]).alias("j")).collect()]
    assert json.loads(got[0]) == {"k": "1", "t": 'a "b", c', "u": "x"}
    objs = spark.createDataFrame([('{"a":"x,y","b":"say \\"hi\\"","c":5}',), ('{"b":"\\"q\\tz"}',)], "j string")
    lines = [r.x for r in objs.select(files.json_to_row(F.col("j"), ["a", "b", "c"]).alias("x")).collect()]
    assert lines == ['"x,y",say "hi",5', ',"qz",']


def test_xml(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & b", 1.5), (2, "007", None)], "id long, name string, v double")
    path = str(tmp_path / "xml")
    files.write_xml_rows(df, path, "item")
    assert sorted(map(tuple, files.read_xml_rows(spark, path, "item", schema=df.schema).collect())) == [
        (1, "a & b", 1.5), (2, "007", None)]
    kept = files.read_xml_rows(spark, path, "item", keep_strings=True).filter("id = '2'").first()
    assert kept.name == "007"


def test_table_round_trip_and_defaults(spark, tmp_path):
    m = memories(spark, [{"tags": ["a"]}, {"user_id": "v"}])
    path = str(tmp_path / "m")
    tables.save_memories(m, path, by_user=True)
    again = tables.load_memories(spark, path)
    assert again.schema.names == m.schema.names and sorted(r.id for r in again.collect()) == [1, 2]
    thin = str(tmp_path / "thin")
    m.select("id", "text").write.parquet(thin)
    r = tables.load_memories(spark, thin).first()
    assert (r.user_id, r.importance, r.metadata, r.record_version, r.tags) == ("default", 0.5, "{}", 1, [])
    with pytest.raises(Exception):
        tables.save_memories(m, path)
