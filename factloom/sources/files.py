"""Fact files, delimited files, JSON rows and XML."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.errors import INVALID_INPUT, RequestError
from factloom.functions.text import _BLANKS, bad_iso, parse_iso, split_tags
from factloom.operators.skew import broadcast_if_small
from factloom.session import cut_lineage

# ---- fact files ---------------------------------------------------------------------------

FACT_JSON = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("source_provider", T.StringType()), T.StructField("importance", T.DoubleType()),
    T.StructField("capture_mode", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("dedup_policy", T.StringType()), T.StructField("expires_at", T.StringType()),
    T.StructField("last_confirmed_at", T.StringType())])


def fact_lines(lines: DataFrame, col: str = "value", tags_csv: str | None = None) -> DataFrame:
    """Lines to facts: ends trimmed, blank and `#` lines dropped, shared tags added as `tags`."""
    text = F.ltrim(F.rtrim(F.col(col), F.lit("\r \t")), F.lit(" \t"))
    tags = F.array(*[F.lit(t) for t in split_tags(tags_csv)]).cast("array<string>")
    rest = [c for c in lines.columns if c != col]
    return (lines.select(*rest, text.alias("text"), tags.alias("tags"))
            .filter((F.col("text") != "") & ~F.startswith("text", F.lit("#"))))


def _numbered(rows: DataFrame, out: str) -> DataFrame:
    """`rows` (with `_file`, `_block`, in the order they were read) numbered 0, 1, 2, ... by file, block and place, without a sort.

    A task reads a block in order, so numbers that rise in the task are the place in the block. A directory of the rows of every
    block, one row each, tells how many stand before it.
    """
    held = cut_lineage(rows.withColumn("_place", F.monotonically_increasing_id()))
    blocks = held.groupBy("_file", "_block").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    directory = cut_lineage(blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    placed = held.join(broadcast_if_small(directory), ["_file", "_block"])
    return placed.withColumn(out, F.col("_before") + F.col("_place") - F.col("_first")).drop("_file", "_block", "_place", "_first", "_before")


def read_fact_lines(spark: SparkSession, path: str, tags_csv: str | None = None) -> DataFrame:
    """One fact per line: `input_index` (0, 1, 2, ... in file and line order), `text`, `tags`."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return _numbered(fact_lines(lines, "value", tags_csv), "input_index").select("input_index", "text", "tags")


def _typed_items(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Item columns with dates as timestamps; a bad date fails the read."""
    def instant(name: str) -> Column:
        c = F.col(name)
        wrong = F.raise_error(F.concat(F.lit(f"{INVALID_INPUT}: not an ISO 8601 timestamp: "), c))
        return F.when(bad_iso(c), wrong.cast("timestamp")).otherwise(parse_iso(c)).alias(name)

    dates = ("expires_at", "last_confirmed_at")
    return rows.select(*keep, *[instant(f.name) if f.name in dates else F.col(f.name) for f in FACT_JSON.fields])


def read_fact_json(spark: SparkSession, path: str) -> DataFrame:
    """Items of files that each hold one JSON array: `input_index`, 0, 1, 2, ... by file path and then place, and the item columns."""
    rows = spark.read.schema(FACT_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_block"))
    return _typed_items(_numbered(placed, "input_index"), ["input_index"])


def json_items(df: DataFrame, col: str) -> DataFrame:
    """As `read_fact_json`, from a column whose texts are JSON arrays; the other columns are kept."""
    keep = [c for c in df.columns if c != col]
    items = df.select(*keep, F.inline(F.from_json(F.col(col), T.ArrayType(FACT_JSON))))
    return _typed_items(items, keep)


def read_facts(spark: SparkSession, path: str, fmt: str | None = None, tags_csv: str | None = None) -> DataFrame:
    """Fact lines or JSON items; without `fmt` a first character `[` means JSON."""
    if fmt not in (None, "json", "lines"):
        raise RequestError(INVALID_INPUT, f"unknown format {fmt!r}: give json, lines or none")
    if fmt is None:
        first = spark.read.text(path).filter(F.btrim("value", F.lit(_BLANKS)) != "").first()
        fmt = "json" if first and first.value.strip().startswith("[") else "lines"
    return read_fact_json(spark, path) if fmt == "json" else read_fact_lines(spark, path, tags_csv)


# ---- delimited files ----------------------------------------------------------------------

_LINE = "value string, file string, block long, line long, quotes long, starts0 long, starts1 long"


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """`file, nr, record`: the records of quoted text files, which may span lines, numbered from 0 in each file.

    A file is read in as many blocks as Spark makes of it. A block does not know whether it begins inside a quoted field: each
    line is numbered for both cases, and the quotes of all blocks before it, a row each, tell which case holds. Records of one
    line, nearly all, stay where they are; only the lines of longer ones are shuffled together.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, quotes, begun = None, 0, 0, [0, 0]
        for batch in batches:
            of = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            ends = [i for i in range(1, len(of)) if of[i] != of[i - 1]] + [len(of)]
            lo = 0
            for hi in ends:
                if hi == lo:
                    continue
                if of[lo] != now:
                    now, line, quotes, begun = of[lo], 0, 0, [0, 0]
                own = np.asarray(pc.count_substring(batch.column(0).slice(lo, hi - lo), quote)).astype(np.int64)
                upto = quotes + np.cumsum(own) - own          # quotes of the block before each line
                starts = [begun[k] + np.cumsum(upto % 2 == k) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(line + np.arange(hi - lo)), pa.array(upto + 0),
                     pa.array(starts[0]), pa.array(starts[1])], [x.split()[0] for x in _LINE.split(", ")])
                line, quotes, begun, lo = line + hi - lo, int(upto[-1] + own[-1]), [int(s[-1]) for s in starts], hi

    held = cut_lineage(lines.mapInArrow(number, _LINE))
    own = F.length(F.regexp_replace("value", f"[^{re.escape(quote)}]", ""))
    blocks = held.groupBy("file", "block").agg(F.max(F.col("quotes") + own).alias("quotes"), F.max("starts0").alias("starts0"), F.max("starts1").alias("starts1"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)       # a row per block
    blocks = blocks.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    begun = F.when(F.col("odd") == 0, F.col("starts0")).otherwise(F.col("starts1"))
    blocks = cut_lineage(blocks.select("file", "block", "odd", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("before")))
    placed = held.join(broadcast_if_small(blocks), ["file", "block"])
    nr = F.col("before") + F.when(F.col("odd") == 0, F.col("starts0")).otherwise(F.col("starts1")) - 1
    inside = (F.col("odd") + F.col("quotes")) % 2 == 1
    placed = placed.select("file", "block", "line", "value", nr.alias("nr"), (~inside & (own % 2 == 0)).alias("whole"))
    long = placed.filter("not whole").groupBy("file", "nr").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("l"))
    return placed.filter("whole").select("file", "nr", F.col("value").alias("record")).unionByName(
        long.select("file", "nr", F.array_join(F.col("l.value"), "\n").alias("record")))


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"',
                   required: list[str] | None = None, field_count: int | None = None) -> DataFrame:
    """A delimited file with a header: string columns named in lower case, values trimmed, gaps as ''.

    Quotes are doubled inside quoted fields, which may span lines; large files are read in parts all the same (see `records`). A
    quote inside a field that does not begin with one must not stand alone. Files of one folder must have the same header: another order of names is
    an error. Rows of blanks and delimiters are skipped. `required` headers that are missing, and with `field_count` rows of
    another length, are errors.
    """
    rows = cut_lineage(records(spark, path, quote).filter(F.btrim("record", F.lit(_BLANKS)) != ""))
    options = {"sep": delimiter, "quote": quote, "escape": quote, "emptyValue": "", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    first = rows.groupBy("file").agg(F.min("nr").alias("nr"))                      # a row per file
    heads = cut_lineage(rows.join(broadcast_if_small(first), ["file", "nr"]).select("file", "nr", F.regexp_replace("record", "^\ufeff|\r$", "").alias("record")))
    head = heads.orderBy("file").first()
    if head is None:
        raise RequestError(INVALID_INPUT, "no header")
    other = heads.filter(F.col("record") != head.record).first()
    if other is not None:
        raise RequestError(INVALID_INPUT, f"{other.file} has another header than {head.file}")
    names = next(csv.reader([head.record], delimiter=delimiter, quotechar=quote, skipinitialspace=True))
    names = [n.strip().lower() for n in names]
    missing = missing_headers(names, required or [])
    if missing:
        raise RequestError(INVALID_INPUT, f"missing headers: {', '.join(missing)}")
    if field_count is not None and len(names) != field_count:
        raise RequestError(INVALID_INPUT, f"expected {field_count} fields, the header has {len(names)}")
    # Positions, because a header may hold dots or repeat in another case.
    body = rows.join(broadcast_if_small(first.withColumnRenamed("nr", "head")), "file").filter("nr > head")
    text = F.regexp_replace("record", "\r$", "")
    schema = ", ".join([f"c{i} string" for i in range(len(names))] + ["broken string"])
    parsed = body.select(text.alias("record")).withColumn("r", F.from_csv("record", schema, options | {"columnNameOfCorruptRecord": "broken"}))
    if field_count is not None:
        wrong = F.raise_error(F.concat(F.lit(f"{INVALID_INPUT}: expected {field_count} fields: "), F.col("record")))
        parsed = parsed.withColumn("r", F.when(F.col("r.broken").isNotNull(), wrong.cast(parsed.schema["r"].dataType)).otherwise(F.col("r")))
    fields = [F.coalesce(F.btrim(F.col(f"r.c{i}"), F.lit(_BLANKS)), F.lit("")).alias(n)
              for i, n in enumerate(names) if n]
    out = parsed.select(*fields)
    return out.filter(F.concat(*[F.col(f"`{n}`") for n in out.columns]) != "")


def missing_headers(names: list[str], required: list[str]) -> list[str]:
    """The required headers not among `names`, in any case."""
    have = {n.lower() for n in names}
    return [r for r in required if r.lower() not in have]


def delimited_fields(df: DataFrame, no_zero: tuple[str, ...] = (), char_limit: dict[str, int] | None = None,
                     upper: tuple[str, ...] = (), date_format: str = "MM/dd/yyyy") -> DataFrame:
    """Every column as the text to write: trimmed, doubles to two places, dates formatted, nulls as ''."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, date_format)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.floor(c * 100 + 0.5) / 100).cast("string")
        elif f.name in no_zero:
            c = F.when(c != 0, c.cast("string"))
        else:
            c = F.btrim(c.cast("string"), F.lit(_BLANKS))
        limit = (char_limit or {}).get(f.name)
        if limit is not None:
            c = F.when(F.char_length(c) > limit, F.rtrim(c.substr(1, limit))).otherwise(c)
        if f.name in upper:
            c = F.upper(c)
        out.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(*out)


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', header: bool = False,
                    **formats) -> None:
    """Write with CRLF line ends; a field is quoted only when it holds the delimiter or a quote."""
    (delimited_fields(df, **formats).write.option("sep", delimiter).option("quote", quote).option("escape", quote)
     .option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "").option("header", header)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# ---- JSON rows ----------------------------------------------------------------------------

def rows_to_json(line: Column, names: list[str]) -> Column:
    """A comma-separated line as a JSON object with the given names; all values are strings."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return F.to_json(F.from_csv(line, schema, {"escape": '"', "ignoreLeadingWhiteSpace": "true"}))


def json_to_row(obj: Column, names: list[str]) -> Column:
    """A JSON object as a comma-separated line of the named members.

    A member with a comma, a line end or a leading quote is quoted, without its quotes and
    control characters; a missing member is empty.
    """
    def member(name: str) -> Column:
        v = F.coalesce(F.get_json_object(obj, f"$['{name}']"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.regexp_replace(v, r'[\x00-\x1F"]', ""), F.lit('"'))
        return F.when(v.rlike(r'[,\n\r\x00]|^"'), quoted).otherwise(v)

    return F.concat_ws(",", *[member(n) for n in names])


# ---- XML ----------------------------------------------------------------------------------

XML_ROWS_PER_FILE = 50_000


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, keep_strings: bool = False,
                  schema: T.StructType | str | None = None) -> DataFrame:
    """One row per `row_tag` element; with `keep_strings` every value stays text."""
    reader = spark.read.option("rowTag", row_tag).option("inferSchema", not keep_strings)
    return (reader.schema(schema) if schema is not None else reader).xml(path)


def write_xml_rows(df: DataFrame, path: str, row_tag: str, root_tag: str = "rows", rows_per_file: int = XML_ROWS_PER_FILE) -> None:
    """Write in files of at most `rows_per_file` rows: an XML file is always read by one task."""
    df.write.option("maxRecordsPerFile", rows_per_file).option("rowTag", row_tag).option("rootTag", root_tag).option("declaration", "").xml(path)
