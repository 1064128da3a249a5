"""Registered queries: column cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import jsonfields as J
from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.plans.registry import read, register


@register("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN NULL
    WHEN 6 THEN strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(30 - date_part('day', last_day(o_orderdate)) AS INTEGER)), '%Y-%m-%d')
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders""")
def clean_dates(spark, sf_dir):
    """Order dates written in seven ways; the last two are not a date and day 31 of any month."""
    d, way = F.col("o_orderdate"), F.col("o_orderkey") % 7
    raw = (F.when(way == 0, F.date_format(d, "yyyy-MM-dd")).when(way == 1, F.date_format(d, "M/d/yyyy"))
           .when(way == 2, F.date_format(d, "MM/dd/yy")).when(way == 3, F.date_format(d, "M.d.yyyy"))
           .when(way == 4, F.date_format(d, "yyyy-M-d")).when(way == 5, F.date_format(d, "d MMM yyyy"))
           .otherwise(F.concat(F.date_format(d, "MM"), F.lit("/31/"), F.date_format(d, "yyyy"))))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(D.clean_date(raw, 2024), "yyyy-MM-dd").alias("d"))


@register("""SELECT event_id, strftime(CASE event_id % 5 WHEN 4 THEN TIMESTAMP '1970-01-01' + to_seconds(20241301) ELSE ts END,
  '%Y-%m-%d') AS d FROM events""")
def clean_epoch_dates(spark, sf_dir):
    ts, way = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 5
    seconds = F.unix_seconds(F.to_timestamp_ltz(F.concat(ts.cast("string"), F.lit("Z"))))
    raw = (F.when(way == 0, F.date_format(ts, "yyyyMMddHHmm").cast("long"))
           .when(way == 1, F.date_format(ts, "yyyyMMdd").cast("long")).when(way == 2, seconds)
           .when(way == 3, seconds * 1000 + 5).otherwise(F.lit(20241301).cast("long")))
    return read(spark, sf_dir, "events").select(
        "event_id", F.date_format(D.clean_epoch_date(raw), "yyyy-MM-dd").alias("d"))


@register("""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, strftime(d + 45, '%Y-%m-%d') AS plus_days, strftime(d + INTERVAL 7 MONTH, '%Y-%m-%d') AS plus_months,
  strftime(d + INTERVAL 3 YEAR, '%Y-%m-%d') AS plus_years, CAST(d - DATE '1995-06-17' AS BIGINT) AS days_between, dayname(d) AS day_name,
  monthname(d) AS month_name, CAST(dayofweek(d) AS INTEGER) AS day_of_week, CAST(d - DATE '0001-01-01' + 1 AS BIGINT) AS julian,
  month(d) || '/' || day(d) || strftime(d, '/%y') AS short_format, month(d) || '/' || day(d) || '/' || year(d) AS full_format,
  strftime(d, '%Y-%m-%d') AS sql_format, strftime(d, '%b ') || day(d) || ', ' || year(d) AS long_format,
  strftime(d, '%a, %b ') || day(d) || ', ' || year(d) AS weekday_format FROM t""")
def date_features(spark, sf_dir):
    made = D.date_features(F.col("o_orderdate").cast("date"), F.lit("1995-06-17").cast("date"), 45, 7, 3)
    shown = [F.date_format(c, "yyyy-MM-dd").alias(n) if n.startswith("plus_") else c.alias(n) for n, c in made.items()]
    return read(spark, sf_dir, "orders").select("o_orderkey", *shown)


@register("""WITH t AS (SELECT event_id, date_trunc('minute', ts) AS a, TIMESTAMP '2024-01-01 00:30:00' AS b,
  CAST(date_part('hour', ts) AS INTEGER) AS h, CAST(date_part('minute', ts) AS INTEGER) AS m FROM events)
SELECT event_id, CAST(date_diff('minute', b, a) AS BIGINT) AS minutes,
  CAST(CASE event_id % 4 WHEN 0 THEN h * 100 + m WHEN 1 THEN h * 100 + m WHEN 2 THEN h * 100 ELSE -1 END AS INTEGER) AS hhmm,
  CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || CASE WHEN h >= 12 THEN ' PM' ELSE ' AM' END AS clock
FROM t""")
def minute_features(spark, sf_dir):
    ts, way = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 4
    number = F.date_format(ts, "yyyyMMddHHmm").cast("long")
    raw = (F.when(way == 0, F.date_format(ts, " h:mma")).when(way == 1, F.date_format(ts, "HHmm"))
           .when(way == 2, F.date_format(ts, "h a")).otherwise(F.date_format(ts, "'at' HH:mm")))
    clock = D.format_ampm((F.hour(ts) * 100 + F.minute(ts)))
    # New York keeps one offset all January, so the wall-clock gap is the real one.
    return read(spark, sf_dir, "events").select(
        "event_id", D.diff_minutes(number, F.lit(202401010030).cast("long"), "America/New_York").alias("minutes"),
        D.parse_hhmm(raw).alias("hhmm"), clock.alias("clock"))


@register("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, bool_and(l_linenumber % 2 = 0) AS valid,
  round(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE -l_extendedprice END), 2) AS parsed,
  round(sum(floor(l_extendedprice * 10 + 0.5) / 10), 4) AS rounded, round(sum(-ceil(l_extendedprice)), 4) AS up,
  round(sum(-floor(l_extendedprice)), 4) AS down, round(sum(floor(-l_extendedprice)), 4) AS whole
FROM lineitem GROUP BY 1, 2, 3""")
def clean_numbers(spark, sf_dir):
    price, even = F.col("l_extendedprice"), F.col("l_linenumber") % 2 == 0
    raw = F.when(even, F.concat(F.lit(" "), F.format_number(price, 2))).otherwise(
        F.concat(F.lit("-"), F.format_number(price, 2), F.lit(" EUR")))
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", N.is_valid_number(raw).alias("valid"),
        N.parse_number(F.btrim(raw)).alias("parsed"), N.round_half_away(price, 1).alias("rounded"),
        N.round_up(-price, 0).alias("up"), N.round_down(-price, 0).alias("down"), N.whole_part(-price).alias("whole"))
    sums = [F.round(F.sum(c), 2 if c == "parsed" else 4).alias(c) for c in ("parsed", "rounded", "up", "down", "whole")]
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("valid").alias("valid"), *sums)


def _html_sql():
    t = "regexp_replace(html, '<br *[^>]*>', chr(10), 'g')"
    for curly, straight in (("‘’‛❛❜", "''"), ("“‟”❝❞〝〞", '"')):
        for ch in curly:
            t = f"replace({t}, '{ch}', '{straight if straight != chr(39) * 2 else chr(39) * 2}')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for entity, ch in X.ENTITIES:
        t = f"replace({t}, '{entity}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return t


@register(f"SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT page_id, {_html_sql()} AS t FROM pages)")
def html_to_text(spark, sf_dir):
    t = X.html_to_text(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(t).alias("text_md5"), F.char_length(t).alias("n_chars"))


def _fold_sql():
    t = "text"
    for sign, spelling in X.ASCII_SPELLING.items():
        t = f"replace({t}, '{sign}', '{spelling.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace(strip_accents({t}), '[^\x00-\x7F]', '', 'g')"


@register(f"SELECT doc_id, md5({_fold_sql()}) AS text_md5 FROM documents")
def ascii_fold(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.ascii_fold("text")).alias("text_md5"))


@register("""WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, event_type, ts FROM events)
SELECT event_id, CAST(k AS VARCHAR) AS k_text, k AS k_int, CAST(k AS BIGINT) AS k_long, value AS second, event_type AS name,
  left(event_type, 1) AS letter, k % 2 = 0 AS flag, false AS no_flag, strftime(ts, '%Y-%m-%d') AS day,
  CAST(NULL AS VARCHAR) AS gone, '[1.5,' || regexp_replace(CAST(value AS VARCHAR), '[.]0$', '') || ']' AS list FROM k""")
def extract_json_fields(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    doc = F.to_json(F.struct(
        k.alias("k"), F.struct(F.array(F.struct(F.col("event_type").alias("name"), (k % 2 == 0).alias("flag"))).alias("b")).alias("a"),
        F.array(F.lit(1.5), F.col("value")).alias("v"), F.date_format("ts", "M/d/yyyy").alias("day")))
    c = F.col("doc")
    return ev.select("event_id", doc.alias("doc")).select(
        "event_id", J.json_field(c, "k").alias("k_text"), J.json_field(c, "k", "int").alias("k_int"),
        J.json_field(c, "k", "long").alias("k_long"), J.json_field(c, "v[1]", "double").alias("second"),
        J.json_field(c, "a.b[0].name").alias("name"), J.json_field(c, "a.b[0].name", "char").alias("letter"),
        J.json_field(c, "a.b[0].flag", "boolean").alias("flag"), J.json_field(c, "a.b[3].flag", "boolean").alias("no_flag"),
        F.date_format(J.json_field(c, "day", "date"), "yyyy-MM-dd").alias("day"), J.json_field(c, "x.y").alias("gone"),
        J.json_field(c, "v", "array").alias("list"))
