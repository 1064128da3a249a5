"""Line dedup: lines that several documents share stay in the first of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, two_hashes
from factloom.operators.skew import join_unique
from factloom.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """What makes two lines the same: ASCII blanks stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                      min_docs: int = 2) -> DataFrame:
    """`id, kept, n_lines, n_dropped` for every row: the text without the lines it shares with earlier documents.

    A key of at least `min_chars` code points found in at least `min_docs` documents stays only in the document with the least id
    that holds it (all its lines there). Lines are exploded and only their hashes travel; per hash the number of distinct
    documents and the least one are counted, and the kept lines are put together in their order. A null or empty text is
    one empty line. Rows with a null id are one document after all others. Rows that repeat an id are one document; each is
    returned. No column but the two named ones is read.
    """
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select("id", F.coalesce("id", last).alias("doc"), F.xxhash64("text").alias("of"), "text")
    lines = rows.select("doc", "of", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "of", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.filter(F.char_length("key") >= min_chars).select("doc", "of", "pos", *two_hashes(F.col("key")))
    several = [F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")]
    if min_docs == 2:        # two documents at least: the least and the largest differ
        counted = keyed.groupBy("h1", "h2").agg(*several, F.max("doc").alias("most")).filter("first != most")
    else:
        counted = (keyed.groupBy("h1", "h2", "doc").agg(F.count(F.lit(1)).alias("m"))
                   .groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("docs"))
                   .filter(F.col("docs") >= min_docs))
    shared = cut_lineage(counted.select("h1", "h2", "first", "n"))
    spread = keyed.withColumn("row", F.pmod(F.xxhash64("doc", "pos"), F.lit(1 << 40)))
    later = join_unique(spread, shared, ["h1", "h2"], "row", weight="n").filter(F.col("doc") > F.col("first"))
    gone = later.groupBy("doc", "of").agg(F.collect_set("pos").alias("gone"))      # at most a document's lines
    whole = rows.join(gone, ["doc", "of"], "left")
    split = whole.select("id", "text", "gone", F.split("text", "\n").alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n")
    return split.select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
                        F.size("lines").cast("long").alias("n_lines"),
                        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > s.first, false) AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
