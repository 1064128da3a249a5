"""Registered queries: from documents to facts, and remembering as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import merge_tags as add_tags
from factloom.operators import ingest as I
from factloom.operators.prepare import MockEmbedding, embed_column
from factloom.plans.fixture import AS_OF, MEM, memories, norm_sql, stored_memories, trim_sql
from factloom.plans.registry import read, register
from factloom.session import scratch_path
from factloom.sources.tables import save_memories
from factloom.streaming import remember_stream as J

# Chunk by chunk: the window's second half is searched backwards for a blank line, then for a sentence end.
_CHUNKS = r"""WITH RECURSIVE src AS MATERIALIZED (SELECT doc_id, CASE WHEN lang = 'en' THEN replace(text, '. ', '.' || chr(10) || chr(10)) ELSE text END AS t FROM documents),
doc AS MATERIALIZED (SELECT doc_id, t, length(t) AS total FROM src),
cut AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS lo, CAST(0 AS BIGINT) AS hi FROM doc
  UNION ALL
  SELECT doc_id, n + 1, s, CASE WHEN s + 1000 >= total THEN total WHEN blank > 0 THEN s + 500 + length(back) - blank + 1
      WHEN stop > 0 THEN s + 501 + length(back2) - stop + 1 ELSE s + 1000 END
  FROM (SELECT doc_id, n, s, total, back, back2, strpos(back, chr(10) || chr(10)) AS blank,
      length(regexp_extract(back2, '^((?s:.)*?)[ \n][.!?]', 1)) + CASE WHEN regexp_matches(back2, '[ \n][.!?]') THEN 1 ELSE 0 END AS stop
    FROM (SELECT doc_id, n, hi AS s, total, reverse(substr(t, hi + 501, least(501, total - 1 - hi - 500))) AS back,
        reverse(substr(t, hi + 502, 501)) AS back2
      FROM cut JOIN doc USING (doc_id) WHERE hi < total)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS seq, md5(piece) AS text_md5 FROM (
  SELECT doc_id, n, regexp_replace(substr(t, lo + 1, hi - lo), '^[\n \t\r]+', '') AS piece FROM cut JOIN doc USING (doc_id) WHERE n > 0)
WHERE piece <> ''"""


@register(_CHUNKS)
def chunk_documents(spark, sf_dir):
    """Every document in chunks of 1000; the English ones have blank lines put in."""
    text = F.when(F.col("lang") == "en", F.replace("text", F.lit(". "), F.lit(".\n\n"))).otherwise(F.col("text"))
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return I.chunk_documents(docs, 1000).select("doc_id", "seq", F.md5("text").alias("text_md5"))


_FACTS = rf"""line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
fact AS (SELECT doc_id, line_no, {trim_sql('raw')} AS text FROM line WHERE {trim_sql('raw')} <> '')"""


def _whole(spark, sf_dir):
    """One chunk per document, so that the lines are those of the document."""
    return read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("seq"), "text")


@register(f"""WITH {_FACTS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS pos,
  md5(text) AS text_md5, 'line|story' AS tags FROM fact""")
def extract_facts(spark, sf_dir):
    facts = I.extract_facts(_whole(spark, sf_dir), I.split_lines, ["story", "line"])
    return facts.select("doc_id", "pos", F.md5("text").alias("text_md5"), F.array_join("tags", "|").alias("tags"))


@register("""SELECT doc_id, concat_ws('|', lang, source, CASE WHEN lang <> 'en' THEN 'en' END, 'extra') AS tags FROM documents""")
def merge_tags(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(add_tags(F.array("lang", "source"), ["en", "extra"]), "|").alias("tags"))


@register(MEM + f""", {_FACTS},
item AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos, text, {norm_sql('text')} AS normalized_text,
  row_number() OVER (ORDER BY doc_id, line_no) AS i FROM fact),
ok AS (SELECT * FROM item WHERE length(text) <= 16000),
stored AS (SELECT normalized_text, min(id) AS stored_id FROM mem WHERE user_id = 'user0' AND deleted_at IS NULL GROUP BY 1),
one AS (SELECT ok.*, stored_id, row_number() OVER (PARTITION BY ok.normalized_text ORDER BY i) AS nth FROM ok LEFT JOIN stored USING (normalized_text)),
new AS (SELECT normalized_text, (SELECT max(id) FROM mem) + row_number() OVER (ORDER BY i) AS id FROM one WHERE nth = 1 AND stored_id IS NULL)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, coalesce(stored_id, new.id) AS memory_id, NOT (nth = 1 AND stored_id IS NULL) AS already_existed
FROM one LEFT JOIN new USING (normalized_text)
UNION ALL SELECT doc_id, CAST(pos AS INTEGER), NULL, NULL FROM item WHERE length(text) > 16000""")
def load_facts(spark, sf_dir):
    """Facts of all documents loaded for one user. Vectors of different texts are unrelated, so only equal texts clash."""
    facts = I.extract(_whole(spark, sf_dir), I.split_lines).facts
    done = I.load_facts(stored_memories(spark, sf_dir), facts, AS_OF, MockEmbedding(64), user_id="user0")
    return done.results.select("doc_id", "pos", "memory_id", "already_existed")


@register(MEM + f""", item AS (SELECT conv_id, turn, {trim_sql('text')} AS text, {norm_sql('text')} AS normalized_text FROM conversations),
first AS (SELECT normalized_text FROM item GROUP BY 1),
stored AS (SELECT DISTINCT normalized_text FROM mem WHERE user_id = 'user1' AND deleted_at IS NULL)
SELECT md5(normalized_text) AS key_md5 FROM first WHERE normalized_text NOT IN (SELECT normalized_text FROM stored)""")
def remember_stream(spark, sf_dir):
    """Conversation turns arriving as a stream, two files at a time; what ends up in the table on top of the base."""
    root = scratch_path(spark, "stream")
    base = memories(spark, sf_dir).drop("embedding")
    # Vectors of 32 repeated digest bytes, as the items get.
    save_memories(embed_column(base, MockEmbedding(64)).drop("embed_error"), f"{root}/base")
    turns = read(spark, sf_dir, "conversations").withColumn(
        "input_index", F.col("conv_id") * 1000 + F.col("turn"))
    turns.select("input_index", "text").repartitionByRange(4, "input_index").write.parquet(f"{root}/arriving")
    items = spark.readStream.schema("input_index long, text string").option("maxFilesPerTrigger", 2).parquet(f"{root}/arriving")
    J.remember_stream(items, root, MockEmbedding(64), AS_OF, user_id="user1").awaitTermination()
    n = base.agg(F.max("id").alias("n")).scalar()
    return J.stream_table(spark, root).filter(F.col("id") > n).select(F.md5("normalized_text").alias("key_md5"))
