"""The memories table that the registered queries run on, derived from `documents` and `embeddings`."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions.text import normalize_text
from factloom.plans.registry import read
from factloom.session import scratch_path
from factloom.sources.tables import load_memories, save_memories

AS_OF = datetime(2024, 6, 1)
AS_OF_SQL = "TIMESTAMP '2024-06-01'"
ACTIVE_SQL = f"deleted_at IS NULL AND (expires_at IS NULL OR expires_at > {AS_OF_SQL})"
STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(name: str) -> Column:
    """A timestamp as text, so that both engines show it alike."""
    return F.date_format(name, STAMP).alias(name)


def stamp_sql(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


def joined(name: str) -> Column:
    """A string array as one text."""
    return F.array_join(name, "|").alias(name)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document. Vectors repeat and blend those of `embeddings`, so near duplicates occur."""
    docs, emb = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    n_vec = emb.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_doc = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    # At least two rows for every vector: where documents are too few, they are taken again with the next ids.
    n_rows = F.greatest(n_doc, 2 * n_vec)
    again = F.explode(F.sequence(F.lit(0), F.floor((n_rows - 1) / n_doc)))
    d = docs.select("text", "lang", "source", "doc_id", again.alias("k")).withColumn("doc_id", F.col("doc_id") + F.col("k") * n_doc)
    d = d.filter(F.col("doc_id") < n_rows).withColumn("n", n_vec)
    d = d.withColumn("v0", F.col("doc_id") % F.col("n"))
    # A vector and the next one meet first, so the texts are shuffled once.
    e0 = emb.select(F.col("vec_id").alias("v0"), F.col("embedding").alias("e0"), ((F.col("vec_id") + 1) % n_vec).alias("v1"))
    e1 = emb.select(F.col("vec_id").alias("v1"), F.col("embedding").alias("e1"))
    pairs = e0.join(e1, "v1").drop("v1")
    i = F.col("doc_id")
    w0 = F.when(i % 2 == 0, 0.8).otherwise(0.6)
    w1 = F.when(i % 2 == 0, 0.2).otherwise(0.4)
    blend = F.zip_with("e0", "e1", lambda a, b: (w0 * a.cast("double") + w1 * b.cast("double")).cast("float"))
    created = F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=i.cast("int"))
    confirmed = F.lit("2024-02-01").cast("timestamp") + F.make_interval(mins=i.cast("int"))
    no_tags = F.array().cast("array<string>")
    rows = d.join(pairs, "v0").select(
        (i + 1).alias("id"),
        F.concat(F.lit("user"), (F.col("v0") % 3).cast("string")).alias("user_id"),
        "text", normalize_text(F.col("text")).alias("normalized_text"),
        F.when(i < F.col("n"), F.col("e0")).otherwise(blend).alias("embedding"),
        F.when(i % 5 == 0, no_tags).otherwise(F.array("lang", "source")).alias("tags"),
        (i % 11 / 10.0).cast("double").alias("importance"),
        F.when(i % 4 == 1, "claude").when(i % 4 == 2, "openai").when(i % 4 == 3, "gemini").alias("source_provider"),
        F.lit("mock").alias("embedding_provider"),
        F.when(i % 6 == 0, "old").otherwise("m1").alias("embedding_model"),
        created.alias("created_at"),
        F.when(i % 13 == 0, F.lit("2024-03-01").cast("timestamp")).alias("deleted_at"),
        F.when(i % 7 == 0, F.lit("2024-05-01").cast("timestamp"))
        .when(i % 7 == 1, F.lit("2024-12-01").cast("timestamp")).alias("expires_at"),
        F.when(i % 3 != 0, confirmed).alias("last_confirmed_at"))
    return S.as_memories(rows)


def stored_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table written to the shared folder and read back, for jobs that read it several times."""
    path = scratch_path(spark, "memories")
    save_memories(memories(spark, sf_dir), path)
    return load_memories(spark, path)


TRIM_SQL = r"regexp_replace({0}, '^[\x01-\x20]+|[\x01-\x20]+$', '', 'g')"


def trim_sql(x: str) -> str:
    return TRIM_SQL.format(x)


def norm_sql(x: str) -> str:
    return rf"lower(regexp_replace({trim_sql(x)}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def cosine_sql(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}, {b}), 9)"


# The same table in SQL; `emb` is the vector in double precision.
MEM = f"""WITH nv AS (
  SELECT (SELECT count(*) FROM embeddings) AS n, (SELECT count(*) FROM documents) AS n_doc),
rows AS (
  SELECT d.doc_id + k * n_doc AS doc_id, d.text, d.lang, d.source, n
  FROM documents d, (SELECT n, n_doc, unnest(range((greatest(n_doc, 2 * n) - 1) // n_doc + 1)) AS k FROM nv)
  WHERE d.doc_id + k * n_doc < greatest(n_doc, 2 * n)),
base AS (
  SELECT doc_id, text, lang, source, n, CAST(doc_id % n AS BIGINT) AS v0, CAST((doc_id + 1) % n AS BIGINT) AS v1 FROM rows),
vec AS (
  SELECT b.*, CASE WHEN b.doc_id < b.n THEN e0.embedding
    ELSE list_transform(list_zip(e0.embedding, e1.embedding), lambda x: CAST(
      CAST(CASE WHEN b.doc_id % 2 = 0 THEN 0.8 ELSE 0.6 END AS DOUBLE) * CAST(x[1] AS DOUBLE)
      + CAST(CASE WHEN b.doc_id % 2 = 0 THEN 0.2 ELSE 0.4 END AS DOUBLE) * CAST(x[2] AS DOUBLE) AS FLOAT)) END AS embedding
  FROM base b JOIN embeddings e0 ON e0.vec_id = b.v0 JOIN embeddings e1 ON e1.vec_id = b.v1),
mem AS (
  SELECT doc_id + 1 AS id, 'user' || CAST(v0 % 3 AS VARCHAR) AS user_id, text, {norm_sql('text')} AS normalized_text,
    CAST(embedding AS DOUBLE[]) AS emb,
    CASE WHEN doc_id % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lang, source] END AS tags,
    CAST((doc_id % 11) / 10.0 AS DOUBLE) AS importance,
    CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'claude' WHEN 2 THEN 'openai' ELSE 'gemini' END AS source_provider,
    'mock' AS embedding_provider,
    CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE 'm1' END AS embedding_model,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at,
    CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-03-01' END AS deleted_at,
    CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-05-01' WHEN doc_id % 7 = 1 THEN TIMESTAMP '2024-12-01' END AS expires_at,
    CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-02-01' + to_minutes(doc_id) END AS last_confirmed_at,
    '{{}}' AS metadata, 1 AS record_version, CAST(NULL AS VARCHAR) AS forget_reason, CAST(NULL AS BIGINT) AS replaced_by_id
  FROM vec)
"""
