"""Registered queries: recall, near duplicates, prompts, chunks, closest matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import chunks as K
from factloom.operators import closest, neardup
from factloom.operators import search as Q
from factloom.plans.fixture import ACTIVE_SQL, AS_OF, MEM, cosine_sql, memories, stored_memories
from factloom.plans.registry import read, register


def _vector(spark, sf_dir, label):
    """One query vector: the first one with a label."""
    return (read(spark, sf_dir, "embeddings").filter(F.col("label") == label).orderBy("vec_id").first().embedding)


def _vector_sql(label):
    return ("(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = "
            f"(SELECT min(vec_id) FROM embeddings WHERE label = {label}))")


@register(MEM + f"""SELECT id, round(s, 4) AS score, source_provider FROM (
  SELECT id, source_provider, {cosine_sql('emb', _vector_sql(3))} AS s FROM mem
  WHERE user_id = 'user0' AND {ACTIVE_SQL} AND list_has_any(tags, ['en', 'fr']) ORDER BY s DESC, id LIMIT 12)
WHERE s >= 0.05""")
def recall(spark, sf_dir):
    hits = Q.recall(memories(spark, sf_dir), _vector(spark, sf_dir, 3), "user0", AS_OF, limit=12, min_score=0.05,
                    tags=["EN", "fr"])
    return hits.select("id", F.round("score", 4).alias("score"), "source_provider")


_ASKED = "asked AS (SELECT vec_id AS query_id, 'user' || (label % 3) AS user_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings)"


@register(MEM + f""", {_ASKED},
hits AS (SELECT query_id, id, {cosine_sql('emb', 'qv')} AS s FROM asked JOIN mem USING (user_id) WHERE {ACTIVE_SQL})
SELECT query_id, id, round(s, 4) AS score, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM hits) WHERE r <= 8""")
def recall_batch(spark, sf_dir):
    emb = read(spark, sf_dir, "embeddings")
    asked = emb.select(F.col("vec_id").alias("query_id"),
                       F.concat(F.lit("user"), (F.col("label") % 3).cast("string")).alias("user_id"), "embedding")
    hits = Q.recall_batch(memories(spark, sf_dir), asked, AS_OF)
    return hits.select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@register(MEM + f""", {_ASKED},
hits AS (SELECT query_id, id, {cosine_sql('emb', 'qv')} AS s FROM asked JOIN mem USING (user_id)
  WHERE {ACTIVE_SQL} AND (query_id % 2 = 0 OR list_has_any(tags, ['de', 'src2']))),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM hits)
SELECT query_id, id, round(s, 4) AS score, CAST(r AS INTEGER) AS rank FROM top WHERE r <= 5 AND s >= 0.2""")
def search_memory(spark, sf_dir):
    """Recall under its other name: with tags on some queries and a least score."""
    emb = read(spark, sf_dir, "embeddings")
    none = F.array().cast("array<string>")
    asked = emb.select(F.col("vec_id").alias("query_id"),
                       F.concat(F.lit("user"), (F.col("label") % 3).cast("string")).alias("user_id"), "embedding",
                       F.lit(0.2).alias("min_score"),
                       F.when(F.col("vec_id") % 2 == 0, none).otherwise(F.array(F.lit("DE"), F.lit("src2"))).alias("tags"))
    hits = Q.recall_batch(memories(spark, sf_dir), asked, AS_OF, limit=5)
    return hits.select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@register(MEM + f"""SELECT id, round({cosine_sql('emb', _vector_sql(5))}, 4) AS score FROM mem
WHERE user_id = 'user1' AND deleted_at IS NOT NULL ORDER BY {cosine_sql('emb', _vector_sql(5))} DESC, id LIMIT 8""")
def recall_tombstones(spark, sf_dir):
    hits = Q.recall_tombstones(memories(spark, sf_dir), _vector(spark, sf_dir, 5), "user1")
    return hits.select("id", F.round("score", 4).alias("score"))


_ITEMS = """item AS (SELECT vec_id AS input_index, 'user' || (vec_id % 3) AS user_id, CAST(embedding AS DOUBLE[]) AS qv,
  CASE label % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'ask' ELSE 'skip_if_near' END AS dedup_policy FROM embeddings)"""


def _items(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("input_index"), F.concat(F.lit("user"), (F.col("vec_id") % 3).cast("string")).alias("user_id"),
        "embedding", F.when(F.col("label") % 3 == 0, "insert").when(F.col("label") % 3 == 1, "ask")
        .otherwise("skip_if_near").alias("dedup_policy"))


def _hints_sql(rows):
    return MEM + f""", {_ITEMS},
hits AS (SELECT input_index, id, {cosine_sql('emb', 'qv')} AS s FROM item JOIN mem USING (user_id)
  WHERE dedup_policy <> 'insert' AND {rows})
SELECT input_index, id, round(s, 4) AS score, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY input_index ORDER BY s DESC, id) AS r FROM hits) WHERE r <= 5 AND s >= 0.9"""


@register(_hints_sql(ACTIVE_SQL))
def dedup_candidates(spark, sf_dir):
    hits = Q.dedup_candidates(memories(spark, sf_dir), _items(spark, sf_dir), AS_OF)
    return hits.select("input_index", "id", F.round("score", 4).alias("score"), "rank")


@register(_hints_sql("deleted_at IS NOT NULL"))
def previously_corrected(spark, sf_dir):
    hits = Q.previously_corrected(memories(spark, sf_dir), _items(spark, sf_dir))
    return hits.select("input_index", "id", F.round("score", 4).alias("score"), "rank")


def _pairs_sql(threshold):
    return MEM + f""", act AS (SELECT id, user_id, emb FROM mem WHERE {ACTIVE_SQL}),
near AS (SELECT a.user_id, a.id AS a, b.id AS b, {cosine_sql('a.emb', 'b.emb')} AS s
  FROM act a JOIN act b ON a.user_id = b.user_id AND a.id <> b.id),
top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM near),
pairs AS (SELECT DISTINCT user_id, least(a, b) AS id_a, greatest(a, b) AS id_b, s FROM top WHERE r <= 10 AND s >= {threshold})"""


@register(_pairs_sql(0.8) + " SELECT user_id, id_a, id_b, round(s, 4) AS similarity FROM pairs")
def near_duplicate_pairs(spark, sf_dir):
    pairs = neardup.near_duplicate_pairs(memories(spark, sf_dir), AS_OF, 0.8)
    return pairs.select("user_id", "id_a", "id_b", F.round("similarity", 4).alias("similarity"))


@register(_pairs_sql(0.92).replace("WITH nv", "WITH RECURSIVE nv", 1) + """,
link AS (SELECT id_a AS x, id_b AS y FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach AS (SELECT x AS id, x AS label FROM link UNION SELECT link.y, reach.label FROM reach JOIN link ON link.x = reach.id),
label AS (SELECT id, min(label) AS label FROM reach GROUP BY id),
grp AS (SELECT label AS cluster_id, max(s) AS max_similarity, count(*) AS pair_count
  FROM pairs JOIN label ON label.id = id_a GROUP BY label),
kept AS (SELECT *, row_number() OVER (ORDER BY max_similarity DESC, cluster_id) AS r FROM grp)
SELECT cluster_id, CAST(r AS INTEGER) AS rank, round(max_similarity, 4) AS max_similarity, pair_count,
  (SELECT count(*) FROM pairs) AS total_pairs, label.id FROM kept JOIN label ON label.label = cluster_id WHERE r <= 50""")
def near_duplicate_clusters(spark, sf_dir):
    c = neardup.near_duplicate_clusters(stored_memories(spark, sf_dir), AS_OF)
    return c.select("cluster_id", "rank", F.round("max_similarity", 4).alias("max_similarity"), "pair_count",
                    "total_pairs", "id")


@register(MEM + f""", turn_of AS MATERIALIZED (
  SELECT conv_id * 1000 + turn AS query_id, 'user' || (conv_id % 3) AS user_id, text AS user_prompt,
    CASE WHEN turn % 3 = 0 THEN 1500 WHEN turn % 3 = 1 THEN 300 END AS max_chars, (conv_id * 7 + turn) % n AS vec_id FROM conversations, nv),
asked AS MATERIALIZED (SELECT turn_of.*, CAST(embedding AS DOUBLE[]) AS qv FROM turn_of JOIN embeddings USING (vec_id)),
pool AS MATERIALIZED (SELECT id, user_id, emb FROM mem WHERE {ACTIVE_SQL}),
hits AS MATERIALIZED (SELECT query_id, id, {cosine_sql('emb', 'qv')} AS s FROM asked JOIN pool USING (user_id)),
ranked AS MATERIALIZED (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM hits QUALIFY r <= 8),
run AS (SELECT query_id, r, text, sum(length(text)) OVER (PARTITION BY query_id ORDER BY r) AS used FROM ranked JOIN mem USING (id)),
kept AS (SELECT query_id, string_agg(run.text || chr(10) || chr(10), '' ORDER BY r) AS body FROM run JOIN asked USING (query_id)
  WHERE max_chars IS NULL OR used <= max_chars GROUP BY query_id)
SELECT query_id, md5('The following are previously known facts:' || chr(10) || chr(10)
  || coalesce(body, 'No relevant previously known facts were found.' || chr(10) || chr(10))
  || '-----------------' || chr(10) || chr(10) || 'The following is the user''s prompt:' || chr(10) || chr(10)
  || user_prompt) AS prompt_md5 FROM asked LEFT JOIN kept USING (query_id)""")
def build_context_prompt(spark, sf_dir):
    emb = read(spark, sf_dir, "embeddings")
    n = emb.agg(F.count(F.lit(1)).alias("n")).scalar()
    turns = read(spark, sf_dir, "conversations").withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % n)
    prompts = turns.join(emb, "vec_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.concat(F.lit("user"), (F.col("conv_id") % 3).cast("string")).alias("user_id"),
        F.col("text").alias("user_prompt"), "embedding",
        F.when(F.col("turn") % 3 == 0, 1500).when(F.col("turn") % 3 == 1, 300).alias("max_chars"))
    out = Q.build_context_prompt(memories(spark, sf_dir), prompts, AS_OF)
    return out.select("query_id", F.md5("prompt").alias("prompt_md5"))


# ---- chunk table --------------------------------------------------------------------------

def _chunks(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("d"), F.floor(F.col("id") / 3).cast("string")).alias("document_id"),
        (F.col("id") % 3).cast("int").alias("sequence_number"), "text", "embedding",
        F.create_map(F.lit("user"), F.col("user_id")).alias("extra"))


_CHUNKS = MEM + """, chunk AS (SELECT 'c' || id AS chunk_id, 'd' || (id // 3) AS document_id,
  CAST(id % 3 AS INTEGER) AS sequence_number, text, emb, user_id AS owner FROM mem)"""


@register(_CHUNKS + """, point AS (SELECT 'c' || (doc_id * 2) AS chunk_id, 'd' || doc_id AS document_id,
  CAST(quality AS INTEGER) AS sequence_number, 'label ' || toxic AS text FROM labels)
SELECT chunk_id, document_id, sequence_number, md5(text) AS text_md5 FROM chunk
  WHERE chunk_id NOT IN (SELECT chunk_id FROM point)
UNION ALL SELECT chunk_id, document_id, sequence_number, md5(text) FROM point""")
def upsert_chunks(spark, sf_dir):
    points = read(spark, sf_dir, "labels").select(
        F.concat(F.lit("c"), (F.col("doc_id") * 2).cast("string")).alias("chunk_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"),
        F.col("quality").alias("sequence_number"),
        F.concat(F.lit("label "), F.col("toxic").cast("string")).alias("text"),
        F.array(F.lit(1.0)).cast("array<float>").alias("embedding"),
        F.lit(None).cast("map<string,string>").alias("extra"))
    out = K.upsert_chunks(_chunks(spark, sf_dir), points)
    return out.select("chunk_id", "document_id", "sequence_number", F.md5("text").alias("text_md5"))


@register(_CHUNKS + f"""SELECT chunk_id, document_id, sequence_number, md5(text) AS text_md5,
  round({cosine_sql('emb', _vector_sql(4))}, 4) AS score FROM chunk WHERE owner = 'user2'
ORDER BY {cosine_sql('emb', _vector_sql(4))} DESC, document_id, chunk.sequence_number, chunk_id LIMIT 30""")
def search_chunks(spark, sf_dir):
    hits = K.search_chunks(_chunks(spark, sf_dir), _vector(spark, sf_dir, 4), 30, F.col("extra")["user"] == "user2")
    return hits.select("chunk_id", "document_id", "sequence_number", F.md5("text").alias("text_md5"),
                       F.round("score", 4).alias("score"))


@register(_CHUNKS + "SELECT chunk_id, document_id, sequence_number, md5(text) AS text_md5 FROM chunk WHERE chunk_id = 'c17'")
def get_chunk(spark, sf_dir):
    return K.get_chunk(_chunks(spark, sf_dir), "c17").select(
        "chunk_id", "document_id", "sequence_number", F.md5("text").alias("text_md5"))


@register(_CHUNKS + """SELECT chunk_id, document_id, sequence_number FROM chunk
WHERE chunk_id NOT IN (SELECT 'c' || doc_id FROM labels WHERE quality = 0)""")
def delete_chunks(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").filter("quality = 0").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"))
    return K.delete_chunks(_chunks(spark, sf_dir), ids).select("chunk_id", "document_id", "sequence_number")


# Jaro-Winkler step by step: each character of the shorter text takes the first free equal one near it.
@register("""WITH RECURSIVE raw AS (SELECT c_custkey, n_name, CAST(c_custkey % length(n_name) + 1 AS INTEGER) AS pos
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
typed AS (SELECT c_custkey, lower(substr(n_name, 1, pos - 1) || ' ' || substr(n_name, pos + 1)) AS typed FROM raw),
form AS (SELECT DISTINCT regexp_replace(typed, '[ \t\n\x0B\f\r]', '', 'g') AS f FROM typed),
pair AS (SELECT f, n_nationkey AS o, n_name AS m, lower(n_name) AS c, CASE WHEN length(f) <= length(n_name) THEN f ELSE lower(n_name) END AS s,
  CASE WHEN length(f) <= length(n_name) THEN lower(n_name) ELSE f END AS l FROM form, nation),
step AS (SELECT f, o, s, l, greatest(length(l) // 2 - 1, 0) AS w, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, '' AS ms FROM pair
  UNION ALL SELECT f, o, s, l, w, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END,
    CASE WHEN j IS NULL THEN ms ELSE ms || substr(s, i + 1, 1) END
  FROM (SELECT *, list_min(list_filter(range(greatest(i - w, 0), least(i + w + 1, length(l))),
    lambda x: substr(l, x + 1, 1) = substr(s, i + 1, 1) AND NOT list_contains(used, x))) AS j FROM step WHERE i < length(s))),
done AS (SELECT f, o, s, l, ms, CAST(length(ms) AS FLOAT) AS m, array_to_string(list_transform(list_sort(used), lambda x: substr(l, x + 1, 1)), '') AS ml
  FROM step WHERE i = length(s)),
jaro AS (SELECT *, len(list_filter(range(length(ms)), lambda x: substr(ms, x + 1, 1) <> substr(ml, x + 1, 1))) // 2 AS swaps,
  len(list_filter(range(1, length(s) + 1), lambda x: substr(s, 1, x) = substr(l, 1, x))) AS prefix FROM done),
base AS (SELECT *, CASE WHEN s = l THEN 1 WHEN m = 0 THEN 0 ELSE (m / length(s) + m / length(l) + (m - swaps) / m) / 3 END AS j FROM jaro),
score AS (SELECT f, o, CASE WHEN j < 0.7 OR s = l THEN j ELSE j + least(0.1, 1.0 / length(l)) * prefix * (1 - j) END AS sim FROM base),
best AS (SELECT f, o, sim, row_number() OVER (PARTITION BY f ORDER BY round(sim, 5) DESC, o) AS r FROM score)
SELECT c_custkey, typed, n_name AS match, CAST(round(sim, 4) AS DOUBLE) AS similarity FROM typed
JOIN best ON f = replace(typed, ' ', '') AND r = 1 JOIN nation ON n_nationkey = o""")
def closest_match_join(spark, sf_dir):
    """Nation names with one character missing, matched back to the nations."""
    nation = read(spark, sf_dir, "nation")
    typed = (read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .withColumn("at", (F.col("c_custkey") % F.char_length("n_name") + 1).cast("int"))
             .select("c_custkey", "n_name", F.lower(F.concat(
                 F.substring("n_name", F.lit(1), F.col("at") - 1), F.lit(" "),
                 F.substring("n_name", F.col("at") + 1, F.lit(100)))).alias("typed")))
    found = closest.closest_match_join(typed, nation, "typed", "n_name", "n_nationkey")
    return found.select("c_custkey", "typed", "match", F.round("similarity", 4).alias("similarity"))
