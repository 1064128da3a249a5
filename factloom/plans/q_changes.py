"""Registered queries: jobs that change the table."""

from __future__ import annotations

import contextlib

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.operators import changes as E
from factloom.operators import maintain, prepare, remember, reports
from factloom.operators.prepare import MockEmbedding
from factloom.plans.fixture import (ACTIVE_SQL, AS_OF, AS_OF_SQL, MEM, cosine_sql, joined, memories, norm_sql, stamp,
                                    stamp_sql, stored_memories, trim_sql)
from factloom.plans.registry import read, register
from factloom.session import scratch_path
from factloom.sources import changelog
from factloom.sources.tables import load_snapshot, save_snapshot

# ---- remember -----------------------------------------------------------------------------

# Items: every document again, some for users who have no rows yet, some with a changed text.
_USER = "CASE WHEN source IN ('src0', 'src1', 'src2') THEN user_id ELSE 'new' || (id % 2) END"
_TEXT = "CASE WHEN lang = 'en' THEN ' ' || replace(text, ' ', '  ') ELSE text || ' (again)' END"
_POLICY = "CASE id % 3 WHEN 0 THEN 'ask' WHEN 1 THEN 'skip_if_near' ELSE 'insert' END"

_WALK = MEM.replace("WITH nv", "WITH RECURSIVE nv", 1) + f""", src AS MATERIALIZED (
  SELECT mem.*, lang, source FROM mem JOIN documents ON doc_id + 1 = id),
item AS MATERIALIZED (SELECT id - 1 AS i, {_USER} AS user_id, {trim_sql(_TEXT)} AS text, {norm_sql(_TEXT)} AS normalized_text, emb,
  {{policy}} AS policy, expires_at IS NULL OR expires_at > {AS_OF_SQL} AS fresh FROM src),
ok AS MATERIALIZED (SELECT * FROM item WHERE text <> '' AND length(text) <= 16000),
stored AS MATERIALIZED (SELECT i, min(m.id) AS stored_id FROM ok JOIN mem m USING (user_id, normalized_text)
  WHERE m.deleted_at IS NULL GROUP BY i),
mnear AS MATERIALIZED (SELECT i, m.id, {cosine_sql('ok.emb', 'm.emb')} AS s FROM ok JOIN mem m USING (user_id)
  WHERE {ACTIVE_SQL} AND policy <> 'insert' AND i NOT IN (SELECT i FROM stored) AND s >= 0.9),
conf AS MATERIALIZED (SELECT a.i, list(b.i) AS l FROM ok a JOIN ok b ON a.user_id = b.user_id AND b.i < a.i AND (
    a.normalized_text = b.normalized_text
    OR (a.policy = 'skip_if_near' AND b.fresh AND {cosine_sql('a.emb', 'b.emb')} >= 0.9)) GROUP BY a.i),
seq AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY i) AS p, coalesce(l, CAST([] AS BIGINT[])) AS l,
    i IN (SELECT i FROM stored) OR (policy = 'skip_if_near' AND i IN (SELECT i FROM mnear)) AS blocked
  FROM ok LEFT JOIN conf USING (i)),
walk AS (SELECT CAST(0 AS BIGINT) AS p, CAST([] AS BIGINT[]) AS ins UNION ALL
  SELECT seq.p, CASE WHEN blocked OR list_has_any(l, ins) THEN ins ELSE list_append(ins, i) END
  FROM walk JOIN seq ON seq.p = walk.p + 1),
won AS MATERIALIZED (SELECT unnest(ins) AS i FROM (SELECT ins FROM walk ORDER BY p DESC LIMIT 1)),
new AS MATERIALIZED (SELECT ok.*, (SELECT max(id) FROM mem) + row_number() OVER (ORDER BY i) AS id FROM ok WHERE i IN (SELECT i FROM won)),
same AS MATERIALIZED (SELECT ok.i, coalesce(any_value(stored_id), min(new.id)) AS same_id FROM ok LEFT JOIN stored USING (i)
  LEFT JOIN new ON new.user_id = ok.user_id AND new.normalized_text = ok.normalized_text AND new.i < ok.i GROUP BY ok.i),
near AS MATERIALIZED (SELECT i, id, s FROM mnear UNION ALL
  SELECT ok.i, new.id, {cosine_sql('ok.emb', 'new.emb')} AS s FROM ok JOIN new ON new.user_id = ok.user_id AND new.i < ok.i
  WHERE new.fresh AND ok.policy <> 'insert' AND s >= 0.9),
top AS MATERIALIZED (SELECT i, first(id ORDER BY s DESC, id) AS top_id, least(count(*), 5) AS n,
    sum(id) FILTER (WHERE r <= 5) AS id_sum FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, id) AS r FROM near) GROUP BY i),
result AS (SELECT item.i AS input_index, ok.i IS NOT NULL AS ok,
  CASE WHEN ok.i IS NULL THEN NULL ELSE coalesce(same_id, new.id, top_id) END AS memory_id,
  CASE WHEN ok.i IS NOT NULL THEN new.id IS NULL END AS already_existed,
  CASE WHEN ok.i IS NULL THEN NULL WHEN new.id IS NOT NULL THEN 'Ok' WHEN same_id IS NOT NULL THEN 'Already remembered'
    ELSE 'Near-duplicate skipped' END AS message,
  CAST(CASE WHEN ok.i IS NULL THEN -1 WHEN same_id IS NOT NULL THEN 0 ELSE coalesce(top.n, 0) END AS INTEGER) AS n_candidates,
  CAST(CASE WHEN same_id IS NULL THEN id_sum END AS BIGINT) AS candidate_id_sum,
  CASE WHEN ok.i IS NULL THEN 'INVALID_INPUT' END AS error_code
  FROM item LEFT JOIN ok USING (i) LEFT JOIN same USING (i) LEFT JOIN new ON new.i = item.i LEFT JOIN top ON top.i = item.i)
"""


def _items(spark, sf_dir, policy, table):
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), "lang", "source")
    src = table.join(docs, "id")
    return src.select(
        (F.col("id") - 1).alias("input_index"), F.expr(_USER).alias("user_id"), F.expr(_TEXT).alias("text"),
        "embedding", "tags", "expires_at", F.expr(policy).alias("dedup_policy"))


def _remembered(spark, sf_dir, policy, **options):
    table = stored_memories(spark, sf_dir)
    return remember.remember_batch(table, _items(spark, sf_dir, policy, table), AS_OF, **options)


@register(_WALK.replace("{policy}", _POLICY) + "SELECT * FROM result")
def remember_batch(spark, sf_dir):
    r = _remembered(spark, sf_dir, _POLICY).results
    hits = F.when(F.size("candidates") > 0, F.aggregate("candidates", F.lit(0).cast("long"), lambda a, c: a + c["id"]))
    return r.select("input_index", "ok", "memory_id", "already_existed", "message",
                    F.coalesce(F.size("candidates"), F.lit(-1)).alias("n_candidates"),
                    hits.alias("candidate_id_sum"), "error_code")


@register(_WALK.replace("{policy}", "'skip_if_near'") + """SELECT id, i AS input_index, user_id, md5(text) AS text_md5,
  md5(normalized_text) AS key_md5 FROM new""")
def remember_batch_skip_near(spark, sf_dir):
    """The inserted rows when every item is skipped if near."""
    done = _remembered(spark, sf_dir, "'skip_if_near'")
    owner = done.results.filter("ok and not already_existed").select(F.col("memory_id").alias("id"), "input_index")
    return done.inserted.join(owner, "id", "left").select(
        "id", "input_index", "user_id", F.md5("text").alias("text_md5"), F.md5("normalized_text").alias("key_md5"))


@register(_WALK.replace("{policy}", _POLICY) + """SELECT count(*) AS total, count(*) FILTER (WHERE ok AND NOT already_existed) AS inserted,
  count(*) FILTER (WHERE ok AND already_existed) AS duplicates, count(*) FILTER (WHERE NOT ok) AS errors FROM result""")
def remember_summary(spark, sf_dir):
    return reports.remember_summary(_remembered(spark, sf_dir, _POLICY).results)


@register(MEM + f""", item AS (SELECT text FROM conversations ORDER BY conv_id, turn LIMIT 1),
hit AS (SELECT min(id) AS id FROM mem, item WHERE user_id = 'user0' AND deleted_at IS NULL AND normalized_text = {norm_sql('item.text')})
SELECT coalesce(hit.id, (SELECT max(id) + 1 FROM mem)) AS memory_id, hit.id IS NOT NULL AS already_existed FROM hit""")
def remember_one(spark, sf_dir):
    """The first turn of the conversations, remembered on its own."""
    text = read(spark, sf_dir, "conversations").orderBy("conv_id", "turn").first().text
    done = remember.remember(stored_memories(spark, sf_dir), AS_OF, prepare.MockEmbedding(64), text, user_id="user0")
    return done.results.select("memory_id", "already_existed")


# ---- update -------------------------------------------------------------------------------

# One or two items for every labelled document: a text for the toxic ones, importance and tags for others.
_UPDATES = """upd AS (
  SELECT doc_id * 2 AS input_index, doc_id + CASE WHEN quality = 1 THEN 1 ELSE 2000000 END AS id,
    CASE WHEN toxic = 1 THEN 'Replaced ' || (doc_id % 7) END AS text,
    CASE WHEN toxic = 0 THEN quality / 2.0 END AS importance, CAST(NULL AS VARCHAR) AS tag FROM labels
  UNION ALL SELECT doc_id * 2 + 1, doc_id + 1, NULL, CASE WHEN quality = 1 THEN 0.9 END,
    CASE WHEN toxic = 1 THEN ' Books' END FROM labels)"""

_UPDATED = MEM + f""", {_UPDATES},
chk AS (SELECT upd.*, user_id, CASE WHEN upd.text IS NULL AND upd.importance IS NULL AND tag IS NULL THEN 'INVALID_INPUT'
    WHEN mem.id IS NULL OR deleted_at IS NOT NULL THEN 'NOT_FOUND' END AS err
  FROM upd LEFT JOIN mem USING (id)),
claim AS (SELECT *, lower(text) AS normalized_text, first_value(id) OVER (PARTITION BY user_id, text ORDER BY input_index) AS first_id
  FROM chk WHERE err IS NULL AND text IS NOT NULL),
refused AS (SELECT input_index FROM claim WHERE first_id <> id OR EXISTS (SELECT 1 FROM mem WHERE deleted_at IS NULL
  AND mem.user_id = claim.user_id AND mem.normalized_text = claim.normalized_text AND mem.id <> claim.id)),
fin AS (SELECT chk.* REPLACE (CASE WHEN err IS NULL AND input_index IN (SELECT input_index FROM refused)
  THEN 'DATABASE_ERROR' ELSE err END AS err) FROM chk)"""


def _updates(spark, sf_dir):
    lab = read(spark, sf_dir, "labels")
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    none = F.lit(None).cast("array<string>")
    a = lab.select((F.col("doc_id") * 2).alias("input_index"),
                   (F.col("doc_id") + F.when(good, 1).otherwise(2000000)).alias("id"),
                   F.when(toxic, F.concat(F.lit("Replaced "), (F.col("doc_id") % 7).cast("string"))).alias("text"),
                   F.when(~toxic, F.col("quality") / 2.0).alias("importance"), none.alias("tags"))
    b = lab.select((F.col("doc_id") * 2 + 1).alias("input_index"), (F.col("doc_id") + 1).alias("id"),
                   F.lit(None).cast("string").alias("text"), F.when(good, 0.9).alias("importance"),
                   F.when(toxic, F.array(F.lit(" Books"))).alias("tags"))
    return a.unionByName(b)


def _updated(spark, sf_dir, dry_run=False):
    return E.update_memory_batch(stored_memories(spark, sf_dir), _updates(spark, sf_dir), AS_OF, prepare.MockEmbedding(64), dry_run)


@register(_UPDATED + f""", last AS (SELECT id, last(text ORDER BY input_index) FILTER (WHERE text IS NOT NULL) AS text,
    last(importance ORDER BY input_index) FILTER (WHERE importance IS NOT NULL) AS importance,
    last(tag ORDER BY input_index) FILTER (WHERE tag IS NOT NULL) AS tag FROM fin WHERE err IS NULL GROUP BY id)
SELECT mem.id, md5(coalesce(last.text, mem.text)) AS text_md5, md5(coalesce(lower(last.text), mem.normalized_text)) AS key_md5,
  CAST(coalesce(last.importance, mem.importance) AS DOUBLE) AS importance,
  CASE WHEN last.tag IS NOT NULL THEN 'publishing' ELSE array_to_string(tags, '|') END AS tags,
  CASE WHEN last.text IS NOT NULL THEN 'mock-sha256' ELSE embedding_model END AS embedding_model,
  strftime(CASE WHEN last.id IS NOT NULL THEN {AS_OF_SQL} ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM mem LEFT JOIN last USING (id)""")
def update_memory_batch(spark, sf_dir):
    m = _updated(spark, sf_dir).memories
    return m.select("id", F.md5("text").alias("text_md5"), F.md5("normalized_text").alias("key_md5"), "importance",
                    joined("tags"), "embedding_model", stamp("updated_at"))


@register(_UPDATED + """SELECT input_index, id, err IS NULL AS ok,
  CASE WHEN err IS NULL THEN concat_ws('|', CASE WHEN text IS NOT NULL THEN 'text' END, CASE WHEN tag IS NOT NULL THEN 'tags' END,
    CASE WHEN importance IS NOT NULL THEN 'importance' END) END AS changed_fields, err AS error_code FROM fin""")
def update_memory_results(spark, sf_dir):
    r = _updated(spark, sf_dir).results
    return r.select("input_index", "id", "ok", joined("changed_fields"), "error_code")


@register(_UPDATED + """SELECT count(*) AS total, count(*) FILTER (WHERE err IS NULL) AS updated,
  count(*) FILTER (WHERE err IS NOT NULL) AS errors FROM chk""")
def update_summary(spark, sf_dir):
    """Of a dry run, which does not see texts that clash."""
    return reports.update_summary(_updated(spark, sf_dir, dry_run=True).results)


@register(MEM + f""", one AS (SELECT min(id) AS id FROM mem WHERE deleted_at IS NULL)
SELECT mem.id, CASE WHEN mem.id = one.id THEN 'software|x' ELSE array_to_string(tags, '|') END AS tags,
  strftime(CASE WHEN mem.id = one.id THEN TIMESTAMP '2025-01-01' ELSE expires_at END, '%Y-%m-%d %H:%M:%S') AS expires_at
FROM mem, one""")
def update_memory(spark, sf_dir):
    m = stored_memories(spark, sf_dir)
    first = m.filter("deleted_at is null").agg(F.min("id").alias("id")).first().id
    done = E.update_memory(m, first, AS_OF, tags=["Code", "x"], expires_at="2025-01-01")
    return done.memories.select("id", joined("tags"), stamp("expires_at"))


# ---- confirm and forget -------------------------------------------------------------------

@register(MEM + f""", hit AS (SELECT doc_id + 1 AS id FROM labels WHERE quality = 1)
SELECT id, strftime(CASE WHEN id IN (SELECT id FROM hit) AND deleted_at IS NULL THEN {AS_OF_SQL} ELSE last_confirmed_at END,
  '%Y-%m-%d %H:%M:%S') AS last_confirmed_at FROM mem""")
def confirm(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").filter("quality = 1").select(
        F.col("doc_id").alias("input_index"), (F.col("doc_id") + 1).alias("id"))
    return E.confirm(memories(spark, sf_dir), ids, AS_OF).memories.select("id", stamp("last_confirmed_at"))


@register(MEM + f""", seen AS (SELECT doc_id + 1 AS id FROM labels WHERE quality = 1), gone AS (SELECT doc_id * 2 + 1 AS id FROM labels)
SELECT id, strftime(CASE WHEN id IN (SELECT id FROM seen) AND deleted_at IS NULL THEN {AS_OF_SQL} ELSE last_confirmed_at END,
  '%Y-%m-%d %H:%M:%S') AS last_confirmed_at, md5(text) AS text_md5 FROM mem WHERE id NOT IN (SELECT id FROM gone)""")
def changes_logged(spark, sf_dir):
    """Rows confirmed, then others deleted, in the change log beside a snapshot; read back merged."""
    root = scratch_path(spark, "logged")
    save_snapshot(memories(spark, sf_dir), root)
    seen = read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("input_index"), (F.col("doc_id") + 1).alias("id"))
    changelog.log_change(spark, root, seen, lambda rows: E.confirm(rows, seen, AS_OF).memories)
    gone = _forget_requests(spark, sf_dir).select("input_index", "id")
    changelog.log_change(spark, root, gone, lambda rows: E.forget(rows, gone, AS_OF, hard=True).memories)
    return changelog.load_merged(spark, root).memories.select("id", stamp("last_confirmed_at"), F.md5("text").alias("text_md5"))


def _forget_requests(spark, sf_dir):
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("input_index"), (F.col("doc_id") * 2 + 1).alias("id"),
        F.when(F.col("toxic") == 1, " toxic ").alias("reason"),
        F.when(F.col("quality") == 1, F.col("doc_id") * 2 + 2).alias("replaced_by_id"))


@register(MEM + f""", req AS (SELECT doc_id * 2 + 1 AS id, CASE WHEN toxic = 1 THEN 'toxic' END AS reason,
  CASE WHEN quality = 1 THEN doc_id * 2 + 2 END AS rep FROM labels)
SELECT mem.id, strftime(CASE WHEN req.id IS NOT NULL THEN coalesce(deleted_at, {AS_OF_SQL}) ELSE deleted_at END,
  '%Y-%m-%d %H:%M:%S') AS deleted_at, reason AS forget_reason, rep AS replaced_by_id FROM mem LEFT JOIN req USING (id)""")
def forget(spark, sf_dir):
    done = E.forget(memories(spark, sf_dir), _forget_requests(spark, sf_dir), AS_OF)
    return done.memories.select("id", stamp("deleted_at"), "forget_reason", "replaced_by_id")


@register(MEM + """SELECT doc_id AS input_index, doc_id * 2 + 1 AS id, mem.id IS NOT NULL AS ok,
  CASE WHEN mem.id IS NOT NULL THEN deleted_at IS NOT NULL END AS already_deleted,
  CASE WHEN mem.id IS NULL THEN 'NOT_FOUND' END AS error_code FROM labels LEFT JOIN mem ON mem.id = doc_id * 2 + 1""")
def forget_results(spark, sf_dir):
    done = E.forget(memories(spark, sf_dir), _forget_requests(spark, sf_dir), AS_OF)
    return done.results.select("input_index", "id", "ok", "already_deleted", "error_code")


@register(MEM + "SELECT id, md5(text) AS text_md5 FROM mem WHERE id NOT IN (SELECT doc_id * 2 + 1 FROM labels)")
def forget_hard(spark, sf_dir):
    requests = _forget_requests(spark, sf_dir).select("input_index", "id")
    done = E.forget(memories(spark, sf_dir), requests, AS_OF, hard=True)
    return done.memories.select("id", F.md5("text").alias("text_md5"))


_FORGET = """req AS (SELECT turn + conv_id * 1000 AS input_index, CASE WHEN turn = 5 THEN NULL ELSE conv_id * 11 % 1200 + turn // 2 END AS id
  FROM conversations)"""


def _forget_ids(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(
        (F.col("turn") + F.col("conv_id") * 1000).alias("input_index"),
        F.when(F.col("turn") != 5, F.col("conv_id") * 11 % 1200 + F.floor(F.col("turn") / 2)).alias("id"))


_FORGET_SQL = MEM + f""", {_FORGET}, out AS (
  SELECT input_index, req.id, mem.id IS NOT NULL AS ok, CASE WHEN mem.id IS NOT NULL THEN deleted_at IS NOT NULL
    OR row_number() OVER (PARTITION BY req.id ORDER BY input_index) > 1 END AS already_deleted,
  CASE WHEN req.id IS NULL THEN 'INVALID_INPUT' WHEN mem.id IS NULL THEN 'NOT_FOUND' END AS error_code
  FROM req LEFT JOIN mem ON mem.id = req.id)"""


@register(_FORGET_SQL + " SELECT * FROM out")
def forget_batch(spark, sf_dir):
    done = E.forget_batch(memories(spark, sf_dir), _forget_ids(spark, sf_dir), AS_OF, " outdated ")
    return done.results.select("input_index", "id", "ok", "already_deleted", "error_code")


@register(_FORGET_SQL + f""" SELECT id, strftime(CASE WHEN id IN (SELECT id FROM req) THEN coalesce(deleted_at, {AS_OF_SQL})
  ELSE deleted_at END, '%Y-%m-%d %H:%M:%S') AS deleted_at,
  CASE WHEN id IN (SELECT id FROM req) THEN 'outdated' END AS forget_reason FROM mem""")
def forget_batch_table(spark, sf_dir):
    done = E.forget_batch(memories(spark, sf_dir), _forget_ids(spark, sf_dir), AS_OF, " outdated ")
    return done.memories.select("id", stamp("deleted_at"), "forget_reason")


@register(_FORGET_SQL + """ SELECT count(*) AS total, count(*) FILTER (WHERE ok AND NOT already_deleted) AS deleted,
  count(*) FILTER (WHERE ok AND already_deleted) AS already_deleted, count(*) FILTER (WHERE NOT ok) AS errors FROM out""")
def forget_summary(spark, sf_dir):
    done = E.forget_batch(memories(spark, sf_dir), _forget_ids(spark, sf_dir), AS_OF, "outdated")
    return reports.forget_summary(done.results)


@register(MEM.replace("WITH nv", "WITH RECURSIVE nv", 1) + """, link AS (
  SELECT id, CASE WHEN length(text) % 4 > 0 THEN id + 1 + length(text) % 3 END AS nxt, length(text) % 4 > 0 AS gone FROM mem),
walk AS (SELECT id, nxt AS at FROM link WHERE nxt IS NOT NULL UNION ALL
  SELECT walk.id, link.nxt FROM walk JOIN link ON link.id = walk.at WHERE link.nxt IS NOT NULL),
fin AS (SELECT walk.id, walk.at FROM walk JOIN link ON link.id = walk.at WHERE link.nxt IS NULL)
SELECT link.id, fin.at AS final_id FROM link LEFT JOIN fin USING (id) WHERE nxt IS NOT NULL""")
def supersede(spark, sf_dir):
    n = F.char_length("text")
    m = memories(spark, sf_dir).withColumns({
        "deleted_at": F.when(n % 4 > 0, F.lit("2024-03-01").cast("timestamp")),
        "replaced_by_id": F.when(n % 4 > 0, F.col("id") + 1 + n % 3)})
    return E.current_version(m)


# ---- maintenance --------------------------------------------------------------------------

_REEMBEDDED = MEM + """SELECT id, CASE WHEN embedding_model <> 'm1' THEN 'mock-sha256' ELSE embedding_model END AS embedding_model,
  CASE WHEN embedding_model <> 'm1' THEN sha256(text) END AS digest, md5(text) AS text_md5 FROM mem"""


@register(_REEMBEDDED)
def reembed(spark, sf_dir):
    class Named(prepare.MockEmbedding):
        """Goes by the name the current rows have, so only the others are stale."""
        model_name = "m1"

    return _digests(maintain.reembed(memories(spark, sf_dir), Named(64), AS_OF))


@register(_REEMBEDDED)
def reembed_resumed(spark, sf_dir):
    """The first run meets a provider that fails for long texts; the second one sends only what failed."""
    class Named(prepare.MockEmbedding):
        model_name = "m1"

    class Short(Named):
        def embed_batch(self, texts):
            if max(len(t) for t in texts) > 5000:
                raise RuntimeError("too long")
            return MockEmbedding.embed_batch(self, texts)

    table, ledger = stored_memories(spark, sf_dir), scratch_path(spark, "ledger")
    with contextlib.suppress(RuntimeError):
        maintain.reembed(table, Short(64), AS_OF, ledger=ledger, parts=4)
    return _digests(maintain.reembed(table, Named(64), AS_OF, ledger=ledger, parts=4))


def _digests(done):
    new = F.col("updated_at") == F.lit("2024-06-01").cast("timestamp")
    # The direction of the new vector gives back the digest bytes: its 64 values repeat 32 signed bytes.
    norm = F.sqrt(F.aggregate(F.slice("embedding", 1, 32), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    digest = F.sha2("text", 256)
    byte = F.conv(F.substring(digest, 1, 2), 16, 10).cast("double")
    first = F.when(byte > 127, byte - 256).otherwise(byte)
    seen = F.signum(F.col("embedding")[0].cast("double") / norm) == F.signum(first)
    return done.select("id", F.when(new, F.lit("mock-sha256")).otherwise(F.col("embedding_model")).alias("embedding_model"),
                       F.when(new & seen, digest).alias("digest"), F.md5("text").alias("text_md5"))


def _upgraders():
    def trim_tags(df):
        return df.withColumn("tags", F.slice("tags", 1, 1))

    def need_text(df):
        short = F.char_length("text") < 100
        return df.withColumns({"upgrade_error": F.when(short, "text too short"),
                               "importance": F.col("importance") / 2, "text": F.concat(F.lit("v3 "), "text")})

    return [maintain.Upgrader(1, 2, "first tag only", trim_tags), maintain.Upgrader(2, 3, "halve importance", need_text)]


@register(MEM + """, v AS (SELECT *, length(text) % 3 + 1 AS ver FROM mem)
SELECT id, CAST(CASE WHEN ver < 3 AND length(text) < 100 THEN ver ELSE 3 END AS INTEGER) AS record_version,
  CASE WHEN ver = 1 AND length(text) >= 100 THEN array_to_string(tags[1:1], '|') ELSE array_to_string(tags, '|') END AS tags,
  CAST(CASE WHEN ver < 3 AND length(text) >= 100 THEN importance / 2 ELSE importance END AS DOUBLE) AS importance,
  md5(CASE WHEN ver < 3 AND length(text) >= 100 THEN 'v3 ' || text ELSE text END) AS text_md5,
  CASE WHEN ver < 3 AND length(text) < 100 THEN 'text too short' END AS upgrade_error FROM v""")
def upgrade_records(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("record_version", (F.char_length("text") % 3 + 1).cast("int"))
    out = maintain.upgrade_records(m, _upgraders(), 3, AS_OF)
    return out.select("id", "record_version", joined("tags"), "importance", F.md5("text").alias("text_md5"), "upgrade_error")


@register(MEM + f"""SELECT id, CAST(1 AS INTEGER) AS record_version, CAST(NULL AS VARCHAR) AS expires_at,
  {stamp_sql('last_confirmed_at')}, forget_reason, replaced_by_id FROM mem""")
def upgrade_schema(spark, sf_dir):
    old = memories(spark, sf_dir).drop("record_version", "expires_at", "forget_reason", "replaced_by_id")
    new = maintain.upgrade_schema(old, version=1)
    return new.select("id", "record_version", stamp("expires_at"), stamp("last_confirmed_at"), "forget_reason", "replaced_by_id")


@register("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_nationkey AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def copy_corresponding(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"))
    s = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
        F.col("s_nationkey").cast("long").alias("nation"), F.lit(1).alias("other"))       # another type, another name
    return maintain.copy_corresponding(s, c)


_NTH = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate"


@register(f"""SELECT l_orderkey, l_linenumber, nth, CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 0 ELSE l_quantity END AS l_quantity,
  l_tax FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_NTH}) AS INTEGER) AS nth FROM lineitem)
  WHERE l_returnflag <> 'R'
UNION ALL SELECT -o_orderkey - 1, 0, 1, o_totalprice, NULL FROM orders""")
def apply_row_changes(spark, sf_dir):
    """All line items by (order, line, nth of them): old ones set to quantity 0, returned ones deleted, one row added per order."""
    nth = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy(*_NTH.split(", ")))
    item = read(spark, sf_dir, "lineitem").withColumn("nth", nth)
    key = ["l_orderkey", "l_linenumber", "nth"]
    none = F.lit(None).cast("double")
    returned = F.col("l_returnflag") == "R"
    edits = item.filter(returned | (F.col("l_shipdate") < "1997-01-01")).select(
        F.when(returned, "delete").otherwise("update").alias("op"), *key, F.lit(0.0).alias("l_quantity"),
        none.alias("l_tax"), F.array(F.lit("l_quantity")).alias("columns"))
    new = read(spark, sf_dir, "orders").select(
        F.lit("insert").alias("op"), (-F.col("o_orderkey") - 1).alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(1).alias("nth"),
        F.col("o_totalprice").alias("l_quantity"), none.alias("l_tax"), F.lit(None).cast("array<string>").alias("columns"))
    return E.apply_row_changes(item.select(*key, "l_quantity", "l_tax"), key, edits.unionByName(new)).rows


@register(MEM + """, top AS (SELECT max(id) AS m FROM mem), item AS (SELECT DISTINCT conv_id FROM conversations)
SELECT m + row_number() OVER (ORDER BY conv_id) AS id, 'new fact ' || conv_id AS text FROM item, top
UNION ALL SELECT id, NULL FROM mem, top WHERE id <= m - 10""")
def remember_after_hard_delete(spark, sf_dir):
    """The ten largest ids deleted for good, then new facts: ids go on above them, by the mark of the snapshot."""
    root = scratch_path(spark, "snapshots")
    first = save_snapshot(memories(spark, sf_dir), root)
    gone = spark.range(first.next_id - 10, first.next_id).select(F.col("id").alias("input_index"), "id")
    save_snapshot(E.forget(first.memories, gone, AS_OF, hard=True).memories, root)
    now = load_snapshot(spark, root)
    items = read(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("input_index"), F.concat(F.lit("new fact "), F.col("conv_id").cast("string")).alias("text"))
    done = remember.remember_batch(now.memories, items, AS_OF, MockEmbedding(64), user_id="user0", default_policy="insert", next_id=now.next_id)
    after = save_snapshot(now.memories.unionByName(done.inserted), root, now.next_id)
    return after.memories.select("id", F.when(F.col("id") >= now.next_id, F.col("text")).alias("text"))


@register("""SELECT doc_id + 1 AS id, CASE WHEN doc_id % 3 = 0 THEN 'spare ' || doc_id ELSE 'text ' || (doc_id - 1) END AS text,
  true AS ok FROM documents""")
def update_passes_texts_on(spark, sf_dir):
    """Rows by threes: the first takes a new text, the others, in order, the text that the row before gave up a moment ago."""
    doc, name = F.col("doc_id"), F.concat(F.lit("text "), F.col("doc_id").cast("string"))
    docs = read(spark, sf_dir, "documents").select("doc_id")
    table = S.as_memories(docs.select((doc + 1).alias("id"), F.lit("u").alias("user_id"), name.alias("text"), name.alias("normalized_text")))
    given = (F.when(doc % 3 == 0, F.concat(F.lit("spare "), doc.cast("string")))
             .otherwise(F.concat(F.lit("text "), (doc - 1).cast("string"))))
    items = docs.select(doc.alias("input_index"), (doc + 1).alias("id"), given.alias("text"),
                        F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    done = E.update_memory_batch(table, items, AS_OF)
    return done.memories.select("id", "text").join(done.results.select("id", "ok"), "id")
