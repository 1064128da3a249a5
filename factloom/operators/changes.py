"""Jobs that change the table: each takes the table and a request, and returns the new table and the results."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.errors import (DATABASE_ERROR, EMBEDDING_ERROR, INVALID_INPUT, NEEDS_VECTORS, NO_CHANGE, NO_ID, NO_TRACE, NOT_FOUND, TEXT_TAKEN,
                             RequestError, no_row, over)
from factloom.functions import text as X
from factloom.operators import prepare as P
from factloom.operators.predicates import moment
from factloom.operators.skew import broadcast_if_small, join_unique, only_ids
from factloom.session import cut_lineage


class Changed(NamedTuple):
    memories: DataFrame
    results: DataFrame


_UPDATE_TYPES = {"input_index": "long", "id": "long", "text": "string", "tags": "array<string>",
                 "importance": "double", "expires_at": "timestamp", "last_confirmed_at": "timestamp"}
_FIELDS = ["text", "tags", "importance", "expires_at", "last_confirmed_at"]      # the order results list them in


def _not_found(id_col: Column) -> Column:
    return P._error(NOT_FOUND, F.format_string(no_row("%s"), id_col.cast("string")))


def _rewrite(memories: DataFrame, changes: DataFrame, new_values: dict[str, Column]) -> DataFrame:
    """The table with new column values on the rows whose id is in `changes` (unique ids).

    `new_values` may use the change columns as `c.<name>`. A counted small change set is
    broadcast, so the table is rewritten in place without a shuffle.
    """
    hit = F.col("c.id").isNotNull()
    most = 2_000 if "embedding" in changes.columns else 10_000      # rows with a text and a vector are larger
    joined = memories.alias("m").join(broadcast_if_small(changes, most).alias("c"), F.col("m.id") == F.col("c.id"), "left")
    return joined.select(*[
        (F.when(hit, new_values[n]).otherwise(F.col(f"m.{n}")) if n in new_values else F.col(f"m.{n}")).alias(n)
        for n in memories.columns])


# ---- update -------------------------------------------------------------------------------

def update_memory_batch(memories: DataFrame, items: DataFrame, as_of, provider: P.EmbeddingProvider | None = None,
                        dry_run: bool = False) -> Changed:
    """Change any of text, tags, importance, expires_at, last_confirmed_at by id; null leaves a field alone.

    Items with one id apply in `input_index` order. A new text is embedded and normalized
    again (items may bring their `embedding` instead of a provider). A text that another undeleted row of
    the user holds when the item's turn comes is refused; a text that an earlier item gave up is free.
    """
    items = P.with_clean_text(P.complete(items, _UPDATE_TYPES))
    has_text, has_tags = F.col("text").isNotNull(), F.col("tags").isNotNull()
    rules = [(F.col("id").isNull(), P._error(INVALID_INPUT, NO_ID))]
    rules += [(has_text & F.coalesce(broken, F.lit(False)), e) for broken, e in P.text_rules()]
    rules += P.tag_rules(F.col("tags"))
    rules += P.expiry_rules(F.col("expires_at"), as_of) + P.confirmation_rules(F.col("last_confirmed_at"), as_of)
    nothing = F.lit(True)
    for f in _FIELDS:
        nothing &= F.col(f).isNull()
    rules.append((nothing, P._error(INVALID_INPUT, NO_CHANGE)))
    changed = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in _FIELDS]))
    own_vector = ["embedding"] if "embedding" in items.columns else []
    checked = items.select(
        "input_index", "id", F.col("_text").alias("text"),
        X.normalize_text(F.col("_text")).alias("normalized_text"),
        F.when(has_tags, X.normalize_tags(F.col("tags"))).alias("tags"), "importance", "expires_at",
        "last_confirmed_at", *own_vector, changed.alias("changed_fields"), P.first_error(rules).alias("error"))

    # The rows asked for. Only the ids of the batch leave the scan of the table.
    ids = broadcast_if_small(items.select("id").filter("id is not null").distinct())
    targets = memories.select("id", "user_id", "deleted_at").join(ids, "id", "left_semi")
    targets = targets.select("id", "user_id", F.col("deleted_at").isNull().alias("alive"))
    checked = join_unique(checked, targets, ["id"], "input_index")
    gone = F.col("error").isNull() & ~F.coalesce("alive", F.lit(False))
    checked = cut_lineage(checked.withColumn("error", F.when(gone, _not_found(F.col("id")))
                                             .otherwise(F.col("error"))).drop("alive"))
    good = checked.filter("error is null")

    errors = [checked.filter("error is not null").select("input_index", "error")]
    texts = good.filter("text is not null")
    if not dry_run:
        if provider is not None and not texts.isEmpty():
            texts = cut_lineage(P.embed_column(texts, provider))
            failed = texts.filter("embed_error is not null").select("embed_error").first()
            if failed:
                errors.append(texts.select("input_index", P._error(EMBEDDING_ERROR, failed.embed_error).alias("error")))
                good, texts = good.filter("text is null"), texts.filter("false")
        elif provider is None and not own_vector and not texts.isEmpty():
            raise RequestError(EMBEDDING_ERROR, NEEDS_VECTORS)
        refused = cut_lineage(_taken_texts(memories, texts))
        errors.append(refused.select("input_index", P._error(DATABASE_ERROR, TEXT_TAKEN).alias("error")))
        good = good.join(refused.select("input_index"), "input_index", "left_anti")
        texts = texts.join(refused.select("input_index"), "input_index", "left_anti")
    bad = errors[0]
    for more in errors[1:]:
        bad = bad.unionByName(more)
    results = checked.select("input_index", "id", "changed_fields").join(
        bad.withColumnRenamed("error", "why"), "input_index", "left")
    results = results.select(
        "input_index", "id", F.col("why").isNull().alias("ok"), F.lit(dry_run).alias("dry_run"),
        F.when(F.col("why").isNull(), F.col("changed_fields")).alias("changed_fields"),
        F.col("why.code").alias("error_code"), F.col("why.message").alias("error_message"))
    if dry_run:
        return Changed(memories, results)

    def last(name: str) -> Column:      # the last value given for a field wins
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("input_index"))).alias(name)

    merged = good.groupBy("id").agg(*[last(f) for f in ["tags", "importance", "expires_at", "last_confirmed_at"]])
    by_text = ["text", "normalized_text", "embedding", "embedding_provider", "embedding_model"]
    for n in by_text:
        if n not in texts.columns:
            texts = texts.withColumn(n, F.lit(None).cast(S.MEMORIES[n].dataType))
    newest = texts.groupBy("id").agg(F.max_by(F.struct(*by_text), "input_index").alias("t"))
    changes = cut_lineage(merged.join(newest, "id", "left").select("id", "t.*", *_FIELDS[1:]))
    values = {n: F.coalesce(f"c.{n}", f"m.{n}") for n in by_text + _FIELDS[1:]}
    values["updated_at"] = moment(as_of)
    return Changed(_rewrite(memories, changes, {n: v for n, v in values.items() if n in memories.columns}), results)


def _taken_texts(memories: DataFrame, texts: DataFrame) -> DataFrame:
    """`input_index` of the new texts that someone else holds when their turn comes, as if the items ran one after the other.

    A text is held by the undeleted rows that have it; an accepted item gives up its row's old text. In each round an item is
    refused if a holder other than its row has no open item before it, and accepted if nobody else holds or asks for the text before it
    and its row has no open item before it. All that one holder keeps is refused at once, so the rounds follow
    chains of texts that are passed on, not the number of items. The first open item is always decided.
    """
    def key(user: str, text: str) -> Column:
        return F.sha2(F.concat_ws("\x01", user, text), 256).alias("key")

    open_items = cut_lineage(texts.select("input_index", "id", key("user_id", "normalized_text")))
    wanted = broadcast_if_small(open_items.select("key").distinct())
    rows = memories.filter("deleted_at is null").select("id", key("user_id", "normalized_text"))
    held = cut_lineage(rows.join(wanted, "key", "left_semi"))
    refused = open_items.select("input_index").filter("false")
    while not open_items.isEmpty():
        turn = open_items.groupBy("id").agg(F.min("input_index").alias("turn"))
        holders = held.join(turn, "id", "left")
        stays = F.col("turn").isNull()
        of_key = cut_lineage(holders.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.when(stays, F.col("id"))).alias("low"), F.max(F.when(stays, F.col("id"))).alias("high"),
            F.max(F.when(~stays, F.struct("turn", "id"))).alias("last")))
        asked = cut_lineage(open_items.groupBy("key").agg(F.min("input_index").alias("asked")))
        seen = join_unique(open_items, of_key, ["key"], "input_index")
        seen = join_unique(seen, asked, ["key"], "input_index")
        seen = join_unique(seen, turn, ["id"], "input_index")
        mine = held.select("id", "key", F.lit(1).alias("mine")).distinct()
        seen = join_unique(seen, mine, ["id", "key"], "input_index")
        kept = F.coalesce((F.col("low") != F.col("id")) | (F.col("high") != F.col("id")), F.lit(False))
        kept |= F.coalesce((F.col("last.id") != F.col("id")) & (F.col("last.turn") > F.col("input_index")), F.lit(False))
        others = F.coalesce("n", F.lit(0)) - F.coalesce("mine", F.lit(0))
        free = (others == 0) & (F.col("asked") == F.col("input_index")) & (F.col("turn") == F.col("input_index"))
        decided = cut_lineage(seen.select("input_index", "id", "key", F.when(kept, "no").when(free, "yes").alias("verdict")))
        refused = cut_lineage(refused.unionByName(decided.filter("verdict = 'no'").select("input_index")))
        new = decided.filter("verdict = 'yes'").select("id", "key")
        held = cut_lineage(held.join(new.select("id"), "id", "left_anti").unionByName(new))
        open_items = cut_lineage(decided.filter("verdict is null").drop("verdict"))
    return refused


def update_memory(memories: DataFrame, id: int, as_of, provider: P.EmbeddingProvider | None = None,
                  dry_run: bool = False, **fields) -> Changed:
    """`update_memory_batch` with one item; an error is raised."""
    item = memories.sparkSession.createDataFrame([(0, id)], "input_index long, id long")
    for name, value in fields.items():
        value = F.array(*[F.lit(t) for t in value]) if name == "tags" and value is not None else F.lit(value)
        item = item.withColumn(name, value.cast(_UPDATE_TYPES[name]))
    done = update_memory_batch(memories, item, as_of, provider, dry_run)
    row = done.results.first()
    if not row.ok:
        raise RequestError(row.error_code, row.error_message)
    return done


def confirm(memories: DataFrame, ids: DataFrame, as_of) -> Changed:
    """Set last_confirmed_at to now on undeleted rows. `ids`: input_index, id."""
    rows = _found(memories, ids)
    ok = F.coalesce("alive", F.lit(False))
    results = _with_error(rows, [(~ok, _not_found(F.col("id")))]).select(
        "input_index", "id", F.col("error").isNull().alias("ok"), "error_code", "error_message")
    hits = rows.filter(ok).select("id").distinct()
    now = moment(as_of)
    return Changed(_rewrite(memories, hits, {"last_confirmed_at": now, "updated_at": now}), results)


# ---- forget -------------------------------------------------------------------------------

def _found(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with `alive`: true for an undeleted row, false for a tombstone, null for no row."""
    have = only_ids(memories.select("id", "deleted_at"), requests)
    have = have.select("id", F.col("deleted_at").isNull().alias("alive"))
    return cut_lineage(join_unique(requests, have, ["id"], "input_index"))


def _with_error(rows: DataFrame, rules) -> DataFrame:
    rows = rows.withColumn("error", P.first_error(rules))
    return rows.withColumn("error_code", F.col("error.code")).withColumn("error_message", F.col("error.message"))


def _clean_reason(reason: str | None) -> str | None:
    reason = (reason or "").strip(X._BLANKS) or None
    if reason is not None and len(reason) > S.MAX_FORGET_REASON_CHARS:
        raise RequestError(INVALID_INPUT, over("reason characters", len(reason), S.MAX_FORGET_REASON_CHARS))
    return reason


def _soft_delete(memories: DataFrame, hits: DataFrame, as_of) -> DataFrame:
    """Mark rows deleted; reason and replaced_by_id change only where given. A first deletion time stays."""
    now = moment(as_of)
    return _rewrite(memories, hits, {
        "deleted_at": F.coalesce("m.deleted_at", now),
        "forget_reason": F.coalesce("c.reason", "m.forget_reason"),
        "replaced_by_id": F.coalesce("c.replaced_by_id", "m.replaced_by_id"),
        "updated_at": now})


def forget(memories: DataFrame, requests: DataFrame, as_of, hard: bool = False, dry_run: bool = False) -> Changed:
    """Soft or hard delete by id. `requests`: input_index, id and, for soft deletes, reason, replaced_by_id.

    Results: input_index, id, ok, already_deleted, hard, dry_run, error_code, error_message.
    """
    requests = P.complete(requests, {"input_index": "long", "id": "long", "reason": "string",
                                     "replaced_by_id": "long"})
    requests = requests.withColumn("reason", P.blank_to_null(F.col("reason")))
    rows = _found(memories, requests)
    length = F.char_length("reason")
    rules = [(length > S.MAX_FORGET_REASON_CHARS, P._error(INVALID_INPUT, P._over("reason characters", length, S.MAX_FORGET_REASON_CHARS))),
    ]
    if hard:
        rules.append((F.col("reason").isNotNull() | F.col("replaced_by_id").isNotNull(), P._error(INVALID_INPUT, NO_TRACE)))
    rules.append((F.col("alive").isNull(), _not_found(F.col("id"))))
    rows = _with_error(rows, rules)
    rows = _mark_repeats(rows, dry_run)
    if hard:    # a second hard delete of one id finds nothing
        again = F.col("error").isNull() & F.col("again")
        rows = rows.withColumn("error", F.when(again, _not_found(F.col("id"))).otherwise(F.col("error")))
        rows = rows.withColumn("error_code", F.col("error.code")).withColumn("error_message", F.col("error.message"))
    ok = F.col("error").isNull()
    results = rows.select("input_index", "id", ok.alias("ok"),
                          F.when(ok, ~F.col("alive") | F.col("again")).alias("already_deleted"),
                          F.lit(hard).alias("hard"), F.lit(dry_run).alias("dry_run"), "error_code", "error_message")
    if dry_run:
        return Changed(memories, results)
    good = rows.filter(ok)
    if hard:
        return Changed(only_ids(memories, good, keep=False).select(memories.columns), results)

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("input_index"))).alias(name)

    hits = good.groupBy("id").agg(last("reason"), last("replaced_by_id"))
    return Changed(_soft_delete(memories, hits, as_of), results)


def _mark_repeats(rows: DataFrame, dry_run: bool) -> DataFrame:
    """`again`: true on the second and later good request for one id; a dry run changes nothing, so never there."""
    if dry_run:
        return rows.withColumn("again", F.lit(False))
    first = rows.filter("error is null").groupBy("id").agg(F.min("input_index").alias("first"))
    rows = join_unique(rows, first, ["id"], "input_index")
    return rows.withColumn("again", F.coalesce(F.col("input_index") > F.col("first"), F.lit(False)))


def forget_batch(memories: DataFrame, ids: DataFrame, as_of, reason: str | None = None,
                 dry_run: bool = False) -> Changed:
    """Soft delete many ids with one shared reason. `ids`: input_index, id.

    A repeated id counts as already deleted from its second time on, but not in a dry run.
    """
    reason = _clean_reason(reason)
    rows = _found(memories, P.complete(ids, {"input_index": "long", "id": "long"}))
    rows = _with_error(rows, [
        (F.col("id").isNull(), P._error(INVALID_INPUT, NO_ID)),
        (F.col("alive").isNull(), _not_found(F.col("id")))])
    rows = _mark_repeats(rows, dry_run)
    ok = F.col("error").isNull()
    results = rows.select("input_index", "id", ok.alias("ok"), F.when(ok, ~F.col("alive") | F.col("again")).alias("already_deleted"),
                          "error_code", "error_message")
    if dry_run:
        return Changed(memories, results)
    hits = rows.filter(ok).select("id", F.lit(reason).alias("reason"),
                                  F.lit(None).cast("long").alias("replaced_by_id")).distinct()
    return Changed(_soft_delete(memories, hits, as_of), results)


def current_version(memories: DataFrame) -> DataFrame:
    """`id, final_id` for every tombstone with a replacement: the end of its chain of replacements.

    The chain is followed by doubling, so a chain of n links takes log n rounds. A chain
    that runs in a circle or ends in no row has no final id.
    """
    link = F.when(F.col("deleted_at").isNotNull(), F.col("replaced_by_id"))
    rows = memories.select("id", link.alias("next"))
    hops = cut_lineage(rows.filter("next is not null"))
    steps = max(1, hops.count().bit_length()) + 1
    for _ in range(steps):
        onward = hops.select(F.col("id").alias("next"), F.col("next").alias("further"))
        moved = join_unique(hops, onward, ["next"], "id")
        if moved.filter("further is not null").isEmpty():
            break
        hops = cut_lineage(moved.select("id", F.coalesce("further", "next").alias("next")))
    ends = rows.filter("next is null").select(F.col("id").alias("next"), F.lit(True).alias("real"))
    ended = join_unique(hops, ends, ["next"], "id")
    return ended.select("id", F.when(F.col("real"), F.col("next")).alias("final_id"))


class RowsChanged(NamedTuple):
    rows: DataFrame
    refused: DataFrame      # the changes not applied, with the reason


def apply_row_changes(table: DataFrame, key: list[str], changes: DataFrame) -> RowsChanged:
    """A table after inserts, updates and deletes by key, and the changes that were refused.

    `changes`: `op` (insert, update, delete), the key columns, the other columns (missing
    ones count as null) and optionally `columns`, the names an update sets; without it an
    update sets every given column. Refused are all changes of a key that has several of them (their order is not known), an
    insert of a key that the table holds, and a change with a null in its key. A change of a missing key changes nothing.
    """
    if not key:
        raise RequestError(INVALID_INPUT, "a table without a primary key cannot be changed")
    given = [c for c in table.columns if c not in key and c in changes.columns]
    named = F.col("columns") if "columns" in changes.columns else F.lit(None).cast("array<string>")
    ch = changes.select("op", *key, *given, named.alias("columns"))
    several = ch.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    no_key = F.lit(False)
    for k in key:
        no_key |= F.col(k).isNull()
    ch = join_unique(ch.withColumn("_row", F.pmod(F.xxhash64("op", *given), F.lit(1 << 40))), several, key, "_row", weight="_n")
    present = table.join(broadcast_if_small(ch.filter("op = 'insert'").select(*key).distinct()), key, "left_semi").select(*key).distinct()
    ch = ch.join(present.withColumn("_held", F.lit(True)), key, "left")
    why = (F.when(no_key, "the key holds a null").when(F.col("_n") > 1, "several changes of one key")
           .when((F.col("op") == "insert") & F.col("_held"), "the key is taken"))
    ch = cut_lineage(ch.withColumn("reason", why).drop("_row", "_n", "_held"))
    good = ch.filter("reason is null")
    edits = broadcast_if_small(good.filter("op in ('update', 'delete')")).alias("c")
    on = F.lit(True)
    for k in key:
        on &= F.col(f"t.{k}") == F.col(f"c.{k}")
    joined = table.alias("t").join(edits, on, "left").filter(F.coalesce(F.col("c.op") != "delete", F.lit(True)))
    cols = []
    for n in table.columns:
        if n in given:
            sets = F.col("c.op").isNotNull() & (F.col("c.columns").isNull() | F.array_contains("c.columns", n))
            cols.append(F.when(sets, F.col(f"c.{n}")).otherwise(F.col(f"t.{n}")).alias(n))
        else:
            cols.append(F.col(f"t.{n}"))
    new = good.filter("op = 'insert'").select(*key, *given)
    return RowsChanged(joined.select(*cols).unionByName(new, allowMissingColumns=True),
                       ch.filter("reason is not null").select("op", *key, "reason"))
