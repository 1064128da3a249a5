"""Keeping the table current: vectors, row versions, columns, copies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.operators.ledger import PARTS, resume
from factloom.operators.predicates import below_version, moment, stale_embedding
from factloom.operators.prepare import EmbeddingProvider, embed_column


def reembed(memories: DataFrame, provider: EmbeddingProvider, as_of, ledger: str | None = None, parts: int = PARTS) -> DataFrame:
    """The table with new vectors on every row whose provider or model differs; tombstones too.

    Text, tags and deletion stay. A failed provider call fails the job. Running it again
    on the result changes nothing. With a `ledger` folder the stale texts are sent in `parts` committed one after the other: a
    job that failed or was lost keeps what it paid for, and the next one sends only the rest and what failed. Only ids and texts are
    worked on, and the vectors come back to their rows by id.
    """
    stale = F.coalesce(stale_embedding(provider.provider_name, provider.model_name), F.lit(True))
    if ledger is None:
        fresh = embed_column(memories.filter(stale), provider)
    else:
        asked = memories.filter(stale).select("id", "text", F.xxhash64("text").alias("text_hash"))
        what = f"{provider.provider_name}/{provider.model_name}/{provider.dimensions}"
        sent = resume(asked, ["id", "text_hash"], what, lambda rows: embed_column(rows, provider), "embed_error is null", ledger, parts)
        made = ["embedding", "embedding_provider", "embedding_model", "embed_error"]
        failed = sent.filter("embed_error is not null").select("embed_error").first()
        if failed:
            raise RuntimeError(failed.embed_error)
        fresh = memories.filter(stale).drop(*made).join(sent.select("id", *made), "id")
    failed = F.col("embed_error").isNotNull()
    fresh = fresh.withColumn("embedding", F.when(failed, F.raise_error(F.col("embed_error")).cast("array<float>"))
                             .otherwise(F.col("embedding"))).withColumn("updated_at", moment(as_of))
    return memories.filter(~stale).unionByName(fresh.select(memories.columns))


@dataclass(frozen=True)
class Upgrader:
    """One step from a row version to the next. `apply` maps a DataFrame row by row and may
    set a string column `upgrade_error` on rows it cannot upgrade."""

    from_version: int
    to_version: int
    name: str
    apply: Callable[[DataFrame], DataFrame]


def check_steps(steps: list[int], first: int, target: int, what: str) -> None:
    """Versions must run first, first+1, ..., target without gaps."""
    if target < first - 1:
        raise ValueError(f"{what}: target version {target} is below {first - 1}")
    if steps != list(range(first, target + 1)):
        raise ValueError(f"{what}: versions {steps} are not {list(range(first, target + 1))}")


def upgrade_records(memories: DataFrame, upgraders: list[Upgrader], target: int, as_of) -> DataFrame:
    """The table with rows below `target` taken through the steps, plus `upgrade_error`.

    A row that fails in any step stays as it was, at its old version.
    """
    check_steps([u.to_version for u in upgraders], 2, target, "upgraders")
    for u in upgraders:
        if u.from_version != u.to_version - 1 or not u.name:
            raise ValueError(f"upgrader {u.name!r} must go up by one version and have a name")
    due, done = rows_to_upgrade(memories, target), memories.filter(~F.coalesce(below_version(target), F.lit(False)))
    names = memories.columns
    df = due.withColumn("_was", F.struct(*names)).withColumn("_error", F.lit(None).cast("string"))
    for u in upgraders:
        before = df.select("_was", "_error", F.struct(*names).alias("_now"), *names)
        after = u.apply(before.withColumn("upgrade_error", F.lit(None).cast("string")))
        now = F.col("_error").isNull() & (F.col("_now.record_version") == u.from_version)
        df = after.select(
            "_was", F.when(now, F.col("upgrade_error")).otherwise(F.col("_error")).alias("_error"),
            *[(F.when(now, F.lit(u.to_version)).otherwise(F.col("_now.record_version")) if n == "record_version"
               else F.when(now, F.col(n)).otherwise(F.col(f"_now.{n}"))).alias(n) for n in names])
    keep_old = F.col("_error").isNotNull()
    upgraded = df.select(*[F.when(keep_old, F.col(f"_was.{n}")).otherwise(moment(as_of) if n == "updated_at" else F.col(n)).alias(n)
                           for n in names], F.col("_error").alias("upgrade_error"))
    return done.withColumn("upgrade_error", F.lit(None).cast("string")).unionByName(upgraded)


def rows_to_upgrade(memories: DataFrame, target: int) -> DataFrame:
    return memories.filter(below_version(target))


# What each table version added, with the value old rows get.
TABLE_VERSIONS = [
    (2, {"record_version": 1}),
    (3, {"expires_at": None, "last_confirmed_at": None}),
    (4, {"forget_reason": None, "replaced_by_id": None}),
]
TABLE_VERSION = 4


def upgrade_schema(table: DataFrame, version: int = 1, target: int = TABLE_VERSION) -> DataFrame:
    """An older table with the columns that later versions added; columns already there are kept."""
    check_steps([v for v, _ in TABLE_VERSIONS], 2, TABLE_VERSION, "table versions")
    if version > target:
        raise ValueError(f"table version {version} is newer than {target}, which this code knows")
    for step, added in TABLE_VERSIONS:
        if version < step <= target:
            for name, value in added.items():
                if name not in table.columns:
                    table = table.withColumn(name, F.lit(value).cast(S.MEMORIES[name].dataType))
    return table


def copy_corresponding(source: DataFrame, target: DataFrame) -> DataFrame:
    """`target` with the rows of `source` added: only columns of the same name and type are carried over."""
    types = {f.name: f.dataType for f in target.schema.fields}
    shared = [f.name for f in source.schema.fields if types.get(f.name) == f.dataType]
    return target.unionByName(source.select(*shared), allowMissingColumns=True)
