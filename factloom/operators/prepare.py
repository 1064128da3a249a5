"""Preparing request items: validation and embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schema as S
from factloom.errors import EMBEDDING_ERROR, INVALID_INPUT, NO_TEXT, NOT_YET, SECRET_REJECTED, TOO_LATE, expected, over
from factloom.functions import text as X
from factloom.operators.predicates import moment

# Allowed settings of a remember item.
CAPTURE_MODES = ("explicit", "inferred")
DEDUP_POLICIES = ("insert", "skip_if_near", "ask")


# ---- validation ---------------------------------------------------------------------------

def _error(code: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), message.alias("message"))


def _over(what: str, found: Column, most: int) -> Column:
    return F.format_string(over(what, "%s", most), found.cast("string"))


def _expected(what: str, wanted: str, found: Column) -> Column:
    return F.format_string(expected(what, wanted, "%s"), found.cast("string"))


def first_error(rules: list[tuple[Column, Column]]) -> Column:
    """The error of the first rule that fires, or null. A null condition does not fire."""
    out = F.lit(None).cast("struct<code:string,message:string>")
    for broken, error in reversed(rules):
        out = F.when(broken, error).otherwise(out)
    return out


def with_clean_text(df: DataFrame) -> DataFrame:
    """`df` with `_text` (trimmed) and `_secret`, each worked out once per row."""
    return df.withColumn("_text", X.clean_text(F.col("text"))).withColumn("_secret", X.secret_label(F.col("_text")))


def text_rules() -> list[tuple[Column, Column]]:
    """Rules on the columns of `with_clean_text`."""
    n = F.char_length("_text")
    return [
        (F.coalesce("_text", F.lit("")) == "", _error(INVALID_INPUT, NO_TEXT)),
        (n > S.MAX_TEXT_CHARS, _error(INVALID_INPUT, _over("text characters", n, S.MAX_TEXT_CHARS))),
        (F.col("_secret").isNotNull(), _error(SECRET_REJECTED, F.col("_secret"))),
    ]


def tag_rules(c: Column) -> list[tuple[Column, Column]]:
    long_tags = F.filter(c, lambda t: F.char_length(X.clean_text(t)) > S.MAX_TAG_CHARS)
    long_length = F.char_length(X.clean_text(F.try_element_at(long_tags, F.lit(1))))
    return [
        (F.size(long_tags) > 0, _error(INVALID_INPUT, _over("tag characters", long_length, S.MAX_TAG_CHARS))),
        (F.size(X.normalize_tags(c)) > S.MAX_TAGS,
         _error(INVALID_INPUT, _over("tags", F.size(X.normalize_tags(c)), S.MAX_TAGS))),
    ]


def importance_rules(c: Column) -> list[tuple[Column, Column]]:
    return [((c < 0) | (c > 1), _error(INVALID_INPUT, expected("importance", "a number from 0 to 1")))]


def expiry_rules(c: Column, as_of) -> list[tuple[Column, Column]]:
    return [(c > moment(as_of) + F.expr("interval 36500 days"),
             _error(INVALID_INPUT, f"expires_at: {TOO_LATE}"))]


def confirmation_rules(c: Column, as_of) -> list[tuple[Column, Column]]:
    return [(c > moment(as_of) + F.expr("interval 5 minutes"),
             _error(INVALID_INPUT, f"last_confirmed_at: {NOT_YET}"))]


def blank_to_null(c: Column) -> Column:
    t = X.clean_text(c)
    return F.when(t != "", t)


ITEM_TYPES = {
    "input_index": "long", "text": "string", "tags": "array<string>", "source_provider": "string",
    "importance": "double", "capture_mode": "string", "session_id": "string", "dedup_policy": "string",
    "expires_at": "timestamp", "last_confirmed_at": "timestamp",
}


def complete(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """`df` with every named column, missing ones null; other columns are kept."""
    have = set(df.columns)
    named = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in types.items()]
    return df.select(*named, *[c for c in df.columns if c not in types])


def validate_items(items: DataFrame, as_of, default_policy: str | None = None,
                   default_provider: str | None = None) -> DataFrame:
    """Remember items made ready to store, with `error` (code, message) of the first broken rule or null."""
    rest = [c for c in items.columns if c not in ITEM_TYPES]
    items = with_clean_text(complete(items, ITEM_TYPES))
    mode, session = blank_to_null(F.col("capture_mode")), blank_to_null(F.col("session_id"))
    fallback = (default_policy or "").strip() or "ask"
    own_policy = F.when(F.col("dedup_policy") != "", F.col("dedup_policy"))
    policy = F.when(own_policy.isNull(), F.lit(fallback)).otherwise(
        F.coalesce(blank_to_null(own_policy), F.lit("ask")))
    rules = (
        text_rules() + tag_rules(F.col("tags")) + importance_rules(F.col("importance"))
        + [(~mode.isin(*CAPTURE_MODES),
            _error(INVALID_INPUT, _expected("capture_mode", " or ".join(CAPTURE_MODES), mode))),
           (F.char_length(session) > S.MAX_SESSION_ID_CHARS,
            _error(INVALID_INPUT, _over("session_id characters", F.char_length(session), S.MAX_SESSION_ID_CHARS))),
           (~policy.isin(*DEDUP_POLICIES),
            _error(INVALID_INPUT, _expected("dedup_policy", " or ".join(DEDUP_POLICIES), policy)))]
        + expiry_rules(F.col("expires_at"), as_of) + confirmation_rules(F.col("last_confirmed_at"), as_of))
    provider = F.when(F.col("source_provider") != "", F.col("source_provider"))
    return items.select(
        "input_index",
        F.col("_text").alias("text"),
        X.normalize_text(F.col("_text")).alias("normalized_text"),
        X.normalize_tags(F.col("tags")).alias("tags"),
        F.coalesce(provider, F.lit(default_provider)).alias("source_provider"),
        F.coalesce("importance", F.lit(S.DEFAULTS["importance"])).alias("importance"),
        X.metadata_json(mode).alias("metadata"),
        session.alias("source_conversation_id"),
        policy.alias("dedup_policy"),
        "expires_at", "last_confirmed_at",
        first_error(rules).alias("error"),
        *rest)


# ---- embedding ----------------------------------------------------------------------------

class EmbeddingProvider(Protocol):
    """What an embedding plug-in offers. It is shipped to the tasks, so it must pickle."""

    provider_name: str
    model_name: str
    dimensions: int

    def embed_batch(self, texts: list[str | None]) -> np.ndarray:
        """One float row of `dimensions` values per text, in order."""


class MockEmbedding:
    """Vectors from the SHA-256 of the text: equal texts are equal, others are unrelated."""

    provider_name = "mock"
    model_name = "mock-sha256"

    def __init__(self, dimensions: int = 1536):
        if dimensions <= 0:
            raise ValueError("dimensions must be positive")
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str | None]) -> np.ndarray:
        digests = b"".join(hashlib.sha256((t or "").encode("utf-8")).digest() for t in texts)
        signed = np.frombuffer(digests, np.int8).reshape(len(texts), 32) / 128.0
        out = np.take(signed, np.arange(self.dimensions) % 32, axis=1)
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def embed_column(df: DataFrame, provider: EmbeddingProvider, text_col: str = "text",
                 batch_size: int = 256) -> DataFrame:
    """`df` with embedding, embedding_provider, embedding_model and embed_error.

    A failing provider call marks the rows of that call in `embed_error`; a wrong number of
    vectors or a wrong dimension is an error of the job. Null texts are embedded too.
    """
    made = ("embedding", "embedding_provider", "embedding_model", "embed_error")
    kept = df.drop(*made)
    schema = T.StructType([*kept.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("embed_error", T.StringType())])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch_size):
                batch = whole.slice(lo, batch_size)
                texts = batch.column(text_col).to_pylist()
                try:
                    vectors = np.asarray(provider.embed_batch(texts), dtype=np.float32)
                except Exception as e:      # the call failed: say so in the rows
                    vec = pa.nulls(len(texts), pa.list_(pa.float32()))
                    why = pa.array([f"embedding: {e}"] * len(texts), pa.string())
                else:
                    if vectors.shape != (len(texts), provider.dimensions):
                        raise ValueError(f"{EMBEDDING_ERROR}: got vectors of shape {vectors.shape}, "
                                         f"expected {(len(texts), provider.dimensions)}")
                    ends = np.arange(len(texts) + 1, dtype=np.int32) * provider.dimensions
                    vec = pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.reshape(-1)))
                    why = pa.nulls(len(texts), pa.string())
                cols = [batch.column(i) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(cols + [vec, why], names=[f.name for f in schema.fields])

    done = F.col("embedding").isNotNull()
    return (kept.mapInArrow(embed, schema)
            .withColumn("embedding_provider", F.when(done, F.lit(provider.provider_name)))
            .withColumn("embedding_model", F.when(done, F.lit(provider.model_name))))


# ---- output shapes ------------------------------------------------------------------------

def _optional() -> list[Column]:
    return [X.capture_mode_of(F.col("metadata")).alias("capture_mode"),
            F.col("source_conversation_id").alias("session_id"),
            X.iso(F.col("expires_at")).alias("expires_at"),
            X.iso(F.col("last_confirmed_at")).alias("last_confirmed_at")]


def _trail() -> list[Column]:
    return [F.col("forget_reason"), F.col("replaced_by_id")]


def memory_view() -> Column:
    """A hit as a JSON object; fields without a value are left out. Needs a `score` column."""
    return F.to_json(F.struct(
        F.col("id"), F.col("text"), F.col("score"),
        X.iso(F.col("created_at")).alias("created_at"), X.iso(F.col("updated_at")).alias("updated_at"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("source_provider"),
        *_optional(), X.iso(F.col("deleted_at")).alias("deleted_at"), *_trail()))


def memory_list_view() -> Column:
    """A listed row as a JSON object: no score, no source provider."""
    return F.to_json(F.struct(
        F.col("id"), F.col("text"),
        X.iso(F.col("created_at")).alias("created_at"), X.iso(F.col("updated_at")).alias("updated_at"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        X.iso(F.col("deleted_at")).alias("deleted_at"), *_optional(), *_trail()))
