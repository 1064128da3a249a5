"""Row predicates over the memories table. `as_of` is a column or value standing for now."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.errors import INVALID_INPUT, NOT_YET, RequestError, expected
from factloom.functions.text import normalize_tags


def moment(as_of) -> Column:
    """`as_of` given as a column, a datetime or a timestamp string."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def active(as_of) -> Column:
    """Neither deleted nor expired."""
    return F.col("deleted_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > moment(as_of)))


def expired(as_of) -> Column:
    return F.col("deleted_at").isNull() & (F.col("expires_at") <= moment(as_of))


def tombstone() -> Column:
    return F.col("deleted_at").isNotNull()


def visible(as_of, include_deleted: bool = False) -> Column:
    """The rows a listing shows: active ones, or with `include_deleted` all (expired ones too)."""
    return F.lit(True) if include_deleted else active(as_of)


def for_user(user_id: str) -> Column:
    return F.col("user_id") == user_id


def tags_overlap(tags) -> Column:
    """At least one canonical tag in common; no tags means no restriction."""
    wanted = normalize_tags(tags if isinstance(tags, Column)
                            else F.array(*[F.lit(t) for t in tags or []]).cast("array<string>"))
    if not isinstance(tags, Column) and not tags:
        return F.lit(True)
    return (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap("tags", wanted), F.lit(False))


def from_provider(provider: str | None) -> Column:
    """Exact source provider; blank means no restriction."""
    provider = (provider or "").strip()
    return F.col("source_provider") == provider if provider else F.lit(True)


def untagged() -> Column:
    return F.coalesce(F.size("tags"), F.lit(0)) <= 0


def text_length_between(min_chars: int | None = None, max_chars: int | None = None) -> Column:
    """Inclusive bounds on the text's length in characters."""
    for name, n in (("min_chars", min_chars), ("max_chars", max_chars)):
        if n is not None and n < 0:
            raise RequestError(INVALID_INPUT, expected(name, "a number from 0", n))
    if min_chars is not None and max_chars is not None and min_chars > max_chars:
        raise RequestError(INVALID_INPUT, expected("min_chars", f"a number up to {max_chars}", min_chars))
    out = F.lit(True)
    if min_chars is not None:
        out &= F.char_length("text") >= min_chars
    if max_chars is not None:
        out &= F.char_length("text") <= max_chars
    return out


def not_confirmed_since(since: datetime, as_of: datetime) -> Column:
    """Never confirmed, or last confirmed before `since`."""
    if since > as_of + timedelta(minutes=5):
        raise RequestError(INVALID_INPUT, f"not_confirmed_since: {NOT_YET}")
    return F.col("last_confirmed_at").isNull() | (F.col("last_confirmed_at") < moment(since))


def text_contains(pattern: str) -> Column:
    """Case-insensitive substring; wildcards of LIKE have no meaning."""
    return F.contains(F.lower("text"), F.lower(F.lit(pattern)))


def stale_embedding(provider: str, model: str) -> Column:
    """Embedding missing, or made by another provider or model. Tombstones count too."""
    return (F.col("embedding").isNull() | ~F.col("embedding_provider").eqNullSafe(provider)
            | ~F.col("embedding_model").eqNullSafe(model))


def below_version(version: int) -> Column:
    return F.col("record_version") < version


@dataclass(frozen=True)
class Cleanup:
    """The cleanup filters of listings and counts, all optional."""

    untagged_only: bool = False
    min_chars: int | None = None
    max_chars: int | None = None
    not_confirmed_since: datetime | None = None

    def column(self, as_of: datetime) -> Column:
        out = text_length_between(self.min_chars, self.max_chars)
        if self.untagged_only:
            out &= untagged()
        if self.not_confirmed_since is not None:
            out &= not_confirmed_since(self.not_confirmed_since, as_of)
        return out
