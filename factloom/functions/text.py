"""Text, tag and JSON-shape expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every char up to U+0020, which is what trimming removes (Spark's trim removes spaces only).
_BLANKS = "".join(chr(i) for i in range(33))

# Tag synonyms and the canonical tag they stand for.
TAG_SYNONYMS = {
    "software": ["tech", "technology", "programming", "coding", "code", "dev", "development", "engineering"],
    "publishing": ["book", "books", "writing", "author", "authorship"],
    "personal": ["bio", "biography", "personal-info"],
    "family": ["relatives", "kin"],
    "work": ["job", "career", "employment"],
    "preferences": ["preference", "pref", "prefs", "likes", "dislikes"],
    "health": ["medical", "medicine", "medications"],
    "philosophy": ["religion", "beliefs", "values"],
}

# Our own shapes of well-known secrets: label, what every such secret contains, pattern.
SECRET_SHAPES = [
    ("OpenAI key", ["sk-"], r"\bsk-(ant-|proj-)?[A-Za-z0-9_-]{20,}"),
    ("GitHub token", ["ghp_", "ghs_", "github_pat_"], r"\b(gh[ps]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})"),
    ("AWS access key id", ["AKIA", "ASIA"], r"\b(AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("Slack token", ["xox"], r"\bxox[a-z]-[A-Za-z0-9-]{10,}"),
    ("Google API key", ["AIza"], r"\bAIza[0-9A-Za-z_-]{35}"),
    ("JWT", ["eyJ"], r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("PEM private key", ["PRIVATE KEY-----"], r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]


def clean_text(c: Column) -> Column:
    """Blanks and control chars stripped from both ends; the wording is kept."""
    return F.btrim(c, F.lit(_BLANKS))


def normalize_text(c: Column) -> Column:
    """The exact-duplicate key: trimmed, whitespace runs made one space, lower case."""
    return F.lower(F.regexp_replace(clean_text(c), r"[ \t\n\x0B\f\r]+", " "))


def normalize_tag(c: Column) -> Column:
    """One tag trimmed, lower-cased and mapped from synonym to canonical form."""
    key = F.lower(clean_text(c))
    pairs = [F.lit(x) for canon, syns in TAG_SYNONYMS.items() for s in syns for x in (s, canon)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def normalize_tags(c: Column) -> Column:
    """Canonical tags without nulls, blanks and repeats, first seen first; null gives an empty array."""
    tags = F.array_distinct(F.filter(F.transform(c, normalize_tag), lambda t: t.isNotNull() & (t != "")))
    return F.coalesce(tags, F.array().cast("array<string>"))


def merge_tags(c: Column, extra: list[str]) -> Column:
    """Tags plus the extra ones that are not there yet (exact match)."""
    add = F.array(*[F.lit(t) for t in extra]).cast("array<string>")
    have = F.coalesce(c, F.array().cast("array<string>"))
    return F.concat(have, F.array_except(add, have))


def split_tags(csv: str | None) -> list[str]:
    """Comma-separated shared tags as a list, blanks dropped."""
    return [t.strip(" \t") for t in (csv or "").split(",") if t.strip(" \t")]


def secret_label(c: Column) -> Column:
    """The kind of secret the text holds, or null. A plain search decides whether a pattern is tried at all."""
    out = F.lit(None).cast("string")
    for label, marks, shape in reversed(SECRET_SHAPES):
        marked = F.lit(False)
        for mark in marks:
            marked |= F.contains(c, F.lit(mark))
        out = F.when(marked & c.rlike(shape), F.lit(label)).otherwise(out)
    return out


def metadata_json(capture_mode: Column) -> Column:
    """The metadata blob: `{}` or the capture mode alone."""
    return F.to_json(F.struct(capture_mode.alias("capture_mode")))


def capture_mode_of(metadata: Column) -> Column:
    """The capture mode inside a metadata blob; null when absent or not JSON."""
    return F.get_json_object(metadata, "$.capture_mode")


_INSTANT = (r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{0,9})?([Zz]|[+-]\d{2}:\d{2}(:\d{2})?)$")


def parse_iso(c: Column) -> Column:
    """ISO-8601 instant to timestamp; blank and unparsable give null (see `bad_iso`)."""
    t = clean_text(c)
    return F.when(t.rlike(_INSTANT), F.upper(t).try_cast("timestamp"))


def bad_iso(c: Column) -> Column:
    """True where a non-blank string is not an ISO-8601 instant."""
    t = clean_text(c)
    return F.coalesce((t != "") & parse_iso(c).isNull(), F.lit(False))


def iso(c: Column) -> Column:
    """Timestamp as ISO-8601 in UTC, with milliseconds only when there are any."""
    utc = F.to_utc_timestamp(c, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.unix_millis(c) % 1000 == 0, whole).otherwise(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


# Typographic quotes and their ASCII form.
QUOTES = {
    "‘": "'", "’": "'", "‛": "'", "❛": "'", "❜": "'",
    "“": '"', "‟": '"', "”": '"', "❝": '"', "❞": '"', "〝": '"', "〞": '"',
}

# Entities, decoded one after the other in this order.
ENTITIES = [("&sp;", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
            ("&quot;", '"'), ("&apos;", "'")]


def html_to_text(c: Column) -> Column:
    """Line breaks kept, quotes made ASCII, tags blanked, entities decoded; null gives ''."""
    t = F.regexp_replace(c, r"<br *[^>]*>", "\n")
    t = F.translate(t, "".join(QUOTES), "".join(QUOTES.values()))
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.coalesce(t, F.lit(""))


# Letters and signs with an ASCII spelling of their own.
ASCII_SPELLING = {
    "’": "'", "‘": "'", "‛": "'", "‚": "'",
    "“": '"', "”": '"', "„": '"', "«": "<<", "»": ">>",
    "—": "-", "–": "-", "−": "-",
    "ç": "c", "ß": "ss", "ñ": "n", "ø": "o", "æ": "ae", "œ": "oe",
    "©": "(c)", "®": "(r)", "€": "EUR", "£": "GBP", "¥": "JPY",
    "Æ": "AE", "Œ": "OE", "™": "TM", "¶": "P", "§": "S", "°": "o",
    "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D",
}


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """ASCII spelling of a text: known signs spelled out, accents dropped, the rest removed (Arrow UDF)."""
    spelling = str.maketrans(ASCII_SPELLING)

    def fold(t):
        if t is None or t.isascii():
            return t
        parts = unicodedata.normalize("NFD", t.translate(spelling))
        return parts.encode("ascii", "ignore").decode("ascii")

    return s.map(fold, na_action="ignore")
