"""The `memories` table: columns, types and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMORIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("normalized_text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("importance", T.DoubleType()),
    T.StructField("source_provider", T.StringType()),
    T.StructField("source_client", T.StringType()),
    T.StructField("source_conversation_id", T.StringType()),
    T.StructField("embedding_provider", T.StringType()),
    T.StructField("embedding_model", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("deleted_at", T.TimestampType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("record_version", T.IntegerType()),
    T.StructField("expires_at", T.TimestampType()),
    T.StructField("last_confirmed_at", T.TimestampType()),
    T.StructField("forget_reason", T.StringType()),
    T.StructField("replaced_by_id", T.LongType()),
])

# What a column holds when nothing was given for it.
DEFAULTS = {
    "user_id": "default",
    "importance": 0.5,
    "metadata": "{}",
    "record_version": 1,
}

# Columns that reads hand out: everything but the vector and the internal ones.
READ_COLUMNS = [f.name for f in MEMORIES.fields
                if f.name not in ("embedding", "normalized_text", "user_id", "source_client")]

# Request limits.
MAX_TEXT_CHARS = 16000
MAX_TAG_CHARS = 64
MAX_TAGS = 16
MAX_SESSION_ID_CHARS = 256
MAX_FORGET_REASON_CHARS = 1024
MAX_RESULT_ROWS = 50
MAX_TAG_ROWS = 500
DEFAULT_RECALL_ROWS = 8
DEFAULT_LIST_ROWS = 20
DEDUP_THRESHOLD = 0.90
DEDUP_TOP_K = 5
NEAR_DUP_THRESHOLD = 0.92
NEAR_DUP_TOP_K = 10
NEAR_DUP_GROUPS = 50
MAX_NEAR_DUP_GROUPS = 500


def as_memories(df: DataFrame) -> DataFrame:
    """`df` with exactly the memories columns, defaults standing in for missing columns and nulls."""
    have = set(df.columns)
    out = []
    for f in MEMORIES.fields:
        if f.name in have:
            c = F.col(f.name).cast(f.dataType)
            if f.name in DEFAULTS and f.name != "user_id":      # left bare so that its filters reach the files
                c = F.coalesce(c, F.lit(DEFAULTS[f.name]).cast(f.dataType))
            elif f.name == "tags":
                c = F.coalesce(c, F.array().cast(f.dataType))
        elif f.name == "tags":
            c = F.array().cast(f.dataType)
        elif f.name == "updated_at" and "created_at" in have:
            c = F.col("created_at").cast(f.dataType)
        else:
            c = F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)
