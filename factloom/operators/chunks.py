"""A table of document chunks with vectors: chunk_id, document_id, sequence_number, text, embedding, extra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.search import nearest
from factloom.operators.skew import broadcast_if_small
from factloom.session import cut_lineage

_COLUMNS = {"chunk_id": "string", "document_id": "string", "sequence_number": "int", "text": "string",
            "embedding": "array<float>", "extra": "map<string,string>"}


def upsert_chunks(chunks: DataFrame, points: DataFrame, order: str | None = None) -> DataFrame:
    """Points inserted, or put in the place of the chunk with their id; a null id gets a random one.

    Of several points with one id the last in `order` stays; without it, the last of the request as it is read.
    """
    place = F.col(order) if order else F.monotonically_increasing_id()
    points = points.withColumn("_place", place).withColumn("chunk_id", F.coalesce("chunk_id", F.expr("uuid()")))
    typed = F.struct(*[F.col(n).cast(t).alias(n) for n, t in _COLUMNS.items()])
    points = cut_lineage(points.groupBy("chunk_id").agg(F.max_by(typed, "_place").alias("point")).select("point.*"))
    keep = chunks.join(broadcast_if_small(points.select("chunk_id")), "chunk_id", "left_anti")
    return keep.select(*_COLUMNS).unionByName(points)


def search_chunks(chunks: DataFrame, vector: list[float], limit: int, where: Column | None = None) -> DataFrame:
    """The chunks nearest to `vector` that pass `where`: `chunk_id, document_id, sequence_number, text, score`.

    Equal scores are ordered by document, sequence number and chunk id.
    """
    pool = chunks if where is None else chunks.filter(where)
    key = ["document_id", "sequence_number", "chunk_id"]
    return nearest(pool, vector, limit, [*key, "text"], key).select(*key, "text", "score")


def get_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def delete_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(broadcast_if_small(ids.select("chunk_id").distinct()), "chunk_id", "left_anti")
