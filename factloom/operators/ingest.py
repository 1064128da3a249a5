"""From documents to facts: chunking, extraction, loading."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.errors import INVALID_INPUT, RequestError, expected
from factloom.functions.text import merge_tags
from factloom.operators.prepare import EmbeddingProvider
from factloom.operators.remember import Remembered, remember_batch
from factloom.session import cut_lineage

_SENTENCE_END = re.compile(r"[.!?](?=[ \n])")
SOURCE_LABEL = "factloom/teach"
PASS_BYTES = 4 << 20      # of text that a worker holds as Python strings, or puts out, at once


def cut_points(text: str, size: int) -> list[tuple[int, int]]:
    """Spans of at most about `size` chars: each ends after the last blank line in the second half of
    its window, else after the last sentence end there, else at `size`."""
    spans, start, total = [], 0, len(text)
    while start < total:
        end = min(start + size, total)
        if end < total:
            half = start + size // 2
            blank = text.rfind("\n\n", half, min(end + 1, total - 1))
            if blank >= 0:
                end = blank + 2
            else:
                last = None
                for last in _SENTENCE_END.finditer(text, half + 1, min(end + 2, total)):
                    pass
                if last is not None:
                    end = last.start() + 2
        spans.append((start, end))
        start = end
    return spans


def _in_passes(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PASS_BYTES of text; a longer text is a slice of its own."""
    sizes = np.asarray(pc.binary_length(batch.column(text_col)).fill_null(0)).astype(np.int64)
    lo, held = 0, 0
    for hi, size in enumerate(sizes.tolist()):
        if hi > lo and held + size > PASS_BYTES:
            yield batch.slice(lo, hi - lo)
            lo, held = hi, 0
        held += size
    if lo < batch.num_rows:
        yield batch.slice(lo)


def chunk_documents(docs: DataFrame, size: int = 4000, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, seq, text`: each whole document in chunks of about `size` chars, blank chunks dropped."""
    if not 500 <= size <= 32000:
        raise RequestError(INVALID_INPUT, expected("chunk size", "a number from 500 to 32000", size))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_passes(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    pieces = (text[a:b].lstrip("\n \t\r") for a, b in cut_points(text or "", size))
                    rows += [(doc, i, p) for i, p in enumerate(p for p in pieces if p)]
                docs_, seqs, texts = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(docs_, part.schema.field("doc_id").type), pa.array(seqs, pa.int32()),
                                                  pa.array(texts, pa.string())], ["doc_id", "seq", "text"])

    doc_type = docs.schema[doc_col].dataType.simpleString()
    pairs = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(chunk, f"doc_id {doc_type}, seq int, text string")


def split_lines(text: str) -> str:
    """A stand-in extractor that needs no model: every non-blank line is a fact tagged `line`."""
    return json.dumps({"facts": [{"text": t.strip(), "tags": ["line"]} for t in text.split("\n") if t.strip()]})


def run_extractor(chunks: DataFrame, extractor: Callable[[str], str]) -> DataFrame:
    """`chunks` with `response`, the extractor's JSON; null where the call failed."""
    def one(text: str | None) -> str | None:
        try:
            return extractor(text)
        except Exception:       # a failing call costs its chunk only
            return None

    names = [*chunks.columns, "response"]

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_passes(batch, "text"):
                answers = pa.array([one(t) for t in part.column("text").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, answers], names)

    return chunks.mapInArrow(call, T.StructType([*chunks.schema.fields, T.StructField("response", T.StringType())]))


def facts_of(response: Column) -> Column:
    """The fact objects of a response, `{"facts": [...]}` or a bare array; null for any other shape."""
    doc = F.try_parse_json(response)
    kind = F.schema_of_variant(doc)
    inner = F.try_variant_get(doc, "$.facts", "array<variant>")
    return F.when(kind.startswith("OBJECT"), inner).when(kind.startswith("ARRAY"),
                                                         F.try_variant_get(doc, "$", "array<variant>"))


def extract_facts(chunks: DataFrame, extractor: Callable[[str], str], extra_tags: list[str] | None = None,
                  max_facts: int | None = None) -> DataFrame:
    """`doc_id, seq, pos, text, tags`: the facts of each chunk, in order.

    Facts whose text is blank or not a string are dropped; a failing chunk gives none (see
    `failed_chunks`). With `max_facts` the first ones by document, chunk and position are kept.
    """
    return extract(chunks, extractor, extra_tags, max_facts).facts


class Extracted(NamedTuple):
    facts: DataFrame        # doc_id, seq, pos, text, tags
    failed: DataFrame       # doc_id, seq of chunks whose call failed or whose answer has no list of facts


def extract(chunks: DataFrame, extractor: Callable[[str], str], extra_tags: list[str] | None = None,
            max_facts: int | None = None) -> Extracted:
    """Facts and failures of one pass: every chunk is sent once, and its answer is written down before anything reads it."""
    answered = cut_lineage(run_extractor(chunks, extractor))
    failed = answered.filter(facts_of(F.col("response")).isNull()).select("doc_id", "seq")
    raw = answered.select("doc_id", "seq", F.posexplode(facts_of(F.col("response"))).alias("pos", "fact"))
    text = F.when(F.schema_of_variant(F.try_variant_get("fact", "$.text", "variant")) == "STRING",
                  F.try_variant_get("fact", "$.text", "string"))
    tags = F.try_variant_get("fact", "$.tags", "array<string>")
    facts = raw.select("doc_id", "seq", "pos", text.alias("text"), merge_tags(tags, extra_tags or []).alias("tags"))
    facts = facts.filter(F.coalesce("text", F.lit("")) != "")
    return Extracted(facts if max_facts is None else facts.orderBy("doc_id", "seq", "pos").limit(max_facts), failed)


def failed_chunks(chunks: DataFrame, extractor: Callable[[str], str]) -> DataFrame:
    """`n`: chunks whose call failed or whose answer has no list of facts. Use `extract` for facts and failures of one pass."""
    return extract(chunks, extractor).failed.agg(F.count(F.lit(1)).alias("n"))


def as_items(facts: DataFrame, provider_label: str = SOURCE_LABEL) -> DataFrame:
    """Facts as remember items, `input_index` rising with document, chunk and position.

    The global sort leaves the parts in order, so numbers that rise along the parts keep the
    order without counting; the result is written down so that they stay the same.
    """
    placed = facts.orderBy("doc_id", "seq", "pos").withColumn("input_index", F.monotonically_increasing_id())
    return cut_lineage(placed.select("input_index", "text", "tags", F.lit(provider_label).alias("source_provider"),
                                     "doc_id", "seq", "pos"))


def load_facts(memories: DataFrame, facts: DataFrame, as_of, provider: EmbeddingProvider, *,
               user_id: str = "default", policy: str = "skip_if_near", dry_run: bool = False) -> Remembered:
    """Remember all facts; near duplicates are skipped unless another policy is given.

    The results name the fact (doc_id, seq, pos). A dry run tells what would become of each fact and gives no rows to insert.
    """
    items = as_items(facts)
    done = remember_batch(memories, items, as_of, provider, user_id=user_id, default_policy=policy)
    results = done.results.join(items.select("input_index", "doc_id", "seq", "pos"), "input_index")
    return Remembered(lambda: done.inserted.filter("false") if dry_run else done.inserted, results)
