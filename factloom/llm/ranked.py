"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature holds a key for every term it has and every power of two that the term's frequency reaches. Documents of like
size share a block, stored slice by slice: one bitmap over the documents of the block for every bit of the signatures. A
term is looked up by the intersection of its slices, which holds every document that has it, and by chance others. So frequencies are only ever
overestimated, and the weighted sum over an item's terms is an upper bound of every document's score.

The best twenty bounds of each item are scored exactly first; the twentieth of those scores is a floor. Every document whose bound reaches the floor
is then scored exactly, so none that could be among the twenty is left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from factloom.operators.skew import broadcast_if_small, running_sums
from factloom.session import cut_lineage, scratch_path

TOP = 20
HASHES = 3               # bits that a key sets
BITS = 8                 # of a signature for every key it can hold: a strange key seems present with a chance below 1/30
BLOCK_CELLS = 1 << 21    # bits of a block: documents by signature length
BATCH_TERMS = 1 << 14    # distinct terms of the items that are searched at a time
_DICTIONARY = 200_000    # terms counted in a task before they are put out
_SEED = 7
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_INDEX = "capacity int, levels int, ids array<long>, ofs array<long>, sizes array<long>, slices binary, terms array<binary>, dfs array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in order: letters, digits and everything beyond ASCII, only A-Z lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = found = xxh64_intdigest(term, _SEED)
        return found


def _level_keys(hashes: np.ndarray, level: int) -> np.ndarray:
    x = (hashes + np.full(1, level, np.uint64) * _ODD[0]) * _ODD[2]       # arrays wrap around
    return (x ^ (x >> np.uint64(31))) * _ODD[1]


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits that keys set, one row for each hash."""
    shift = np.uint64(64 - bits.bit_length() + 1)
    return np.stack([(keys * odd >> shift).astype(np.int64) for odd in _ODD[:HASHES]])


def _signature(counts: Counter, hashes: _Hashes) -> tuple[np.ndarray, int]:
    h = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts))
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    keys, level = [_level_keys(h, 0)], 1
    while len(more := h[tf >= 1 << level]):
        keys.append(_level_keys(more, level))
        level += 1
    return np.concatenate(keys), level


def _block_docs(capacity: int) -> int:
    return max(8, min(4096, BLOCK_CELLS // (BITS * capacity)))


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the signatures of all documents that have terms, and per task the number of documents of each term.

    Every row of `docs` is a document, repeated rows and null ids included; a null, empty or termless text is none. A very long
    text is a signature of its own length. No column but the two named ones is read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("of"), F.col(text_col).cast("binary").alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        held, hashes = Counter(), _Hashes()
        for batch in batches:
            for doc, of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                counts = Counter(found)
                held.update(counts.keys())
                keys, levels = _signature(counts, hashes)
                capacity = max(16, 1 << (len(keys) - 1).bit_length())
                block = open_.setdefault(capacity, [])
                block.append((doc, of, len(found), keys, levels))
                if len(block) == _block_docs(capacity):
                    yield _block(capacity, open_.pop(capacity))
                if len(held) > _DICTIONARY:
                    yield _dictionary(held)
                    held, hashes = Counter(), _Hashes()
        for capacity, block in open_.items():
            yield _block(capacity, block)
        if held:
            yield _dictionary(held)

    rows.mapInArrow(blocks, _INDEX).write.parquet(path)


_KINDS = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS)], _NAMES)


def _block(capacity: int, docs: list[tuple]) -> pa.RecordBatch:
    bits = BITS * capacity
    cells = np.zeros((bits, len(docs)), bool)
    for at, (_, _, _, keys, _) in enumerate(docs):
        cells[_places(keys, bits).ravel(), at] = True
    ids, ofs, sizes, _, levels = zip(*docs)
    return _row(capacity, max(levels), ids, ofs, sizes, np.packbits(cells, axis=1, bitorder="little").tobytes(), None, None)


def _dictionary(held: Counter) -> pa.RecordBatch:
    return _row(0, 0, None, None, None, None, list(held), list(held.values()))


class _Batch:
    """Items that are searched together: their distinct terms with weights, and per item the places and summed weights of its terms."""

    def __init__(self, terms: list[bytes], weights: dict[bytes, int], items: list[list[tuple[bytes, int]]], n_docs: int, n_terms: int) -> None:
        at = {t: i for i, t in enumerate(terms)}
        self.n_docs, self.n_terms = n_docs, n_terms
        self.hashes = np.array([xxh64_intdigest(t, _SEED) for t in terms], np.uint64)
        self.items = [(np.array([at[t] for t, _ in own], np.int64), np.array([weights[t] * k for t, k in own], np.float64)) for own in items]
        self.exact = [[(t, weights[t] * k) for t, k in own] for own in items]

    def length_part(self, sizes):
        """Twelve times a document's m."""
        return 12 * (75 + 25 * sizes * self.n_docs // self.n_terms)

    def bounds(self, capacity: int, levels: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bounds of the scores, items by documents. All numbers are integers below 2^53, so the sums are exact."""
        n, bits = len(sizes), BITS * capacity
        table = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        out, part, before = np.zeros((len(self.items), n)), self.length_part(sizes), np.zeros(n, np.int64)
        seen = None
        for level in range(levels):
            found = np.bitwise_and.reduce(table[_places(_level_keys(self.hashes, level), bits)], axis=0)
            seen = found if seen is None else seen & found
            if not seen.any():
                break
            present = np.unpackbits(seen, axis=1, count=n, bitorder="little").astype(np.float64)
            most = (2 << level) - 1                     # a document without the next key has the term at most so often
            upto = 1_000_000_000 * most // (1000 * most + part)
            for row, (places, weights) in zip(out, self.items):
                row += (weights @ present[places]) * (upto - before)
            before = upto
        return out

    def score(self, item: int, counts: Counter, size: int) -> int:
        part = self.length_part(size)
        return sum(w * (1_000_000_000 * tf // (1000 * tf + part)) for t, w in self.exact[item] if (tf := counts.get(t)))


def search(docs: DataFrame, items: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", top: int = TOP, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """`item_id, rank, id, score`: each item's `top` best documents with a score above zero, equal scores by ascending id (null last).

    `path` is the index of the same documents. Items with the same id and text are one; items that share an id only are ranked
    apart. An item without known terms has no rows. Items are searched in batches of about `batch_terms` terms, so what a task gets is bounded; a
    single larger item is a batch of its own. Documents that share id and text are ranked one by one.
    """
    spark = docs.sparkSession
    index = spark.read.schema(_INDEX).parquet(path)
    totals = index.filter("capacity > 0").agg(F.sum(F.size("sizes")).alias("n"),
                                              F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    asked = _items(items, item_col, item_text, batch_terms)
    found = [_search_batch(docs, index, asked.filter(F.col("batch") == b.batch), totals.n or 0, totals.l or 1, id_col, text_col, top)
             for b in asked.select("batch").distinct().collect()]
    if not found:
        return spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _items(items: DataFrame, item_col: str, item_text: str, batch_terms: int) -> DataFrame:
    """`q, item_id, text, batch`: numbered items that have terms; a batch is filled until it holds `batch_terms` terms."""
    sizes = F.arrow_udf(lambda texts: pa.array([len(set(terms_of(t))) for t in texts.to_pylist()], pa.int64()), "long")
    rows = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("binary").alias("text")).distinct()
    rows = rows.withColumn("size", sizes("text")).filter("size > 0").withColumn("one", F.lit(1).cast("long"))
    placed = running_sums(rows, [F.asc_nulls_first("item_id"), "text"], {"upto": "size", "q": "one"})
    return cut_lineage(placed.select("q", "item_id", "text", F.floor((F.col("upto") - 1) / batch_terms).alias("batch")))


def _search_batch(docs: DataFrame, index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, id_col: str, text_col: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.orderBy("q").collect()                  # bounded by the batch
    own = [list(Counter(terms_of(bytes(r.text))).items()) for r in rows]
    terms = sorted({t for item in own for t, _ in item})
    wanted = spark.createDataFrame([(t,) for t in terms], "term binary")
    counted = (index.filter("capacity = 0").select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), "x.dfs")
               .join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("dfs").alias("df")))
    df = {bytes(r.term): r.df for r in counted.collect()}
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    batch = _Batch(list(weights), weights, [[(t, k) for t, k in item if t in weights] for item in own], n_docs, n_terms)
    blocks = index.filter("capacity > 0").select("capacity", "levels", "sizes", "slices", "ids", "ofs")

    best = blocks.mapInArrow(lambda parts: _best_bounds(parts, batch, top), "q int, id long, of long, bound double")
    first = W.partitionBy("q").orderBy(F.desc("bound"), "id", "of")
    best = best.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= top)
    tried = _scored(docs, cut_lineage(best.select("q", "id", "of").distinct()), batch, id_col, text_col)
    floors = [1.0] * len(rows)
    for r in tried.groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores")).collect():     # top scores of each item
        if len(r.scores) >= top:
            floors[r.q] = float(max(1, r.scores[top - 1]))
    may = blocks.mapInArrow(lambda parts: _reaching(parts, batch, floors), "q int, id long, of long")
    scored = _scored(docs, cut_lineage(may.distinct()), batch, id_col, text_col).filter("score > 0")
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "of")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    named = asked.select("item_id", (F.row_number().over(W.orderBy("q")) - 1).alias("q"))        # the batch's items only
    return cut_lineage(ranked.join(F.broadcast(named), "q").select("item_id", "rank", "id", "score"))


def _each_block(batches: Iterator[pa.RecordBatch], batch: _Batch) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    for part in batches:
        for i in range(part.num_rows):
            capacity, levels, sizes, slices, ids, ofs = (column[i] for column in part.columns)
            sizes = sizes.values.to_numpy()
            yield batch.bounds(capacity.as_py(), levels.as_py(), sizes, slices.as_buffer()), ids.values, ofs.values


def _best_bounds(batches: Iterator[pa.RecordBatch], batch: _Batch, top: int) -> Iterator[pa.RecordBatch]:
    """The documents with the best bounds of every item in this task."""
    held = [[] for _ in batch.items]
    for bounds, ids, ofs in _each_block(batches, batch):
        ids, ofs = ids.to_pylist(), ofs.to_pylist()
        cut = min(top, len(ids))
        best = np.argpartition(-bounds, cut - 1, axis=1)[:, :cut]
        for own, row, places in zip(held, bounds, best):
            own.extend((row[k], ids[k], ofs[k]) for k in places.tolist() if row[k] > 0 and (len(own) < top or row[k] > own[-1][0]))
            own.sort(key=lambda x: -x[0])
            del own[top:]
    rows = [(q, doc, of, bound) for q, own in enumerate(held) for bound, doc, of in own]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.float64()))], ["q", "id", "of", "bound"])


def _reaching(batches: Iterator[pa.RecordBatch], batch: _Batch, floors: list[float]) -> Iterator[pa.RecordBatch]:
    """Every document whose bound reaches the floor of an item."""
    least = np.array(floors)[:, None]
    for bounds, ids, ofs in _each_block(batches, batch):
        q, k = np.nonzero(bounds >= least)
        if len(q):
            at = pa.array(k)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), ids.take(at), ofs.take(at)], ["q", "id", "of"])


def _scored(docs: DataFrame, pairs: DataFrame, batch: _Batch, id_col: str, text_col: str) -> DataFrame:
    """`q, id, of, score`: exact scores of pairs of item and document, from the whole texts."""
    wanted = cut_lineage(pairs.groupBy(F.col("id").alias("_id"), F.col("of").alias("_of")).agg(F.collect_list("q").alias("qs")))   # at most the batch's items
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(broadcast_if_small(wanted), F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_of")))
    rows = rows.select("id", F.col("_of").alias("of"), F.col("text").cast("binary").alias("text"), "qs")

    def exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for doc, of, text, qs in zip(*(c.to_pylist() for c in part.columns)):
                found = terms_of(text)
                counts = Counter(found)
                out += [(q, doc, of, batch.score(q, counts, len(found))) for q in qs]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                                 ["q", "id", "of", "score"])

    return cut_lineage(rows.mapInArrow(exact, "q int, id long, of long, score long"))


def rank(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Index the documents in the shared folder and search them for all items: `item_id, rank, id, score`."""
    path = scratch_path(docs.sparkSession, "signatures")
    build_index(docs, path)
    return search(docs, items, path)


SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS k FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
