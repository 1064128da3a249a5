"""Token ids in directly addressable codes.

A segment holds the ids of whole documents in order. An id is cut into chunks of 8, 8 and 16 bits, least significant first. Level 0
has one chunk for each id; a bitmap tells which ids go on, and those have their next chunk in the level below, in the same
order. A rank directory counts the ones before every 512 bits of a bitmap, so the place of an id's next chunk is one addition and
one short popcount away: any token can be read without decoding its neighbours.

Segments are rows of an uncompressed Parquet table: Spark's committer makes them visible only when the job is done, on any store,
and a lost task writes its rows again. Beside the payload stand a segment's place in its part and its least and largest document, in columns that
Parquet keeps statistics of, so a read by place or by document skips all other segments, and within one only the chunks in question are read.
"""

from __future__ import annotations

import os
import string
import struct
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from factloom.session import shuffle_partitions

WIDTHS = (8, 8, 16)
SEGMENT_TOKENS = 1 << 18      # a segment ends with the first document that reaches this many ids
RANK_BITS = 512
MAGIC = b"DAC1"
END_ID = 1
_WORDS = 600_000              # encoded words a worker remembers
_BYTES = 4 << 20              # of text whose words are looked up together
_PUNCTUATION = string.punctuation.encode()
_TYPES = {8: np.dtype("u1"), 16: np.dtype("<u2")}
_SEGMENT = "part int, seq int, first long, last long, n_docs int, n_tokens long, least_id long, most_id long, payload binary"


def encode_ids(ids: np.ndarray) -> bytes:
    """The directly addressable code of 32-bit ids."""
    rest, parts = ids.astype(np.uint32), []
    for at, width in enumerate(WIDTHS):
        chunk = (rest & np.uint32((1 << width) - 1)).astype(_TYPES[width])
        rest = rest >> np.uint32(width) if at + 1 < len(WIDTHS) else np.zeros(len(rest), np.uint32)
        more = rest > 0
        bits = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS // 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[:len(packed)] = packed
        ones = np.bitwise_count(bits).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
        parts.append((chunk.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes(), len(chunk)))
        rest = rest[more]
    head = MAGIC + struct.pack("<B", len(WIDTHS)) + b"".join(struct.pack("<BQ", w, p[3]) for w, p in zip(WIDTHS, parts))
    return head + b"".join(p[0] + p[1] + p[2] for p in parts)


class Codes:
    """Random access to encoded ids."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        n, at = data[4], 5
        heads = [struct.unpack_from("<BQ", data, at + 9 * k) for k in range(n)]
        at += 9 * n
        self.levels = []
        for width, count in heads:
            kind, blocks = _TYPES[width], -(-count // RANK_BITS)
            chunk = np.frombuffer(data, kind, count, at)
            at += count * kind.itemsize
            bits = np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", blocks + 1, at)
            at += 4 * (blocks + 1)
            self.levels.append((width, chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][1])

    def _rank(self, level: int, i: int) -> int:
        """How many entries before entry i go on."""
        _, _, bits, ranks = self.levels[level]
        block = i // RANK_BITS
        lo = block * RANK_BITS // 8
        inside = int(np.bitwise_count(bits[lo:i // 8]).sum())
        rest = i % 8
        if rest:
            inside += (int(bits[i // 8]) & ((1 << rest) - 1)).bit_count()
        return int(ranks[block]) + inside

    def token(self, i: int) -> int:
        """The i-th id alone."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for level, (width, chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[i]) << shift
            shift += width
            if not int(bits[i // 8]) >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """The ids of positions lo to hi, of which only the chunks in question are read."""
        return self._range(0, lo, hi)

    def _range(self, level: int, lo: int, hi: int) -> np.ndarray:
        width, chunk, bits, _ = self.levels[level]
        out = chunk[lo:hi].astype(np.uint32)
        if lo >= hi or level + 1 == len(self.levels):
            return out
        more = np.unpackbits(bits[lo // 8:-(-hi // 8)], bitorder="little")[lo % 8:lo % 8 + hi - lo].astype(bool)
        if more.any():
            first = self._rank(level, lo)
            out[more] |= self._range(level + 1, first, first + int(more.sum())) << np.uint32(width)
        return out


class Segment:
    """Documents of one segment: ids (None for null), starts inside the segment, and their tokens."""

    def __init__(self, payload: bytes) -> None:
        (n,) = struct.unpack_from("<Q", payload)
        keys = np.frombuffer(payload, "<i8", n, 8)
        known = np.frombuffer(payload, np.uint8, n, 8 + 8 * n)
        self.doc_ids = [int(k) if x else None for k, x in zip(keys, known)]
        self.starts = np.frombuffer(payload, "<u8", n + 1, 8 + 9 * n)
        self.codes = Codes(payload[8 + 9 * n + 8 * (n + 1):])

    def document(self, k: int) -> np.ndarray:
        return self.codes.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def pack_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    sizes = np.array([len(x) // 4 for x in ids], np.uint64)
    starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes, dtype=np.uint64)])
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return (struct.pack("<Q", len(doc_ids)) + keys.tobytes() + known.tobytes() + starts.astype("<u8").tobytes()
            + encode_ids(np.frombuffer(b"".join(ids), "<u4")))


class Encoder:
    """Ids of whole texts. This tokenizer never joins what ASCII white space parts, nor a letter and the ASCII punctuation after it, and it ignores case.
    So a text's ids are those of its words in order, and of a word those of its letters and its closing punctuation. Each is
    encoded once and remembered."""

    @staticmethod
    def of_process(tokenizer_path: str) -> Encoder:
        """The encoder that all tasks of a worker process share. Task code travels by value and forgets its globals with each task; a module entry stays."""
        kept = sys.modules.setdefault("_token_encoders", ModuleType("_token_encoders"))
        if tokenizer_path not in vars(kept):
            setattr(kept, tokenizer_path, Encoder(tokenizer_path))
        return vars(kept)[tokenizer_path]

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.codes = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers, `end_id` last. Null is empty."""
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
        lo = 0
        while lo < len(texts):                   # a part has some megabytes of text, or one text
            limit = (ends[lo - 1] if lo else 0) + _BYTES
            hi = max(lo + 1, int(np.searchsorted(ends, limit, side="right")))
            yield from self._encode(pc.fill_null(texts.slice(lo, hi - lo), ""), struct.pack("<I", end_id))
            lo = hi

    def _encode(self, texts: pa.Array, end: bytes) -> Iterator[bytes]:
        if len(self.known) > _WORDS:
            self.known, self.parts = {}, {}
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.binary()).to_pylist()
        self._learn([w for w in words if w not in self.known])
        coded = [self.known[w] for w in words]
        ids, sizes = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        starts, at = np.cumsum(sizes) - sizes, numbered.indices.to_numpy(zero_copy_only=False)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        many = sizes[at]
        before = np.concatenate([[0], np.cumsum(many)])
        places = np.repeat(starts[at] - before[:-1], many) + np.arange(before[-1])
        found, cut = ids[places].tobytes(), (4 * before[bounds]).tolist()
        for first, last in zip(cut, cut[1:]):
            yield found[first:last] + end

    def _learn(self, new: list[bytes]) -> None:
        """Add words to those known: letters and closing punctuation apart, anything else as a whole."""
        known, parts, whole, keys, closings = self.known, self.parts, set(), [], []
        for word in new:
            letters = word.rstrip(_PUNCTUATION)      # an empty word, before leading space, has no ids
            if letters.isalpha():                # ASCII letters alone: one word to the tokenizer, and lower case is all it changes
                key = letters.lower()
                if key not in parts:
                    parts[key] = b"".join([self.codes[t.id] for t in self.model.tokenize(key.decode())])
            else:
                key = letters
                if not key.decode().lower().isalpha():      # digits, signs inside, letters that part in lower case
                    key = letters = word
                if key not in parts:
                    whole.add(key)
            closing = word[len(letters):]
            if closing and closing not in parts:
                whole.add(closing)
            keys.append(key)
            closings.append(closing)
        rest = list(whole)
        for key, found in zip(rest, self.tokenizer.encode_batch_fast([k.decode() for k in rest], add_special_tokens=False)):
            parts[key] = b"".join([self.codes[i] for i in found.ids])
        for word, key, closing in zip(new, keys, closings):
            known[word] = parts[key] + parts[closing] if closing else parts[key]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write the ids of every whole text, each followed by `end_id`, in ascending order of the ids of the documents.

    Null ids come first; rows with one id are ordered by their texts' hashes, and each is a document. A null or empty
    text has the end id only. No column but the two named ones is read. An empty table gives no segments.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.asc_nulls_first("id"), F.asc_nulls_first("of")]
    dealt = (rows.withColumn("of", F.xxhash64("text")).repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
             .sortWithinPartitions(*order).select("id", "text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"         # the task's own core only
        encoder, part = Encoder.of_process(tokenizer_path), TaskContext.get().partitionId()
        held_ids, held, size, seq, first = [], [], 0, 0, 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1), end_id)):
                held_ids.append(doc)
                held.append(ids)
                size += len(ids) // 4
                if size >= segment_tokens:
                    yield _row(part, seq, first, held_ids, held, size)
                    held_ids, held, size, seq, first = [], [], 0, seq + 1, first + size
        if held:
            yield _row(part, seq, first, held_ids, held, size)

    dealt.mapInArrow(segments, _SEGMENT).write.option("compression", "none").parquet(path)


def _row(part: int, seq: int, first: int, doc_ids: list, ids: list[bytes], size: int) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    known = [d for d in doc_ids if d is not None]
    values = (part, seq, first, first + size, len(doc_ids), size, min(known, default=None), max(known, default=None), pack_segment(doc_ids, ids))
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [x.split()[0] for x in _SEGMENT.split(", ")])


def _bases(files: DataFrame) -> DataFrame:
    """`part, base`: how many ids stand before each part; a row per part."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")


def read_range(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """`place, token` of the places from `lo` to before `hi` in the whole id sequence. Only segments that hold some of them are read."""
    files = spark.read.schema(_SEGMENT).parquet(path)
    asked = [(r.part, r.base) for r in _bases(files).filter((F.col("base") < hi) & (F.col("base") + F.col("n") > lo)).collect()]     # parts, not ids
    hit = F.lit(False)
    for part, base in asked:
        hit = hit | ((F.col("part") == part) & (F.col("first") < hi - base) & (F.col("last") > lo - base))
    bases = dict(asked)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                start, codes = bases[part] + first, Segment(payload.as_py()).codes
                a, b = max(lo - start, 0), min(hi - start, len(codes))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start + a, start + b)), pa.array(codes.tokens(a, b).astype(np.int64))], ["place", "token"])

    return files.filter(hit).select("part", "first", "payload").mapInArrow(tokens, "place long, token long")


def document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """`ids` of the document (a row for each row that had this id), its end id included."""
    files = spark.read.schema(_SEGMENT).parquet(path).filter((F.col("least_id") <= doc_id) & (F.col("most_id") >= doc_id))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                s = Segment(payload.as_py())
                found = [s.document(k).astype(np.int64) for k, d in enumerate(s.doc_ids) if d == doc_id]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["ids"])

    return files.select("payload").mapInArrow(ids, "ids array<long>")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document, from the files: its place among all ids, its number of ids and their
    crc32 as little-endian 32-bit integers."""
    files = spark.read.schema(_SEGMENT).parquet(path)
    placed = files.join(F.broadcast(_bases(files)), "part").select((F.col("base") + F.col("first")).alias("start"), "payload")      # one row per part

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Segment(payload.as_py())
                places = s.starts.astype(np.int64)
                sums = [zlib.crc32(s.document(k).astype("<u4").tobytes()) for k in range(len(s.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(places[:-1] + start), pa.array(np.diff(places)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
