"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

Of the suffixes of a text only those count that a window of `LENGTH` bytes selects: the one whose first `GRAM` bytes hash least in that window, the
leftmost of equals. A repeated string of `LENGTH` bytes selects the same suffix wherever it stands, so suffixes without a partner need no further look. A
suffix stands in the array by the hash of its first `GRAM` bytes: two suffixes meet when they agree on those.

New batches of documents get an array of their own. The array is scanned against every level of the family for suffixes that both
hold; levels of equal size merge with it, as digits carry in a counter, so a suffix is merged as often as the logarithm of the number of batches.

The windows that select one and the same suffix are its region. Equal regions are repeated as a whole; different regions with a common
suffix are compared window by window, in one task if few and else dealt by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from factloom.operators.skew import join_unique
from factloom.session import cut_lineage, shuffle_partitions

LENGTH = 200
GRAM = 32                   # bytes; a power of two below LENGTH
BATCHES = 4
TASK_REGIONS = 4096         # different regions of a suffix (a few hundred bytes each) that one task compares
_ROWS = 2048                # regions whose windows are hashed together
_PART = 1 << 20             # positions of a long text hashed at a time
_PLACE = np.uint64(24)      # low bits of a hash that give way to the place in the part
_RNG = np.random.default_rng(1)
_BYTE_CODES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size` bytes of `data`: of halves, quarters and so on, and of two overlapping powers of two if `size` is none."""
    h, n, step = _BYTE_CODES[data], 1, 0
    while 2 * n <= size:
        h = h[:len(h) - n] * _STEPS[step] + h[n:]
        h ^= h >> np.uint64(29)
        n, step = 2 * n, step + 1
    if n < size:
        h = h[:len(h) - (size - n)] * _STEPS[step] + h[size - n:]
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = 1
    while n < width:
        step = min(n, width - n)
        keys = np.minimum(keys[:len(keys) - step], keys[step:])
        n += step
    return keys


def selected(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The selected suffixes of a text: their hash, and the first and the last-but-one window of `length` bytes that selects each."""
    found = [[], [], []]
    whole = np.frombuffer(data, np.uint8)
    for lo in range(0, len(data) - length + 1, _PART):
        part = whole[lo:lo + _PART + length - 1]
        h = window_hashes(part, gram)
        keyed = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
        at = (_least(keyed, length - gram + 1) & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        for store, x in zip(found, (h[at[first]], first + lo, np.append(first[1:], len(at)) + lo)):
            store.append(x)
    if not found[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in found)


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the spans cover; touching spans are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, upto = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > upto[:-1]])
    return starts[new], upto[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


_SUFFIXES = "id long, of long, g long, region long, start long, n int, times int"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
_NAMES = [x.split()[0] for x in _SUFFIXES.split(", ")]
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The selected suffixes of all texts (`id, of, text`): `g` the hash that they meet by, `region` the hash of their region, `start` and `n` its first
    window and number of windows, `times` how often the document has it. What repeats within the document is said in rows without
    `g`: `start` and `n` are a repeated span then, so a run of one byte is not a suffix for each byte."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_py()
                g, lo, hi = selected(data, length, gram)
                if not len(g):
                    continue
                region = np.array([xxh3_64_intdigest(data[a:b + length - 1]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64)
                _, one, back, times = np.unique(np.stack([g, region]), axis=1, return_index=True, return_inverse=True, return_counts=True) if len(g) > 1 else (
                    None, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))
                again = times[back.ravel()] > 1
                a, b = _spans(lo[again], hi[again] + length - 1)
                none = [None] * len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(([doc] * (len(one) + len(a)), [of] * (len(one) + len(a)),
                     g[one].view(np.int64).tolist() + none, region[one].view(np.int64).tolist() + none,
                     np.concatenate([lo[one], a]), np.concatenate([(hi - lo)[one], b - a]), np.concatenate([times, np.ones(len(a), np.int64)])), _KINDS)], _NAMES)

    return docs.select("id", "of", F.col("text").cast("binary").alias("text")).mapInArrow(rows, _SUFFIXES)


class SuffixLevels:
    """The family: levels of sorted suffix arrays, each twice as many batches as the one after it. `add` takes new suffixes."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Take the suffixes (`g, times`) of new documents in; `g` of all that they share with earlier ones or among themselves."""
        rank, parts = 0, [batch.groupBy("g").agg(F.sum("times").alias("times"))]
        while self.levels and self.levels[-1][0] == rank:
            parts.append(self.levels.pop()[1].select("g", F.lit(1).cast("long").alias("times")))
            rank += 1
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        if len(parts) > 1:
            merged = merged.groupBy("g").agg(F.sum("times").alias("times"))
        array = cut_lineage(merged.sortWithinPartitions("g"))
        found = array.filter("times > 1").select("g")
        for _, level in self.levels:
            found = found.unionByName(level.select("g").hint("merge").join(array.select("g"), "g", "left_semi"))
        self.levels.append((rank, array.select("g")))
        return cut_lineage(found)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, task_regions: int = TASK_REGIONS) -> DataFrame:
    """`id, of, lo, hi`: spans of bytes of the rows `id, of, text` that together cover every string of `length` bytes which also starts anywhere else."""
    every = cut_lineage(suffixes(docs, length, gram))
    marked, family, met = every.filter("g is not null"), SuffixLevels(), None
    for k in range(batches):
        found = family.add(marked.filter(F.pmod(F.xxhash64("id", "of"), F.lit(batches)) == k).select("g", "times"))
        met = found if met is None else met.unionByName(found)
    met = cut_lineage(met.distinct())
    rows = cut_lineage(marked.join(met, "g", "left_semi"))

    held = F.struct("id", "of", "start").alias("at")
    regions = cut_lineage(rows.groupBy("g", "region", "n").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"), F.min(held).alias("at")))
    kinds = regions.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 and least = 1")
    mixed = regions.join(cut_lineage(kinds.select("g", "kinds")), "g")         # regions are few beside their rows: copies of one are one
    part = _window_spans(docs, mixed, length, task_regions)
    whole = regions.filter("times > 1").select("g", "region", "n", "rows", F.array(F.struct(F.lit(0).alias("lo"), (F.col("n") + (length - 1)).alias("hi"))).alias("spans"))
    spans = part.join(regions.select("g", "region", "n", "rows"), ["g", "region", "n"]).select("g", "region", "n", "rows", "spans")
    spans = cut_lineage(whole.unionByName(spans))
    placed = join_unique(rows.withColumn("_row", F.pmod(F.xxhash64("id", "of", "start"), F.lit(1 << 40))), spans, ["g", "region", "n"], "_row", weight="rows", small=0)
    placed = placed.filter("spans is not null").select("id", "of", "start", F.explode("spans").alias("s"))
    return (placed.select("id", "of", (F.col("start") + F.col("s.lo")).alias("lo"), (F.col("start") + F.col("s.hi")).alias("hi"))
            .unionByName(every.filter("g is null").select("id", "of", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))))


def _window_spans(docs: DataFrame, mixed: DataFrame, length: int, task_regions: int) -> DataFrame:
    """`g, region, n, spans`: what is repeated of regions that stand once, beside other regions of their suffix."""
    spark = docs.sparkSession
    wanted = mixed.groupBy(F.col("at.id").alias("_id"), F.col("at.of").alias("_of")).agg(
        F.collect_list(F.struct("g", "region", "n", "times", "kinds", F.col("at.start").alias("start"))).alias("parts"))      # of one text
    rows = docs.join(cut_lineage(wanted), F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_of")))
    cut = rows.select(F.col("text").cast("binary").alias("text"), F.explode("parts").alias("p")).select("text", "p.*")
    cut = cut.select("g", "region", "n", "times", "kinds", F.expr(f"substring(text, cast(start + 1 as int), n + {length - 1})").alias("data"))
    cut = cut_lineage(cut)                # rows that repeat id and text give a region more than once

    def in_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _groups(parts):
            yield _compare(groups, length)

    few = cut.filter(F.col("kinds") <= task_regions).select("g", "region", "n", "times", "data")
    few = few.repartition(shuffle_partitions(spark), "g").sortWithinPartitions("g")
    spans = "array<struct<lo:int,hi:int>>"
    found = few.mapInArrow(in_task, f"g long, region long, n int, spans {spans}")

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for g, region, n, times, data in zip(*(c.to_pylist() for c in part.columns)):
                w = window_hashes(np.frombuffer(data, np.uint8), length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([g] * n), pa.array([region] * n), pa.array([n] * n, pa.int32()), pa.array([times] * n, pa.int64()),
                                                  pa.array(np.arange(n, dtype=np.int32)), pa.array(w)], ["g", "region", "n", "times", "at", "w"])

    many = cut.filter(F.col("kinds") > task_regions).dropDuplicates(["g", "region", "n"]).select("g", "region", "n", "times", "data")
    dealt = cut_lineage(many.mapInArrow(windows, "g long, region long, n int, times long, at int, w long"))
    counts = cut_lineage(dealt.groupBy("g", "w").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    again = join_unique(dealt.filter("times = 1").withColumn("_row", F.pmod(F.xxhash64("region", "at"), F.lit(1 << 40))), counts, ["g", "w"], "_row",
                        weight="rows", small=0)
    again = again.filter("rows is not null").groupBy("g", "region", "n").agg(F.sort_array(F.collect_list("at")).alias("ats"))     # of one region
    single = F.transform("ats", lambda a: F.struct(a.alias("lo"), (a + length).alias("hi"))).cast(spans)
    return cut_lineage(found.unionByName(again.select("g", "region", "n", single.alias("spans"))))


def _groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by `g`, whole groups together, about _ROWS at a time."""
    held: pa.Table | None = None
    for part in parts:
        new = pa.Table.from_batches([part])
        held = new if held is None else pa.concat_tables([held, new])
        starts = np.flatnonzero(np.diff(held.column("g").to_numpy())) + 1
        if held.num_rows >= _ROWS and len(starts):          # the last group may go on in the next batch
            yield held.slice(0, int(starts[-1]))
            held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held


def _compare(rows: pa.Table, length: int) -> pa.RecordBatch:
    """What is repeated of the regions that stand once, among all regions of their group. All windows are hashed and sorted together."""
    g, region, n, times = (rows.column(c).to_numpy() for c in ("g", "region", "n", "times"))
    _, first = np.unique(np.stack([g, region, n]), axis=1, return_index=True)
    g, region, n, times = g[first], region[first], n[first].astype(np.int64), times[first]
    data = rows.column("data").take(pa.array(first)).combine_chunks()
    sizes = n + (length - 1)
    hashes = window_hashes(np.frombuffer(b"".join(data.to_pylist()), np.uint8), length)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    w = hashes[np.repeat(np.cumsum(sizes) - sizes, n) + place]
    order = np.lexsort((w, g[owner]))
    same = (w[order][1:] == w[order][:-1]) & (g[owner][order][1:] == g[owner][order][:-1])
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.flatnonzero(again & (times[owner] == 1))
    if not len(hit):
        return pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int32(), _SPANS)], ["g", "region", "n", "spans"])
    who, at = owner[hit], place[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (who[1:] != who[:-1]) | (at[1:] > at[:-1] + length)          # windows that touch are one span
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(hit)) - 1
    spans = pa.StructArray.from_arrays([pa.array(at[starts], pa.int32()), pa.array(at[ends] + length, pa.int32())], ["lo", "hi"])
    several = who[starts]
    rows_at = np.concatenate([[0], np.flatnonzero(np.diff(several)) + 1])
    lists = pa.ListArray.from_arrays(pa.array(np.append(rows_at, len(several)), pa.int32()), spans)
    mine = several[rows_at]
    return pa.RecordBatch.from_arrays([pa.array(g[mine]), pa.array(region[mine]), pa.array(n[mine], pa.int32()), lists], ["g", "region", "n", "spans"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES,
                 task_regions: int = TASK_REGIONS) -> DataFrame:
    """`id, kept, n_bytes, n_removed, n_spans` for every row: the text's UTF-8 bytes without those that a string of `length` bytes covers which also starts
    anywhere else, in this or another document.

    Every row is a document, so the rows of repeated ids and texts repeat each other. A null text is empty; texts shorter than
    `length` keep all. Rows with a null id are documents like others. A very long text is one row of one task. Equal hashes stand for
    equal bytes: 64 bits among suffixes, 128 among regions. No column but the two named ones is read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("of"), "text")
    spans = repeated_spans(rows, length, gram, batches, task_regions)
    gone = cut_lineage(spans.groupBy(F.col("id").alias("_id"), F.col("of").alias("_of")).agg(F.collect_list(F.struct("lo", "hi")).alias("gone")))   # of one text
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_of")), "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lo, hi = _spans(np.array([s["lo"] for s in own or []], np.int64), np.array([s["hi"] for s in own or []], np.int64))
                cuts = [0, *(x for pair in zip(lo.tolist(), hi.tolist()) for x in pair), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                out.append((doc, kept, len(text), len(text) - len(kept), len(lo)))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.select("id", F.col("text").cast("binary").alias("text"), "gone").mapInArrow(keep, "id long, kept binary, n_bytes long, n_removed long, n_spans long")
