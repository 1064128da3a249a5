"""Near duplicates by SimHash fingerprints.

A fingerprint is mapped to its segment counts: the number of ones in each of its 32 segments of two bits. Two
fingerprints that differ in d bits have counts at a Manhattan distance of at most d. So a range join on
a grid of counts finds every pair within the distance, and the bits themselves decide.

The grid has one axis for each segment of a half. Within Manhattan distance 3 over all 32 segments, one half
is within distance 1. A fingerprint therefore owns one cell in each half and looks into the cells one
step away. Two cells one step apart have sums of different parity, so only even cells look into others
and each pair of a half meets once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from factloom.llm.common import block_pairs, forest, lookup
from factloom.operators.components import connected_components
from factloom.operators.skew import join_unique
from factloom.session import cut_lineage, shuffle_partitions

SEED = 42
COMPLETE_DISTANCE = 3     # every pair up to this many differing bits is found
CELL_ROWS = 4096          # rows of a cell in one task; larger cells are split into pairs of blocks
_HASHES = 1 << 15         # shingle hashes unpacked to bits at a time
_SHORT_RUN = 48
_TABLE_BIT = 34           # a cell's name: 32 bits of counts, the half, the table
_FIELDS = 0x55555555
_ONES = np.array([1 << (2 * i) for i in range(16)], dtype=np.int64)


def shingle_hashes(text: bytes | None, shingle_words: int) -> np.ndarray:
    """XXH64 of every shingle of a text in order; a text of fewer words is one shingle, one without words has none."""
    found = (text or b"").lower().split()      # of bytes: A-Z only, and only ASCII white space
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < shingle_words:
        hashes = [xxh64_intdigest(b" ".join(found), SEED)]
    else:
        hashes = [xxh64_intdigest(b" ".join(g), SEED) for g in zip(*(found[i:] for i in range(shingle_words)))]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: bytes | None, shingle_words: int, tables: int) -> list[int]:
    """The fingerprints of a text, as signed 64-bit integers. Table 0 hashes with XXH64; further tables
    remix those hashes, so that each is a fingerprint of its own."""
    return prints_of(shingle_hashes(text, shingle_words), tables)


def prints_of(base: np.ndarray, tables: int) -> list[int]:
    if not len(base):
        return [0] * tables
    prints = []
    for t in range(tables):
        mixed = base if t == 0 else _remix(base, t)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(mixed), _HASHES):
            part = mixed[at:at + _HASHES].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
        prints.append(int.from_bytes(np.packbits(2 * ones > len(mixed)).tobytes(), "big", signed=True))
    return prints


def _remix(x: np.ndarray, table: int) -> np.ndarray:
    x = x * np.uint64(2 * 0x9E3779B97F4A7C15 * table + 1 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                 tables: int = 1) -> DataFrame:
    """`id, prints`: the fingerprints of every whole text. A null or empty text has fingerprint zero."""
    @F.arrow_udf("array<long>")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, shingle_words, tables) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return docs.select(F.col(id_col).cast("long").alias("id"), prints(F.col(text_col).cast("binary")).alias("prints"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                    max_distance: int = COMPLETE_DISTANCE, tables: int = 1,
                    cell_rows: int = CELL_ROWS) -> DataFrame:
    """`id, fingerprint, component_id` for every row: 16 hex digits, and the least id that the row reaches over
    links, itself included.

    Two rows link when in one of the `tables` their fingerprints differ in at most `max_distance` bits. Up to three bits
    every such pair is found. Beyond three only pairs with a half that differs by one step are found; further
    tables then find most of the rest. Rows with a null id have a fingerprint and take the component of the rows with the same
    fingerprint (null if there is none), but lead no link on. A repeated row is two rows with one id;
    rows with one id and different texts link, as they are one document. Other columns of `docs` don't matter.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle_words, tables))
    # Copies share all fingerprints: a group of copies of any size is one class with one representative.
    classes = cut_lineage(prints.groupBy("prints").agg(F.min("id").alias("rep")))
    edges = table_links(classes.filter("rep is not null"), max_distance, tables, cell_rows)
    found = connected_components(edges).select(F.col("id").alias("rep"), "label")
    named = cut_lineage(classes.join(found, "rep", "left")
                        .select("prints", F.coalesce("label", "rep").alias("component_id")))
    shown = F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0"))
    return lookup(prints, named, ["prints"], "id").select("id", shown.alias("fingerprint"), "component_id")


def table_links(linked: DataFrame, max_distance: int, tables: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`id_a, id_b`: links between the classes `rep, prints`, enough of them to connect what the links of each table connect."""
    owners, pairs, shared = table_pairs(linked, max_distance, tables, cell_rows)
    left = owners.select("t", F.col("print").alias("a"), F.col("owner").alias("id_a"))
    right = owners.select("t", F.col("print").alias("b"), F.col("owner").alias("id_b"))
    links = lookup(lookup(pairs, left, ["t", "a"], "b"), right, ["t", "b"], "a").select("id_a", "id_b")
    if shared is not None:
        links = links.unionByName(shared)
    return cut_lineage(links)


def table_pairs(linked: DataFrame, max_distance: int, tables: int,
                cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What `table_links` is made of: `t, print, owner, n` for every fingerprint of a table, with its least class; `a, b, t`, links between
    fingerprints; and with several tables `id_a, id_b`, owner and class, of classes that share one table's fingerprint only.

    All tables go through one pass: the table is part of a fingerprint's cell.
    """
    each = linked.select("rep", F.posexplode("prints").alias("t", "print"))
    owners = cut_lineage(each.groupBy("t", "print").agg(F.min("rep").alias("owner"), F.count(F.lit(1)).alias("n")))
    pairs = cut_lineage(_pairs(owners.select("t", "print"), max_distance, cell_rows))
    if tables == 1:
        return owners, pairs, None
    spread = each.withColumn("_row", F.pmod(F.xxhash64("rep"), F.lit(1 << 40)))
    shared = join_unique(spread, owners, ["t", "print"], "_row", weight="n").filter("owner != rep")
    return owners, pairs, shared.select(F.col("owner").alias("id_a"), F.col("rep").alias("id_b"))


def _pairs(prints: DataFrame, max_distance: int, cell_rows: int) -> DataFrame:
    """`a, b, t`: links between different fingerprints of a table (the only one without a column `t`), enough of them to connect what links connect."""
    spark = prints.sparkSession
    table = F.col("t") if "t" in prints.columns else F.lit(0)
    cells = prints.select(table.alias("t"), "print").mapInArrow(_cells, "cell long, looks int, print long")
    large = cut_lineage(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
                        .select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks"), "n"))
    spread = cells.withColumn("_row", F.pmod(F.xxhash64("print"), F.lit(1 << 40)))
    rows = join_unique(spread, large, ["cell"], "_row", weight="n").select(
        "cell", "print",
        F.explode(block_pairs(F.col("print"), F.col("blocks"), F.col("looks"))).alias("at"))
    dealt = rows.select("cell", "at.i", "at.j", "at.side", "print")
    dealt = dealt.repartition(shuffle_partitions(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, max_distance)

    return dealt.mapInArrow(compare, "a long, b long, t int")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each table's fingerprint: those it owns (looks 0) and those it looks into (looks 1)."""
    for batch in batches:
        table = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) << _TABLE_BIT
        prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        out = []
        for half in (0, 1):
            bits = ((prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            counts = (bits & _FIELDS) + ((bits >> 1) & _FIELDS)       # sixteen counts of 0 to 2, two bits each
            name = counts + (half << 33) + table
            out.append((name, np.zeros(len(name), np.int32), prints))
            even = np.flatnonzero(np.bitwise_count(bits) % 2 == 0)
            field = counts[even, None] // _ONES % 4
            for step, may in ((1, field < 2), (-1, field > 0)):
                row, axis = np.nonzero(may)
                out.append((name[even][row] + step * _ONES[axis], np.ones(len(row), np.int32), prints[even][row]))
        for at in out:
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(at[2].view(np.int64))],
                                             ["cell", "looks", "print"])


def _compare(batches: Iterator[pa.RecordBatch], max_distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come as cell, i, j, side, print, sorted by the first four; a run of one cell and block pair is compared at once."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if not len(held[0]):
            continue
        start = np.flatnonzero(np.any([np.diff(x) != 0 for x in held[:3]], axis=0)) + 1
        if len(start):       # the last run may go on in the next batch
            yield from _links([x[:start[-1]] for x in held], max_distance)
            held = [x[start[-1]:] for x in held]
    if held is not None and len(held[0]):
        yield from _links(held, max_distance)


def _links(rows: list[np.ndarray], max_distance: int) -> Iterator[pa.RecordBatch]:
    side, prints = rows[3], rows[4].view(np.uint64)
    first = np.concatenate([[0], np.flatnonzero(np.any([np.diff(x) != 0 for x in rows[:3]], axis=0)) + 1])
    end = np.append(first[1:], len(side))
    last = np.repeat(end, end - first)       # the end of each row's run
    found = [[], []]
    short = np.flatnonzero((last - np.repeat(first, end - first) <= _SHORT_RUN) & (side != 2))
    for d in range(1, _SHORT_RUN):
        short = short[short + d < last[short]]
        if not len(short):
            break
        other = short + d
        may = (side[short] == 0) | (side[other] == 2)
        near = may & (np.bitwise_count(prints[short] ^ prints[other]) <= max_distance)
        found[0].append(short[near])
        found[1].append(other[near])
    for lo, hi in zip(first, end):
        if hi - lo <= _SHORT_RUN:
            continue
        left = lo + np.flatnonzero(side[lo:hi] != 2)
        for at in range(0, len(left), 256):
            part = left[at:at + 256]
            apart = np.bitwise_count(prints[part, None] ^ prints[None, lo:hi]) <= max_distance
            apart &= (side[lo:hi] == 2)[None, :] | ((side[part] == 0)[:, None] & (np.arange(lo, hi)[None, :] > part[:, None]))
            a, b = np.nonzero(apart)
            a, b = forest(part[a], b + lo)
            found[0].append(a)
            found[1].append(b)
    if found[0]:
        a, b = forest(np.concatenate(found[0]), np.concatenate(found[1]))
        if len(a):
            table = (rows[0][a] >> _TABLE_BIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(prints[a].view(np.int64)), pa.array(prints[b].view(np.int64)), pa.array(table)], ["a", "b", "t"])
