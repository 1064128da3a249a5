"""Exact k-nearest-neighbour joins by cosine, inside groups (`part`).

Two ways give the same rows:

* `scan`: the queries are few (their byte size is checked), so every task gets them
  and reads its share of the base once, keeping a running top k per query.
* `cells`: neither side is small. Base rows go to the cell of their nearest pivot, and a cell that
  is still too large gets pivots of its own, so the cells are the leaves of a tree whose nodes know their rows'
  least and largest angle. A query goes down to the cells that can hold a row within its reach (triangle inequality
  on angles, and the plane between two pivots). Both sides of a cell are split into
  blocks of bounded size, and each task scores one block pair. Without a least score the
  reach comes from a first round in the query's own cell. Where a query would visit more than VISITS cells on average, the
  vectors form no groups that could be left out; the visits are counted, not written, and the queries go through
  `scan` in rounds of SCAN_BYTES instead: all pairs are scored, but no row is copied per cell. Where there are many queries, a probe of PROBE_ROWS
  rows of both sides counts the visits to a first level of cells before any is made. Both ways give the same rows, so the probe decides the time only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import vectors as V
from factloom.operators.skew import broadcast_if_small, join_unique
from factloom.session import cut_lineage, shuffle_partitions

SCAN_BYTES = 32 << 20     # largest side handed to every task at once
BLOCK_ROWS = 4096         # rows per block side
CELLS_PER_BLOCK = 8       # a cell is first aimed at this fraction of a block
MAX_PIVOTS = 256          # of one node of the tree; its depth grows with the rows
VISITS = 16               # cells that a query may visit on average
SORTED_ROWS = 256         # rows of a cell by which the base of a scan is sorted
SORTED_CELLS = 16384      # at most so many pivots, which every task holds
SORTED_FLOOR = 0.6        # least floor that can leave rows of such a cell out
PROBE_ROWS = 16384        # rows of a side that tell whether cells can be left out; fewer queries are not probed
GROUP_ROWS = 16384        # rows that are placed among the pivots of a node at once
ROUTE_BYTES = 64 << 20    # of vectors that a group of queries can become when all of them go on to all children of a node
HIT_BYTES = 24            # of one hit of a query
_PAIRS = "query_id long, id long, s double"
_SLACK = 1e-6             # keeps rounding from pruning a reachable cell


@dataclass(frozen=True)
class _Join:
    k: int
    dim: int
    exclude_self: bool
    tags: bool
    seq: bool
    links: bool = False


def knn_join(queries: DataFrame, base: DataFrame, k: int, *, exclude_self: bool = False, tags: bool = False,
             seq: bool = False, strategy: str = "auto", block_rows: int = BLOCK_ROWS,
             max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """The k best base rows per query: `query_id, id, score, rank`.

    `queries`: query_id, part, vec, floor (least score or null), and with `tags` a tag
    array (null or empty for no restriction), with `seq` an order number.
    `base`: id, part, vec, and with `tags`/`seq` the same columns. A pair needs equal
    parts, one common tag where tags are asked for, and base.seq < query.seq.
    Equal scores are ordered by id. Missing and zero vectors have no score and match nothing.
    """
    q_cols = ["query_id", "part", "vec", F.col("floor").cast("double").alias("floor")]
    b_cols = ["id", "part", "vec"]
    for used, name in ((tags, "tags"), (seq, "seq")):
        if used:
            q_cols.append(name)
            b_cols.append(name)
    pairs = _join(queries.select(*q_cols), base.select(*b_cols), _Join(k, 0, exclude_self, tags, seq), strategy, block_rows, max_pivots)
    return _ranked(pairs, k)


def knn_links(queries: DataFrame, base: DataFrame, strategy: str = "auto", block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS,
              both: str | None = None) -> DataFrame:
    """`id_a, id_b`: links between ids that connect every query with every base row of its part that reaches its floor.

    A task puts out a spanning forest of what it finds, never all pairs. Rows that miss the floor by less than single precision may be linked too.
    `both` names a flag of both sides that tells the rows which stand in either with the same id, part, vector and one common floor;
    rounds over all pairs score two of those once.
    """
    floor = F.col("floor").cast("double").alias("floor")
    flag = [both] if both else []
    pairs = _join(queries.select("query_id", "part", "vec", floor, *flag), base.select("id", "part", "vec", *flag),
                  _Join(0, 0, False, False, False, links=True), strategy, block_rows, max_pivots, both)
    return pairs.select(F.col("query_id").alias("id_a"), F.col("id").alias("id_b"))


def _join(queries: DataFrame, base: DataFrame, how: _Join, strategy: str, block_rows: int, max_pivots: int, both: str | None = None) -> DataFrame:
    queries, base = queries.filter("vec is not null"), base.filter("vec is not null")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"), F.count("floor").alias("floors")).first()
    if not size.n:
        return base.sparkSession.createDataFrame([], _PAIRS)
    how = replace(how, dim=size.dim)
    flag = [both] if both else []
    if strategy == "scan" or (strategy == "auto" and size.n * _held_bytes(how) <= SCAN_BYTES):
        return _scan(queries.drop(*flag), base.drop(*flag), how)
    if strategy == "auto" and size.n > PROBE_ROWS and size.floors == size.n:
        sizes = cut_lineage(base.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
        n_base = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if n_base * how.dim * 4 <= SCAN_BYTES and n_base < size.n:          # one pass over the queries, and nothing is shuffled
            return _scan(queries.drop(*flag), base.drop(*flag), how, hold_base=True)
        if _spread(queries, base, sizes, n_base, how, size.n, block_rows, max_pivots):
            return _scan_in_rounds(queries, base, how, size.n, n_base, both)
    return _cells(queries, base, how, block_rows, max_pivots, None if strategy == "cells" else VISITS * size.n, both)


def _spread(queries: DataFrame, base: DataFrame, sizes: DataFrame, n_base: int, how: _Join, n: int, block_rows: int, max_pivots: int) -> bool:
    """Whether the probed queries would visit more than VISITS cells on average below the roots of the tree."""
    def probed(rows: DataFrame, key: str, total: int, *more: str) -> pa.Table:
        drawn = rows.filter(F.pmod(F.xxhash64(F.lit("probe"), key), F.lit(max(1, -(-total // PROBE_ROWS)))) == 0)
        return drawn.select(key, "part", "vec", *more).limit(2 * PROBE_ROWS).toArrow()

    cell_rows = max(1, block_rows // CELLS_PER_BLOCK)
    large = sizes.filter(F.col("n") > cell_rows).orderBy(F.desc("n")).limit(PROBE_ROWS).collect()
    widths = {r.part: min(max_pivots, -(-r.n // cell_rows) + 1) for r in large}
    if not widths:
        return False
    q, b = probed(queries, "query_id", n, "floor"), probed(base, "id", n_base)
    visits = 0
    for part in pc.unique(b.column("part")).to_pylist():
        mine, asked = b.filter(pc.equal(b.column("part"), part)), q.filter(pc.equal(q.column("part"), part))
        if part not in widths or not asked.num_rows:
            continue
        unit, usable = V.unit_rows(mine.column("vec"), how.dim)
        unit = unit[usable]
        pivots = unit[:min(widths[part], len(unit) // 8)]           # else a cell's own pivot would be all it holds
        if len(pivots) < 2:
            continue
        angle = np.concatenate([_angles(unit[lo:lo + 4096], pivots) for lo in range(0, len(unit), 4096)])
        nearest, least = angle.argmin(axis=1), angle.min(axis=1)
        low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        np.minimum.at(low, nearest, least)
        np.maximum.at(high, nearest, least)
        to, able = V.unit_rows(asked.column("vec"), how.dim)
        theta = _reach(np.asarray(asked.column("floor").cast(pa.float64())), how)
        for lo in range(0, len(to), 4096):
            visits += np.count_nonzero(_goes(to[lo:lo + 4096], theta[lo:lo + 4096], pivots, low, high) & able[lo:lo + 4096, None])
    return visits > VISITS * max(1, q.num_rows)


def _reach(floor: np.ndarray, how: _Join) -> np.ndarray:
    """The angle up to which a row can reach the floor. Scores are rounded, so it may from one digit below it."""
    lowest = np.where(np.isnan(floor), -1.0, floor) - 10.0 ** -V.SCORE_DIGITS - how.links * 1e-5
    return np.arccos(np.clip(lowest, -1.0, 1.0)) + _SLACK


def _goes(unit: np.ndarray, theta: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Queries by cells: whether the cell can hold a row within the query's reach."""
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots @ pivots.T)))          # distance between pivots
    cos, reach = np.clip(unit @ pivots.T, -1.0, 1.0), theta[:, None]
    angle = np.arccos(cos)
    own = angle.argmin(axis=1)
    chord = 2 * np.sin(np.minimum(reach, np.pi) / 2)
    go = (angle - reach <= high + _SLACK) & (angle + reach >= low - _SLACK)
    return go & (cos[np.arange(len(cos)), own][:, None] - cos <= chord * gap[own] + _SLACK)


def _held_bytes(how: _Join) -> int:
    """What a worker that scans holds of one query: its vector and its best hits."""
    return how.dim * 4 + how.k * HIT_BYTES


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("s"), "id")
    return (pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "id", F.col("s").alias("score"), "rank"))


# ---- few queries: one pass over the base -------------------------------------------------

def _vocabulary(col: pa.ChunkedArray) -> dict[str, int]:
    words = sorted({t for tags in col.to_pylist() for t in tags or ()})
    return {t: i for i, t in enumerate(words)}


def _scan(queries: DataFrame, base: DataFrame, how: _Join, hold_base: bool = False) -> DataFrame:
    """The best base rows per query that each task finds. Every task holds the queries, or with `hold_base` the base, and reads its share of the other side."""
    held, read = (base, queries) if hold_base else (queries, base)
    shared = base.sparkSession.sparkContext.broadcast(held.toArrow())       # size checked by the caller

    def blocks(table, words: dict[str, int], query: bool) -> V.Block:
        block = V.block_from(table, "query_id" if query else "id", how.dim, how.seq, floor=query)
        if how.tags:
            block.tags = V.tag_matrix(table.column("tags"), words)
        return block

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        parts = pc.unique(table.column("part").combine_chunks())
        words = _vocabulary(table.column("tags")) if how.tags else {}
        whole = blocks(table, words, query=not hold_base)
        part_of = np.asarray(pc.index_in(table.column("part").combine_chunks(), value_set=parts))
        mine_of = [whole.take(np.nonzero(part_of == p)[0]) for p in range(len(parts))]
        del whole
        turns: dict[tuple[int, int], tuple] = {}        # per part and width: the rotation and the held block with its leading numbers
        best = V.merge_top([], how.k)
        for batch in batches:
            b_part = np.asarray(pc.index_in(batch.column("part"), value_set=parts).fill_null(-1))
            mine = b_part >= 0
            if not mine.any():
                continue
            batch = batch.filter(pa.array(mine))
            b_part = b_part[mine]
            read_all = blocks(batch, words, query=hold_base)
            found = [best]
            for p in np.unique(b_part):
                q, b = mine_of[p], read_all.take(np.nonzero(b_part == p)[0])
                if hold_base:
                    q, b = b, q
                q, b = _turned(q, b, turns, int(p), hold_base)
                cell = np.asarray(batch.column("cell"))[b_part == p] if "cell" in batch.schema.names else None
                if how.links:
                    yield V.pairs_batch(*V.link_pairs(q, b, cell))
                elif hold_base:
                    yield V.pairs_batch(*V.top_pairs(q, b, how.k, how.exclude_self))
                else:
                    found.append(V.top_pairs(q, b, how.k, how.exclude_self, cell))
            if len(found) > 1:
                best = V.merge_top(found, how.k)
                for q in mine_of:
                    V.raise_floors(q, best, how.k)
        if len(best[0]):
            yield V.pairs_batch(*best)

    return read.mapInArrow(score, _PAIRS)


def _turned(q: V.Block, b: V.Block, turns: dict, part: int, hold_base: bool) -> tuple[V.Block, V.Block]:
    """Both sides with leading numbers, where these spare work; the held side is turned once."""
    if not len(q.ids) or not len(b.ids) or np.isnan(q.floor).any():
        return q, b
    held = b if hold_base else q
    if part not in turns:
        turns[part] = V.Turn(held.unit)
    m = turns[part].width(q.floor.min())
    if not m:
        return q, b
    if (part, m) not in turns:
        turns[part, m] = turns[part].lead(held, m).lead
    other = turns[part].lead(q if hold_base else b, m)
    held = V.Block(held.ids, held.unit, held.usable, held.seq, held.floor, held.tags, held.single, turns[part, m])
    return (other, held) if hold_base else (held, other)


def _scan_in_rounds(queries: DataFrame, base: DataFrame, how: _Join, n_q: int, n_b: int, both: str | None = None) -> DataFrame:
    """`_scan` for as many rows as there are: a round for every SCAN_BYTES of one side, each written down before the next.

    A round takes queries; or base rows, where these make far fewer rounds. Rows that stand on both sides (flag `both`) lie in the same round on either:
    the queries of a round then meet those of its own and of later rounds, as the earlier ones have met them.
    """
    spark = base.sparkSession
    rounds, by_base = max(1, -(-n_q * _held_bytes(how) // SCAN_BYTES)), max(1, -(-n_b * how.dim * 4 // SCAN_BYTES))
    hold_base = by_base <= min(8, rounds // 4)
    rounds = by_base if hold_base else rounds
    tasks = min(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism)      # each makes the held side ready for itself

    def dealt(rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("round", F.pmod(F.xxhash64(key), F.lit(rounds)).cast("int"))

    def spread(rows: DataFrame) -> DataFrame:
        """Sorted by round, so that a round reads its own pages only. Little data can be much scoring, so it is spread."""
        return cut_lineage(rows.repartition(tasks).sortWithinPartitions("round"))

    flag = [both] if both else []
    queries, base = spread(dealt(queries, "query_id")), dealt(base, "id")
    pivots = None if hold_base else _sorting_pivots(queries, base, n_b)
    if pivots is None:
        base = spread(base)
    else:       # like rows lie together, so that a task can leave out the queries that reach none of them
        base = cut_lineage(_sorted_into(base, pivots, how).repartition(tasks, "part", "cell").sortWithinPartitions("part", "cell"))
    found = None
    for i in range(rounds):
        now = F.col("round") == i
        if hold_base:
            sides = [(queries, base.filter(now))]
        elif both:
            met = F.col(both) & (F.col("round") < i)
            sides = [(queries.filter(now & F.col(both)), base.filter(~met)), (queries.filter(now & ~F.col(both)), base)]
        else:
            sides = [(queries.filter(now), base)]
        for q, b in sides:
            if len(sides) > 1 and q.isEmpty():
                continue
            pairs = cut_lineage(_scan(q.drop("round", *flag), b.drop("round", *flag), how, hold_base))
            found = pairs if found is None else found.unionByName(pairs)
    return found


def _sorting_pivots(queries: DataFrame, base: DataFrame, n_b: int) -> np.ndarray | None:
    """Vectors of the base to sort it by; None where floors are too low or the base is too small for it to help."""
    if (queries.agg(F.min(F.coalesce("floor", F.lit(-1.0)))).first()[0] or -1.0) < SORTED_FLOOR:
        return None
    wanted = min(SORTED_CELLS, n_b // (SORTED_ROWS * max(1, base.select("part").distinct().count())))
    if wanted < 16:
        return None
    drawn = base.filter(F.pmod(F.xxhash64(F.lit("pivot"), "id"), F.lit(max(1, n_b // (2 * wanted)))) == 0).select("vec").limit(wanted).toArrow()
    unit, usable = V.unit_rows(drawn.column("vec"), len(drawn.column("vec")[0])) if drawn.num_rows else (np.empty((0, 0)), np.empty(0, bool))
    return unit[usable].astype(np.float32) if usable.sum() >= 16 else None


def _sorted_into(base: DataFrame, pivots: np.ndarray, how: _Join) -> DataFrame:
    """`base` with the number of its nearest pivot as `cell`."""
    shared, names = base.sparkSession.sparkContext.broadcast(pivots), [*base.columns, "cell"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv = shared.value.T
        for batch in batches:
            unit = V.unit_rows(batch.column("vec"), how.dim)[0].astype(np.float32)
            step = max(1, V._CELLS_PER_PASS // piv.shape[1])
            at = [(unit[lo:lo + step] @ piv).argmax(axis=1) for lo in range(0, len(unit), step)]
            cell = pa.array(np.concatenate(at) if at else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names)

    return base.mapInArrow(place, T.StructType([*base.schema.fields, T.StructField("cell", T.LongType())]))


# ---- many queries: a tree of pivot cells ----------------------------------------------------

ROOT = ""                 # the cell of a part before it is split; a child's name is its parent's, a slash and a number


@dataclass(frozen=True)
class _Tree:
    rows: DataFrame         # base rows with the leaf cell they lie in
    levels: list[DataFrame]     # per level the children of split cells: part, cell, k, vec, n, lo, hi, inner


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _grow(base: DataFrame, how: _Join, cell_rows: int, block_rows: int, max_pivots: int) -> _Tree:
    """Split cells of more than `block_rows` rows (at first `cell_rows`) until there are none. Rows with one vector stay together."""
    extra = [c for c in ("tags", "seq") if c in base.columns]
    names = ["id", "part", "vec", *extra, "cell"]
    live = base.filter(F.exists("vec", lambda x: x != 0)).withColumn("cell", F.lit(ROOT)).select(*names)
    done, levels, most = [], [], cell_rows
    while True:
        sizes = live.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"))
        split = cut_lineage(sizes.filter(F.col("n") > most).select(
            "part", "cell", "n", F.least(F.lit(max_pivots), F.ceil(F.col("n") / cell_rows) + 1).cast("int").alias("width"),
            F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("salts")))
        pivots = _pivots(live, split)
        if pivots is None:
            done.append(live)
            break
        wide = pivots.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")       # one vector can't be split
        split = cut_lineage(split.join(wide.select("part", "cell"), ["part", "cell"], "left_semi"))
        marked = join_unique(live, split, ["part", "cell"], "id", weight="n")
        done.append(marked.filter("salts is null").select(*names))
        moved = cut_lineage(_place(marked.filter("salts is not null"), pivots, split, how, extra))
        stats = moved.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
        child = F.concat(F.col("cell"), F.lit("/"), F.col("k").cast("string"))
        nodes = pivots.withColumn("child", child).join(stats.select("part", F.col("cell").alias("child"), "n", "lo", "hi"), ["part", "child"])
        levels.append(cut_lineage(nodes.select("part", "cell", "k", "vec", "n", "lo", "hi")))
        live, most = moved.select(*names), block_rows
    for at in range(len(levels)):       # which children are split themselves
        below = levels[at + 1].select("part", F.col("cell").alias("child")).distinct().withColumn("inner", F.lit(True)) if at + 1 < len(levels) else None
        child = F.concat(F.col("cell"), F.lit("/"), F.col("k").cast("string"))
        level = levels[at].withColumn("child", child)
        level = level.withColumn("inner", F.lit(False)) if below is None else level.join(below, ["part", "child"], "left").fillna(False, ["inner"])
        levels[at] = level.select("part", "cell", "k", "vec", "n", "lo", "hi", "inner")
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return _Tree(rows, levels)


def _pivots(rows: DataFrame, split: DataFrame) -> DataFrame | None:
    """`part, cell, k, vec`: as many different vectors of each cell to split as it is wide, those with the least hashes. None without cells."""
    if split.isEmpty():
        return None
    mine = join_unique(rows.select("id", "part", "cell", "vec"), split.select("part", "cell", "width", "n"), ["part", "cell"], "id", weight="n").filter("width is not null")
    mine = mine.withColumn("h", F.xxhash64("vec"))
    different = mine.groupBy("part", "cell", "h").agg(F.min("id").alias("id"), F.first("width").alias("width"))
    first = W.partitionBy("part", "cell").orderBy("h")
    picked = different.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= F.col("width"))
    picked = cut_lineage(picked.select("part", "cell", "id", "h", "k"))
    found = mine.join(broadcast_if_small(picked), ["part", "cell", "id", "h"])
    return cut_lineage(found.groupBy("part", "cell", "k").agg(F.first("vec").alias("vec")))


def _place(rows: DataFrame, pivots: DataFrame, split: DataFrame, how: _Join, extra: list[str]) -> DataFrame:
    """Rows of split cells with the child of their nearest pivot and the angle to it."""
    types = {"tags": "array<string>", "seq": "long"}
    schema = ", ".join(["id long", "part string", "vec array<float>"] + [f"{c} {types[c]}" for c in extra] + ["cell string", "angle double"])
    names = [x.split()[0] for x in schema.split(", ")]

    def place(mine: pa.Table, nodes: pa.Table) -> pa.Table:
        out = {n: mine.column(n) for n in names if n != "angle"}
        if not mine.num_rows:
            return pa.table({**out, "angle": pa.array([], pa.float64())})
        piv, _ = V.unit_rows(nodes.column("vec"), how.dim)
        unit, _ = V.unit_rows(mine.column("vec"), how.dim)
        number = np.asarray(nodes.column("k")).astype(str)
        nearest, angle = np.empty(len(unit), np.int64), np.empty(len(unit))
        for lo in range(0, len(unit), 4096):
            found = _angles(unit[lo:lo + 4096], piv)
            nearest[lo:lo + 4096] = found.argmin(axis=1)
            angle[lo:lo + 4096] = found.min(axis=1)
        parent = mine.column("cell")[0].as_py()
        out["cell"] = pa.array([f"{parent}/{x}" for x in number[nearest]], pa.string())
        return pa.table({**out, "angle": pa.array(angle)})

    keys, n = ["part", "cell", "salt"], shuffle_partitions(rows.sparkSession)
    left = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("n", "width", "salts")
    right = pivots.join(broadcast_if_small(split), ["part", "cell"]).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("n", "width", "salts")
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(place, schema)


def _descend(queries: DataFrame, tree: _Tree, how: _Join, own_only: bool, most: int | None = None) -> DataFrame | None:
    """One row per query and leaf cell it must visit. With `own_only` the nearest cells that hold k rows at least. None if more than
    `most` rows would go on to a level; they are counted before they are written."""
    names = [*queries.columns, "cell"]
    live = queries.withColumn("cell", F.lit(ROOT))
    if not tree.levels:
        return cut_lineage(live)
    roots = cut_lineage(tree.levels[0].groupBy("part").agg(F.lit(True).alias("inner")))
    live = join_unique(live, roots, ["part"], "query_id").fillna(False, ["inner"])
    done = []
    for nodes in tree.levels:
        done.append(live.filter("not inner").select(*names))
        inner = live.filter("inner").select(*names)
        if most is not None and (_children(inner, nodes, how, own_only, counted=True).agg(F.sum("n")).first()[0] or 0) > most:
            return None
        live = cut_lineage(_children(inner, nodes, how, own_only))
    done.append(live.select(*names))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return cut_lineage(rows)


def _children(live: DataFrame, nodes: DataFrame, how: _Join, own_only: bool, counted: bool = False) -> DataFrame:
    """The children of its cell that every query goes on to; with `counted` only their number `n`, in parts."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in live.schema.fields]
    names = live.columns

    def route(mine: pa.Table, below: pa.Table) -> pa.Table:
        if not mine.num_rows or not below.num_rows:
            if counted:
                return pa.table({"n": pa.array([0], pa.int64())})
            return mine.select(names).slice(0, 0).append_column("inner", pa.array([], pa.bool_()))
        piv, _ = V.unit_rows(below.column("vec"), how.dim)
        number, inner = np.asarray(below.column("k")).astype(str), np.asarray(below.column("inner"))
        n, low, high = (np.asarray(below.column(c)) for c in ("n", "lo", "hi"))
        unit, usable = V.unit_rows(mine.column("vec"), how.dim)
        floor = np.asarray(mine.column("floor").cast(pa.float64()))
        theta = _reach(floor, how)
        rows, cells = [], []
        for lo in range(0, len(unit), 4096):
            if own_only:
                angle = _angles(unit[lo:lo + 4096], piv)
                rich = np.where(n >= how.k, angle, np.inf)
                go = np.arange(len(piv))[None, :] == rich.argmin(axis=1)[:, None]
                if not (n >= how.k).any():
                    go[:] = True
            else:
                go = _goes(unit[lo:lo + 4096], theta[lo:lo + 4096], piv, low, high)
            row, cell = np.nonzero(go & usable[lo:lo + 4096, None])
            rows.append(row + lo)
            cells.append(cell)
        row, cell = np.concatenate(rows), np.concatenate(cells)
        if counted:
            return pa.table({"n": pa.array([len(row)], pa.int64())})
        kept = mine.select(names).take(pa.array(row))
        parent = mine.column("cell")[0].as_py()
        kept = kept.set_column(names.index("cell"), "cell", pa.array([f"{parent}/{x}" for x in number[cell]], pa.string()))
        return kept.append_column("inner", pa.array(inner[cell]))

    keys, parts = ["part", "cell", "salt"], shuffle_partitions(live.sparkSession)
    most = nodes.groupBy("part", "cell").agg(F.greatest(F.lit(1), F.floor(F.lit(ROUTE_BYTES) / (F.count(F.lit(1)) * how.dim * 4))).alias("most"))
    load = live.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("nq")).join(broadcast_if_small(most), ["part", "cell"])
    load = cut_lineage(load.select("part", "cell", "nq", F.ceil(F.col("nq") / F.col("most")).cast("int").alias("salts")))
    left = join_unique(live, load, ["part", "cell"], "query_id", weight="nq").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int"))
    right = nodes.join(broadcast_if_small(load), ["part", "cell"]).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("nq", "salts")
    left = left.drop("nq", "salts").repartition(parts, *keys).groupBy(*keys)
    return left.cogroup(right.repartition(parts, *keys).groupBy(*keys)).applyInArrow(route, "n long" if counted else ", ".join([*fields, "inner boolean"]))


def _cells(queries: DataFrame, base: DataFrame, how: _Join, block_rows: int, max_pivots: int, visits: int | None = None,
           both: str | None = None) -> DataFrame:
    whole = queries, base
    if both:
        queries, base = queries.drop(both), base.drop(both)
    cell_rows = max(1, block_rows // CELLS_PER_BLOCK)
    tree = _grow(base, how, cell_rows, block_rows, max_pivots)
    if not how.links and not queries.filter("floor is null").isEmpty():
        # First round in the query's own cell: its k-th score there is a sure least score.
        first = _ranked(_visit(_descend(queries, tree, how, own_only=True), tree, how, block_rows), how.k)
        reach = first.groupBy("query_id").agg(F.count("score").alias("c"), F.min("score").alias("m"))
        reach = reach.filter(F.col("c") == how.k).select("query_id", F.col("m").alias("sure"))
        queries = cut_lineage(queries.join(reach, "query_id", "left")
                              .withColumn("floor", F.coalesce("floor", "sure", F.lit(-1.0))).drop("sure"))

    # Small cells prune well when the vectors form groups. When they do not, each query goes
    # to nearly all of them, and cells of a whole block each mean fewer copies.
    routed = _descend(queries, tree, how, own_only=False, most=visits)
    if routed is None:
        asked, held = whole if both else (queries, base)
        return _scan_in_rounds(asked, held, how, asked.count(), held.count(), both)
    asked = queries.groupBy("part").agg(F.count(F.lit(1)).alias("nq"))
    sizes = base.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    wide = asked.join(sizes, "part").agg(F.sum(F.col("nq") * F.ceil(F.col("n") / block_rows))).first()[0] or 0
    if cell_rows < block_rows and routed.count() > 2 * wide:
        tree = _grow(base, how, block_rows, block_rows, max_pivots)
        routed = _descend(queries, tree, how, own_only=False)
    return _visit(routed, tree, how, block_rows)


def _visit(routed: DataFrame, tree: _Tree, how: _Join, block_rows: int) -> DataFrame:
    """Score each query against every cell that it was sent to."""
    load = routed.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("nq"))
    held = tree.rows.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"))
    grid = (held.join(load, ["part", "cell"])
            .withColumn("nb", F.ceil(F.col("n") / block_rows).cast("int"))
            .withColumn("nqb", F.ceil(F.col("nq") / block_rows).cast("int")))
    grid = cut_lineage(grid.select("part", "cell", "n", "nq", "nb", "nqb"))

    extra = [c for c in ("tags", "seq") if c in tree.rows.columns]
    # Each row of a cell gets the cell's grid; hot cells are served by broadcast (join_unique).
    q_rows = join_unique(routed, grid.select("part", "cell", "nq", "nb", "nqb"), ["part", "cell"], "query_id",
                         weight="nq").filter("nb is not null")
    q_rows = q_rows.select("query_id", "part", "vec", "floor", *extra, "cell",
                           F.pmod(F.xxhash64("query_id"), "nqb").cast("int").alias("qb"),
                           F.explode(F.expr("sequence(0, nb - 1)")).alias("bb"))
    b_rows = join_unique(tree.rows, grid.select("part", "cell", "n", "nb", "nqb"),
                         ["part", "cell"], "id", weight="n").filter("nb is not null")
    b_rows = b_rows.select("id", "part", "vec", *extra, "cell",
                           F.pmod(F.xxhash64("id"), "nb").cast("int").alias("bb"),
                           F.explode(F.expr("sequence(0, nqb - 1)")).alias("qb"))

    def score(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return pa.Table.from_batches([V.pairs_batch(*V.merge_top([], how.k))])
        qs = V.block_from(q, "query_id", how.dim, how.seq, floor=True)
        bs = V.block_from(b, "id", how.dim, how.seq)
        if how.links:
            return pa.Table.from_batches([V.pairs_batch(*V.link_pairs(*V.turned(qs, bs)))])
        if how.tags:
            words = _vocabulary(q.column("tags"))
            qs.tags, bs.tags = V.tag_matrix(q.column("tags"), words), V.tag_matrix(b.column("tags"), words)
        return pa.Table.from_batches([V.pairs_batch(*V.top_pairs(*V.turned(qs, bs), how.k, how.exclude_self))])

    keys = ["part", "cell", "qb", "bb"]
    # Little data can be much scoring, so the partitions are not to be merged by size.
    n = shuffle_partitions(routed.sparkSession)
    q_rows, b_rows = q_rows.repartition(n, *keys), b_rows.repartition(n, *keys)
    return q_rows.groupBy(*keys).cogroup(b_rows.groupBy(*keys)).applyInArrow(score, _PAIRS)
