"""Near duplicates among embeddings by an inverted multi-index.

Unit vectors are cut into two halves, each with a codebook of its own; the pairs of codes are the cells of a product grid. A
vector lies in the cell of its nearest codes and also visits the cells nearest to it: the codes of each half are sorted by their distance, and
a heap walks the two sequences together in the order of the summed squared distances, until the target recall is reached. In a cell every
pair is verified by its cosine in double precision.

How far to go is fitted: around sampled vectors, neighbours at exactly the least similarity are drawn in random directions; the
reach is the quantile, at the target recall, of the distance at which their cells are met. Of two cells
the one with the higher number visits the lower, so a pair meets once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import block_pairs, forest, lookup
from factloom.operators.components import connected_components
from factloom.session import cut_lineage, shuffle_partitions

THRESHOLD = 0.98
TARGET_RECALL = 0.999
SAMPLE = 8192             # vectors that the codebooks and the reach are fitted on, or
SAMPLE_PER_CODE = 16      # so many for every code, if that is more
CELL_VECTORS = 64         # vectors of a label that a cell is aimed at: the codes of a half grow with the square root of the vectors
CELL_ROWS = 2048          # rows of a cell in one task; larger cells are split into pairs of blocks
_ROUNDS = 12


class Grid:
    """Two codebooks and the reach of a visit."""

    def __init__(self, unit: np.ndarray, codes: int, threshold: float, target: float, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.half = unit.shape[1] // 2
        self.books = [_k_means(unit[:, :self.half], codes, rng), _k_means(unit[:, self.half:], codes, rng)]
        squares = [(b * b).sum(axis=1) for b in self.books]
        self.apart = [2 * np.sqrt(np.maximum(q[:, None] + q[None] - 2 * b @ b.T, 1e-30)) for b, q in zip(self.books, squares)]
        self.reach = 2 - 2 * threshold
        if target < 1 and len(unit):
            noise = rng.normal(size=unit.shape)
            noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
            noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
            near = threshold * unit + np.sqrt(max(0.0, 1 - threshold * threshold)) * noise
            own, gaps = self._look(unit)
            theirs, back = self._look(near)
            a, b = self._names(own), self._names(theirs)
            rows = np.arange(len(unit))
            up = gaps[0][rows, theirs[0]] + gaps[1][rows, theirs[1]]       # from the vector to the neighbour's cell
            down = back[0][rows, own[0]] + back[1][rows, own[1]]
            met = np.where(a == b, 0.0, np.where(a > b, up, down))
            self.reach = min(self.reach, float(np.quantile(met, target)) + 1e-12)

    def _look(self, unit: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half: the own codes, and a lower bound of the squared distance to the region of every code."""
        own, gaps = [], []
        for book, apart, x in zip(self.books, self.apart, (unit[:, :self.half], unit[:, self.half:])):
            d = (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)[None, :]
            code = d.argmin(axis=1)
            gap = np.maximum(d - d[np.arange(len(d)), code][:, None], 0) / apart[code]
            own.append(code)
            gaps.append(np.where(np.arange(len(book))[None] == code[:, None], 0.0, gap * gap))
        return own, gaps

    def _names(self, own: list[np.ndarray]) -> np.ndarray:
        return own[0].astype(np.int64) * len(self.books[1]) + own[1]

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, looks): each row's own cell, and the cells of lower number that its visit meets."""
        own, gaps = self._look(unit)
        name = self._names(own)
        rows, cells, width = [], [], len(self.books[1])
        near = [[np.flatnonzero(g <= self.reach) for g in half] for half in gaps]
        for row in range(len(unit)):
            a, b = near[0][row], near[1][row]
            a, b = a[np.argsort(gaps[0][row, a], kind="stable")], b[np.argsort(gaps[1][row, b], kind="stable")]
            for i, j, _ in visits(gaps[0][row, a].tolist(), gaps[1][row, b].tolist(), self.reach):
                cell = int(a[i]) * width + int(b[j])
                if cell < name[row]:
                    rows.append(row)
                    cells.append(cell)
        return (np.concatenate([np.arange(len(unit)), np.array(rows, np.int64)]), np.concatenate([name, np.array(cells, np.int64)]),
                np.concatenate([np.zeros(len(unit), np.int32), np.ones(len(rows), np.int32)]))


def visits(first: list[float], second: list[float], reach: float) -> Iterator[tuple[int, int, float]]:
    """The multi-sequence order: pairs of places in two ascending lists by ascending sum, as long as it is at most `reach`.

    A pair enters the heap when both its neighbours towards the origin have been visited, so the heap holds a
    staircase of pairs and never the grid.
    """
    if not first or not second:
        return
    heap, done = [(first[0] + second[0], 0, 0)], [0] * len(first)      # done[i]: how many pairs (i, 0), (i, 1), ... were visited
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > reach:
            return
        yield i, j, total
        done[i] = j + 1
        if i + 1 < len(first) and done[i + 1] == j:
            heapq.heappush(heap, (first[i + 1] + second[j], i + 1, j))
        if j + 1 < len(second) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    different = np.unique(x, axis=0)
    k = max(1, min(k, len(different)))
    if not len(different):
        return np.zeros((1, x.shape[1]))
    book = different[rng.choice(len(different), k, replace=False)]
    for _ in range(_ROUNDS):
        code = ((book * book).sum(axis=1)[None] - 2 * x @ book.T).argmin(axis=1)
        sums, n = np.zeros_like(book), np.bincount(code, minlength=k)
        np.add.at(sums, code, x)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors in double precision, short ones filled up with zeros."""
    sizes = np.asarray(pc.list_value_length(column))
    flat = np.asarray(column.flatten()).astype(float)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None] < sizes[:, None]] = flat
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, sample: int = SAMPLE,
                    cell_rows: int = CELL_ROWS) -> DataFrame:
    """`id, n_links, component_id` for every row.

    Rows link when their labels are equal and not null, their vectors have one length, and their cosine is at least `threshold`. `component_id` is
    the least id reached over links, the row's own included. A vector that is null, empty, zero or holds a null or non-finite component, and a row
    with a null label or id, links with nothing and is its own component. A repeated row is a row of its own: it links with its copies. Rows
    with one vector and label are compared once and count as often as they occur. Codebooks and reach are
    fitted on the `sample` vectors with the least hashes (more if there are many codes); every vector is indexed.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec"))
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(whole & F.exists("vec", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    group = F.struct("label", F.size("vec").alias("dim"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2"))
    thin = rows.select("id", F.when(usable, group).alias("group"))
    groups = cut_lineage(thin.filter("group is not null").groupBy("group").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    held = rows.filter(usable).withColumn("group", group).select(F.col("id").alias("rep"), "group", "vec")
    same = held.join(groups, ["rep", "group"])        # of a group of copies one id, so none of its keys is hot; repeated rows of it: once each
    reps = cut_lineage(same.groupBy("group", "rep", "n").agg(F.first("vec").alias("vec"))
                       .select("rep", "n", F.concat_ws("/", F.col("group.dim"), F.col("group.label")).alias("part"), "vec"))
    facts = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    links, edges = None, None
    if facts.n:
        parts = reps.select("part").distinct().count()
        codes = max(1, round((facts.n / parts / CELL_VECTORS) ** 0.5))
        sample = max(sample, SAMPLE_PER_CODE * codes)
        picked = reps.orderBy(F.xxhash64("vec"), "rep").limit(sample).select("vec").toArrow().column(0).combine_chunks()
        fitted = _matrix(picked, facts.dim)
        fitted /= np.linalg.norm(fitted, axis=1, keepdims=True)
        grid = Grid(fitted, codes, threshold, target_recall)
        found = cut_lineage(_compare_cells(reps, grid, facts.dim, threshold, cell_rows))
        edges = found.filter("other is not null").select(F.col("rep").alias("id_a"), F.col("other").alias("id_b"))
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = groups.withColumn("own", F.col("n") - 1)
    if links is None:
        named = linked.select("group", "own", F.col("rep").alias("component_id"))
    else:
        label = connected_components(edges).select(F.col("id").alias("rep"), "label")
        named = linked.join(links, "rep", "left").join(label, "rep", "left").select(
            "group", (F.col("own") + F.coalesce("links", F.lit(0))).alias("own"), F.coalesce("label", "rep").alias("component_id"))
    out = lookup(thin, cut_lineage(named), ["group"], "id")
    return out.select("id", F.coalesce("own", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def _compare_cells(reps: DataFrame, grid: Grid, dim: int, threshold: float, cell_rows: int) -> DataFrame:
    """`rep, links, other`: how many vectors a row links with in a cell, and links that connect what links connect."""
    spark = reps.sparkSession
    n_parts = shuffle_partitions(spark)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit = _matrix(part.column(3), dim)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                row, cell, looks = grid.cells(unit)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2).take(take), pa.array(cell), pa.array(looks), part.column(0).take(take),
                     part.column(1).take(take), part.column(3).take(take)], ["part", "cell", "looks", "rep", "n", "vec"])

    spread = reps.select("rep", "n", "part", "vec").mapInArrow(cells, "part string, cell long, looks int, rep long, n long, vec array<double>")
    large = cut_lineage(spread.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > cell_rows)
                        .select("part", "cell", F.ceil(F.col("m") / cell_rows).cast("int").alias("blocks")))
    rows = lookup(spread, large, ["part", "cell"], "rep")
    rows = rows.select("part", "cell", "rep", "n", "vec", F.explode(block_pairs(F.col("rep"), F.col("blocks"), F.col("looks"))).alias("at"))
    rows = rows.select("part", "cell", "at.i", "at.j", "at.side", "rep", "n", "vec")
    dealt = rows.repartition(n_parts, "part", "cell", "i", "j").sortWithinPartitions("part", "cell", "i", "j", "side", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            ends = _run_ends(held)
            if len(ends) > 1:
                yield from _links(held.slice(0, int(ends[-2])), dim, threshold)
                held = held.slice(int(ends[-2]))
        if held is not None and held.num_rows:
            yield from _links(held, dim, threshold)

    return dealt.mapInArrow(compare, "rep long, links long, other long")


def _run_ends(rows: pa.Table) -> np.ndarray:
    """Where runs of one part, cell and block pair end."""
    if not rows.num_rows:
        return np.zeros(0, int)
    part = rows.column("part").combine_chunks().dictionary_encode()
    part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
    keys = [part.indices.to_numpy(), *(rows.column(c).to_numpy() for c in ("cell", "i", "j"))]
    return np.append(np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1, rows.num_rows)


def _links(rows: pa.Table, dim: int, threshold: float) -> Iterator[pa.RecordBatch]:
    side, rep, n = (rows.column(c).to_numpy() for c in ("side", "rep", "n"))
    links, found = np.zeros(len(rep), np.int64), [[], []]
    first = 0
    column = rows.column("vec").combine_chunks()
    for end in _run_ends(rows):
        lo, first = first, int(end)
        if end - lo < 2:
            continue
        unit = _matrix(column.slice(lo, end - lo), dim)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        run, weight = side[lo:end], n[lo:end]
        left = np.flatnonzero(run != 2)
        for at in range(0, len(left), 512):
            part = left[at:at + 512]
            near = unit[part] @ unit.T >= threshold
            near &= (run == 2)[None] | ((run[part] == 0)[:, None] & (np.arange(len(run))[None] > part[:, None]))
            a, b = np.nonzero(near)
            np.add.at(links, lo + part[a], weight[b])
            np.add.at(links, lo + b, weight[part[a]])
            a, b = forest(part[a], b)
            found[0].append(a + lo)
            found[1].append(b + lo)
    if not found[0]:
        return
    a, b = np.concatenate(found[0]), np.concatenate(found[1])
    some = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.nulls(len(some), pa.int64())], ["rep", "links", "other"])
    yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(np.zeros(len(a), np.int64)), pa.array(rep[b])], ["rep", "links", "other"])


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
good AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
