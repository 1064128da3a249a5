"""Unit vectors out of Arrow list columns, and top-k scoring of one block against another.

These helpers run inside tasks on data that Spark has already partitioned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCORE_DIGITS = 9        # scores closer than this count as equal, so that ties are broken by id
NO_FLOOR = -1.5         # below every cosine
EXCLUDED = -9.0         # a pair that must not appear
_CELLS_PER_PASS = 4_000_000
_TILE = (256, 2048)     # queries by base rows whose products are looked at together, so that they stay in a core's cache
_PIECE_ROWS = 128       # rows of a cell that are looked at together
_MOST_PAIRS = 2_000_000  # pairs that a search by pieces may hold
_FIRST_ROWS = 512       # base rows of the first pass; each pass takes twice as many, with the floors that the ones before gave


def unit_rows(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, usable flags) of a list<float> column; missing and zero vectors are not usable."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    present = np.asarray(pc.is_valid(col))
    values = np.asarray(col.flatten().cast(pa.float64()))
    if values.size != int(present.sum()) * dim:
        raise ValueError(f"all vectors must have {dim} dimensions")
    out = np.zeros((n, dim))
    out[present] = values.reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    usable = norm > 0
    out[usable] /= norm[usable, None]
    return out, usable


def tag_matrix(col: pa.Array, vocabulary: dict[str, int]) -> np.ndarray:
    """Rows by vocabulary: 1 where the row's tag array has the tag."""
    out = np.zeros((len(col), len(vocabulary)), dtype=np.float32)
    for i, tags in enumerate(col.to_pylist()):
        for t in tags or ():
            j = vocabulary.get(t)
            if j is not None:
                out[i, j] = 1
    return out


class Block:
    """One side of a scoring step: ids with unit vectors and, where used, order numbers, floors, tags."""

    def __init__(self, ids, unit, usable, seq=None, floor=None, tags=None, single=None, lead=None):
        self.ids, self.unit, self.usable = ids, unit, usable
        self.seq, self.floor, self.tags = seq, floor, tags
        self.single = unit.astype(np.float32) if single is None else single
        self.lead = lead        # what `Turn.lead` made of the vectors

    def take(self, index) -> "Block":
        def pick(a):
            return None if a is None else a[index]
        return Block(self.ids[index], self.unit[index], self.usable[index], pick(self.seq), pick(self.floor),
                     pick(self.tags), self.single[index], pick(self.lead))


class Turn:
    """A rotation that brings what most of the given vectors have into few leading numbers.

    Of two unit vectors the product of their leading numbers plus the product of the lengths of what is left is no less than
    their cosine (Cauchy-Schwarz). So the pairs of a high floor are found among the leading numbers, whatever the
    vectors; the rotation decides how many others are looked at, never which pairs count.
    """

    def __init__(self, unit: np.ndarray):
        energy, axes = np.linalg.eigh(unit.T @ unit / max(1, len(unit)))
        self.energy, self.axes = np.maximum(energy[::-1], 0.0), axes[:, ::-1]

    def width(self, floor: float) -> int:
        """The leading numbers by which unrelated pairs mostly miss the floor; 0 where whole vectors cost no more."""
        for m in range(8, len(self.energy) * 5 // 8 + 1, 8):
            rest, spread = self.energy[m:].sum(), np.sqrt((self.energy[:m] ** 2).sum())
            if rest + 3.2 * spread <= floor:
                return m
        return 0

    def lead(self, block: Block, m: int) -> Block:
        """`block` with its `m` leading numbers and the length of the rest."""
        lead = np.empty((len(block.unit), m + 1), np.float32)
        first = block.unit @ self.axes[:, :m]
        lead[:, :m] = first
        lead[:, m] = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", first, first)) + 1e-12)
        return Block(block.ids, block.unit, block.usable, block.seq, block.floor, block.tags, block.single, lead)


def turned(q: Block, b: Block) -> tuple[Block, Block]:
    """Both sides with leading numbers, where these spare work."""
    if q.floor is None or np.isnan(q.floor).any() or not len(q.ids) or not len(b.ids):
        return q, b
    turn = Turn(q.unit)
    m = turn.width(q.floor.min())
    return (turn.lead(q, m), turn.lead(b, m)) if m else (q, b)


def block_from(table, id_col: str, dim: int, seq: bool, floor: bool = False) -> Block:
    """A block out of an Arrow table with columns `id_col`, `vec` and the optional ones."""
    unit, usable = unit_rows(table.column("vec"), dim)
    return Block(
        np.asarray(table.column(id_col)), unit, usable,
        np.asarray(table.column("seq")) if seq else None,
        np.asarray(table.column("floor").cast(pa.float64())) if floor else None)


def by_pieces(q: Block, b: Block, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs (rows of q, rows of b) that may reach the lowest floor, where b lies in cells of like vectors; None if looking at all pairs is no dearer.

    The rows of a cell are taken by their angle to its mean, in pieces; by the triangle inequality on angles a query
    further from the mean than its reach and the largest angle of a piece has no such row there.
    """
    floor = float(q.floor.min()) - _margin(q.unit.shape[1])
    order = np.argsort(cell, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
    mean = np.add.reduceat(b.unit[order], start, axis=0)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    mean = np.divide(mean, norm, out=np.zeros_like(mean), where=norm > 0)
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(order)]))
    angle = np.arccos(np.clip(np.einsum("ij,ij->i", b.unit[order], mean[group]), -1.0, 1.0))
    inner = np.lexsort((angle, group))
    order, angle = order[inner], angle[inner]
    piece = np.flatnonzero((np.arange(len(order)) - start[group]) % _PIECE_ROWS == 0)
    ends = np.r_[piece[1:], len(order)]
    reach = angle[ends - 1] + np.arccos(np.clip(floor, -1.0, 1.0)) + 1e-4      # more than single precision errs here
    least = np.where(reach < np.pi, np.cos(np.minimum(reach, np.pi)), -2.0).astype(np.float32)
    if (ends - piece).mean() < _PIECE_ROWS / 16:
        return None                                         # too few rows of a cell came together
    probe = q.single[:: max(1, len(q.ids) // 512)] @ mean[group[piece]].T.astype(np.float32)
    if ((probe >= least) * (ends - piece)).mean() > 0.6 * (ends - piece).mean():
        return None
    mine, other = (q.single, b.single) if q.lead is None else (q.lead, b.lead)
    cut = (q.floor - _margin(q.unit.shape[1])).astype(np.float32)
    rows, cols, n = [], [], 0
    per = max(1, _CELLS_PER_PASS // len(q.ids))
    for lo in range(0, len(start), per):
        toward = mean[lo:lo + per].astype(np.float32) @ q.single.T
        first, last = np.searchsorted(group[piece], [lo, lo + per])
        for p in range(first, last):
            able = np.flatnonzero(toward[group[piece[p]] - lo] >= least[p])
            at = order[piece[p]:ends[p]]
            if len(able):
                found = _reaching(mine[able], other[at], cut[able], _MOST_PAIRS - n)
                if found is None:
                    return None
                n += len(found[0])
                rows.append(able[found[0]])
                cols.append(at[found[1]])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def top_pairs(q: Block, b: Block, k: int, exclude_self: bool, cell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k best base rows by (score down, id up): arrays query id, base id, score.

    A query's `floor` (NaN for none) is the least score that counts. `cell` tells which rows of b are alike.
    """
    at = None if cell is None else by_pieces(q, b, cell)
    if at is not None:
        return merge_top([_few(q, b, *at, exclude_self)], k)
    best = merge_top([], k)
    floor = np.full(len(q.ids), np.nan) if q.floor is None else q.floor.copy()
    q = Block(q.ids, q.unit, q.usable, q.seq, floor, q.tags, q.single, q.lead)
    lo, width = 0, _FIRST_ROWS
    while lo < len(b.ids):
        part = b.take(slice(lo, lo + width))
        step = max(1, _CELLS_PER_PASS // len(part.ids))
        found = [best]
        for at in range(0, len(q.ids), step):
            found.append(merge_top([_top_pass(q.take(slice(at, at + step)), part, k, exclude_self)], k))    # a pass keeps no more than k
        best = merge_top(found, k)
        lo, width = lo + width, 2 * width
        if lo < len(b.ids):
            raise_floors(q, best, k)
    return best


def raise_floors(q: Block, best: tuple, k: int) -> None:
    """Floors of `q` up to the k-th score of a query that has k hits in `best`: nothing below it can be among its k best."""
    ids, _, score = best
    if not len(ids):
        return
    end = np.flatnonzero(np.r_[ids[1:] != ids[:-1], True])
    full = end[np.diff(np.r_[-1, end]) >= k]
    if len(full):
        at = np.minimum(np.searchsorted(ids[full], q.ids), len(full) - 1)
        has = ids[full][at] == q.ids
        q.floor[has] = np.fmax(q.floor[has], score[full][at][has])


def _margin(dim: int) -> float:
    """More than a score of single precision can be wrong."""
    return (dim + 8) * 2.0 ** -24 + 10.0 ** -SCORE_DIGITS


def _reaching(q: np.ndarray, b: np.ndarray, cut: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs (rows of q, rows of b) whose product is at least the query's `cut`; None when there are more than `most`."""
    held, flags = np.empty(_TILE[0] * _TILE[1], np.float32), np.empty(_TILE[0] * _TILE[1], bool)
    rows, cols, n = [], [], 0
    high = max(_TILE[0], len(held) // max(1, min(len(b), _TILE[1])))
    for lo in range(0, len(q), high):
        mine = q[lo:lo + high]
        for at in range(0, len(b), _TILE[1]):
            other = b[at:at + _TILE[1]].T
            wide = other.shape[1]
            size = len(mine) * wide
            s, near = held[:size].reshape(len(mine), wide), flags[:size]
            np.matmul(mine, other, out=s)
            np.greater_equal(s, cut[lo:lo + high, None], out=near.reshape(s.shape))
            hit = _set_flags(flags, size)
            if len(hit):
                n += len(hit)
                if most is not None and n > most:
                    return None
                i = hit // wide
                rows.append(i + lo)
                cols.append(hit - i * wide + at)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def _set_flags(flags: np.ndarray, size: int) -> np.ndarray:
    """Where the first `size` flags are set; 64 are passed over at a time, as few are. Those up to the next multiple of 64 are cleared."""
    words = -(-size // 64) * 8
    flags[size:8 * words] = False
    some = flags.view(np.uint64)[:words] != 0
    at = np.flatnonzero(some.view(np.uint64))
    for held in (some, flags):
        i, j = np.nonzero(held.reshape(-1, 8)[at])
        at = at[i] * 8 + j
    return at


def _top_pass(q: Block, b: Block, k: int, exclude_self: bool):
    """One pass over all pairs in single precision, whose error is bounded, then the few pairs that can count
    again in double precision."""
    n, margin = len(b.ids), _margin(q.unit.shape[1])
    floor = np.where(np.isnan(q.floor), NO_FLOOR, q.floor)
    cut, few = floor - margin, max(k, n // 16) * len(q.ids)
    at = None
    if q.lead is not None:
        at = _reaching(q.lead, b.lead, cut.astype(np.float32), few)
    if at is None and cut.max() > -1.0:
        at = _reaching(q.single, b.single, cut.astype(np.float32), few)
    if at is not None:          # few pairs reach their floor: only these are looked at
        return _few(q, b, *at, exclude_self)
    s = q.single @ b.single.T
    s[:, ~b.usable] = EXCLUDED
    s[~q.usable] = EXCLUDED
    if q.tags is not None:
        asked = q.tags.sum(axis=1) > 0
        hit = (q.tags @ b.tags.T) > 0
        s[asked[:, None] & ~hit] = EXCLUDED
    if q.seq is not None:
        s[b.seq[None, :] >= q.seq[:, None]] = EXCLUDED
    if exclude_self:
        s[q.ids[:, None] == b.ids[None, :]] = EXCLUDED
    if n > k:       # rows with many pairs above their floor: nothing far below the k-th best can count
        many = np.nonzero((s >= cut[:, None].astype(np.float32)).sum(axis=1) > 4 * k)[0]
        if len(many):
            kth = np.partition(s[many], n - k, axis=1)[:, n - k]
            cut[many] = np.maximum(cut[many], kth - 2 * margin)
    qi, bi = np.nonzero(s >= cut[:, None])
    score = np.round(_exact_scores(q.unit, b.unit, qi, bi), SCORE_DIGITS)
    keep = score >= np.round(floor[qi], SCORE_DIGITS)
    return q.ids[qi[keep]], b.ids[bi[keep]], score[keep]


def _few(q: Block, b: Block, qi: np.ndarray, bi: np.ndarray, exclude_self: bool):
    """The pairs among the given ones that count, with their scores."""
    keep = q.usable[qi] & b.usable[bi]
    if q.tags is not None:
        keep &= (q.tags[qi].sum(axis=1) == 0) | ((q.tags[qi] * b.tags[bi]).sum(axis=1) > 0)
    if q.seq is not None:
        keep &= b.seq[bi] < q.seq[qi]
    if exclude_self:
        keep &= q.ids[qi] != b.ids[bi]
    qi, bi = qi[keep], bi[keep]
    score = np.round(_exact_scores(q.unit, b.unit, qi, bi), SCORE_DIGITS)
    floor = q.floor[qi]
    keep = score >= np.round(np.where(np.isnan(floor), NO_FLOOR, floor), SCORE_DIGITS)
    return q.ids[qi[keep]], b.ids[bi[keep]], score[keep]


def link_pairs(q: Block, b: Block, cell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between ids that connect every query with the base rows that reach its floor, as few as will do; scores are zero.

    Single precision decides, with its error on the side of a link.
    """
    cut = (np.where(np.isnan(q.floor), NO_FLOOR, q.floor) - _margin(q.unit.shape[1])).astype(np.float32)
    ids, at = np.unique(np.concatenate([q.ids, b.ids]), return_inverse=True)
    q_at, b_at, label = at[:len(q.ids)], at[len(q.ids):], np.arange(len(ids))
    step = max(1, _CELLS_PER_PASS // max(1, len(b.ids)) // _TILE[0]) * _TILE[0]
    known = None if cell is None else by_pieces(q, b, cell)
    if known is not None:
        i, j = known
        near = (_exact_scores(q.unit, b.unit, i, j) >= cut[i]) & q.usable[i] & b.usable[j]
        label = _joined(label, q_at[i[near]], b_at[j[near]])
    for lo in range(0, len(q.ids) if known is None else 0, step):
        mine = q.take(slice(lo, lo + step))
        if q.lead is None:
            i, j = _reaching(mine.single, b.single, cut[lo:lo + step])
        else:
            i, j = _reaching(mine.lead, b.lead, cut[lo:lo + step])
            near = _exact_scores(mine.unit, b.unit, i, j) >= cut[lo + i]
            i, j = i[near], j[near]
        both = b.usable[j] & mine.usable[i]
        i, j = i[both], j[both]
        label = _joined(label, q_at[lo + i], b_at[j])
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]], np.zeros(len(moved))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member of each group) after linking a with b."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def _exact_scores(q: np.ndarray, b: np.ndarray, qi: np.ndarray, bi: np.ndarray) -> np.ndarray:
    out = np.empty(len(qi))
    step = max(1, _CELLS_PER_PASS // q.shape[1])
    for lo in range(0, len(qi), step):
        part = slice(lo, lo + step)
        out[part] = np.einsum("ij,ij->i", q[qi[part]], b[bi[part]])
    return out


def merge_top(parts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several top lists into one, k best per query."""
    parts = [p for p in parts if len(p[0])]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    qid, bid, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((bid, -score, qid))
    qid, bid, score = qid[order], bid[order], score[order]
    start = np.r_[True, qid[1:] != qid[:-1]]
    rank = np.arange(len(qid)) - np.maximum.accumulate(np.where(start, np.arange(len(qid)), 0))
    keep = rank < k
    return qid[keep], bid[keep], score[keep]


def pairs_batch(qid, bid, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qid, pa.int64()), pa.array(bid, pa.int64()), pa.array(score, pa.float64())],
        names=["query_id", "id", "s"])
