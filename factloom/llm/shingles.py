"""Near duplicates by the exact similarity of their shingle sets.

Texts with one and the same set of shingles are one class. Candidates are classes with a common band, and those that SimHash links;
a candidate becomes a link when the shingles themselves say so. A band is a hash of the minima of six random orders of the
set: two sets of similarity s share one of 20 bands with probability 1 - (1 - s^6)^20, 0.998 at 0.8.

In each band the least class, its owner, is compared with all others first, one join over all bands. Only classes that
don't link with their owner are left to be compared with the rest of the band, in blocks. What SimHash links is compared only
where the links of the bands don't connect it already, so a large group of near copies is not compared again for every cell of every fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from factloom.llm import simhash
from factloom.llm.common import block_pairs, lookup
from factloom.operators.components import connected_components
from factloom.operators.skew import join_unique
from factloom.session import cut_lineage

BANDS = 20
MINIMA = 6               # per band
BLOCK_ROWS = 256         # classes of a band in one task; larger bands are split into pairs of blocks
_BROADCAST = 200         # shingle sets at most
_PART = 1 << 12          # shingles under all orders at a time
_ORDERS = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(base: np.ndarray) -> list[int]:
    """The bands of a set of shingle hashes, as signed 64-bit integers; an empty set has none."""
    if not len(base):
        return []
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max)
    for at in range(0, len(base), _PART):
        least = np.minimum(least, (base[at:at + _PART, None] * _ORDERS).min(axis=0))
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def _sketches(text: Column, shingle_words: int, tables: int) -> Column:
    """`node` (hash of the whole set), `n`, `prints` and `bands` of every text."""
    fields = [("node", pa.int64()), ("n", pa.int64()), ("prints", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))]

    @F.arrow_udf("node long, n long, prints array<long>, bands array<long>")
    def sketch(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            base = np.unique(simhash.shingle_hashes(t, shingle_words))
            node = np.uint64(xxh64_intdigest(base.tobytes(), simhash.SEED)).astype(np.int64)
            rows.append((int(node), len(base), simhash.prints_of(base, tables), bands_of(base)))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)],
                                          names=[name for name, _ in fields])

    return sketch(text.cast("binary"))


def _sets(text: Column, shingle_words: int) -> Column:
    @F.arrow_udf("array<long>")
    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(simhash.shingle_hashes(t, shingle_words)).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return distinct(text.cast("binary"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, shingle_words: int, least: float, max_distance: int, tables: int,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`id, of, label` for every row: `doc_id`, a hash of the text, and the least class that its class reaches over links.

    Two classes link when their shingle sets have a similarity (common shingles by all shingles) of at least `least` and they are
    candidates. Ids play no part. A null text counts as empty; all texts without words are one class.
    """
    found = docs.select(F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("of"),
                        _sketches(F.col("text"), shingle_words, tables).alias("s"))
    rows = cut_lineage(found.select("id", "of", "s.node", "s.n", "s.prints", "s.bands"))
    classes = cut_lineage(rows.dropDuplicates(["node"]))
    cells = cut_lineage(classes.select("node", "n", F.explode("bands").alias("band")))
    owned = cells.groupBy("band").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("size"),
                                      F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all")).filter("size > 1")
    # Bands of the same classes are one.
    owned = owned.groupBy("first", "size", "all").agg(F.min("band").alias("band"))
    owned = cut_lineage(owned.select("band", F.col("first.node").alias("owner"), F.col("first.n").alias("owner_n"), "size"))
    met = cut_lineage(lookup(cells, owned, ["band"], "node").filter("owner != node"))
    pairs = met.filter(_alike("owner_n", "n", least)).select(F.col("owner").alias("id_a"), F.col("node").alias("id_b"))
    pairs = cut_lineage(pairs.distinct())
    owners, near, shared = simhash.table_pairs(classes.select(F.struct("node", "n").alias("rep"), "prints"), max_distance, tables)
    ends = near.select("t", F.col("a").alias("print")).unionByName(near.select("t", F.col("b").alias("print"))).distinct()
    ends = cut_lineage(owners.join(ends, ["t", "print"], "left_semi").select("t", "print", "owner.node", "owner.n"))
    if shared is not None:
        shared = shared.filter(_alike("id_a.n", "id_b.n", least)).select(F.col("id_a.node").alias("id_a"), F.col("id_b.node").alias("id_b"))
        shared = cut_lineage(shared.distinct())

    need = met.select("node").unionByName(met.select(F.col("owner").alias("node"))).unionByName(ends.select("node"))
    if shared is not None:
        need = need.unionByName(shared.select(F.col("id_a").alias("node"))).unionByName(shared.select(F.col("id_b").alias("node")))
    need = classes.join(need.distinct(), "node", "left_semi").select("node", F.col("id").alias("_id"), F.col("of").alias("_of"))
    texts = docs.join(need, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_hash(F.col("text")) == F.col("_of")))
    texts = texts.select("node", "text").dropDuplicates(["node"])
    sets = cut_lineage(texts.select("node", _sets(F.col("text"), shingle_words).alias("set")))

    links = _verified(pairs, sets, least)
    links = links.unionByName(_rest(met, links, sets, least, block_rows))
    labels = connected_components(links)
    more = _open(near, ends, labels, least)
    if shared is not None:
        more = more.unionByName(shared)
    found = _verified(cut_lineage(more.distinct().join(pairs, ["id_a", "id_b"], "left_anti")), sets, least)
    if not found.isEmpty():
        labels = connected_components(labels.select(F.col("id").alias("id_a"), F.col("label").alias("id_b")).unionByName(found))
    labels = labels.select(F.col("id").alias("node"), "label")
    return lookup(rows.select("id", "of", "node"), labels, ["node"], "id").select("id", "of", F.coalesce("label", "node").alias("label"))


def _with(pairs: DataFrame, right: DataFrame, side: str, other: str, asked: DataFrame) -> DataFrame:
    """The pairs with what `right` has about the node of one side; a node in many pairs does not fill one task. `asked` holds the same
    pairs without what earlier joins added, so that counting them joins nothing."""
    key, value = f"id_{side}", right.columns[1]
    spread = pairs.withColumn("_row", F.pmod(F.xxhash64(f"id_{other}"), F.lit(1 << 40)))
    named = right.select(F.col("node").alias(key), F.col(value).alias(f"{value}_{side}"))
    named = named.join(asked.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
    return join_unique(spread, named, [key], "_row", weight="_n", small=_BROADCAST).drop("_row", "_n")


def _alike(n_a: str, n_b: str, least: float) -> Column:
    """Whether sets of so many shingles can have the similarity."""
    return F.least(n_a, n_b) / F.greatest(n_a, n_b) >= least


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose shingle sets have the similarity."""
    full = _with(_with(pairs, sets, "a", "b", pairs), sets, "b", "a", pairs)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return cut_lineage(full.filter(common / (F.size("set_a") + F.size("set_b") - common) >= least).select("id_a", "id_b"))


def _open(near: DataFrame, ends: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """`id_a, id_b`: the classes of near fingerprints `a, b, t` that links don't connect yet; `ends` names the class of every fingerprint."""
    labels = labels.select(F.col("id").alias("node"), "label")
    known = ends.join(labels, "node", "left").select("t", "print", F.struct("node", "n", F.coalesce("label", "node").alias("label")).alias("of"))
    known = cut_lineage(known)
    left = known.select("t", F.col("print").alias("a"), F.col("of").alias("of_a"))
    right = known.select("t", F.col("print").alias("b"), F.col("of").alias("of_b"))
    full = lookup(cut_lineage(lookup(near, left, ["t", "a"], "b")), right, ["t", "b"], "a")
    full = full.filter(_alike("of_a.n", "of_b.n", least) & (F.col("of_a.label") != F.col("of_b.label")))
    return full.select(F.least("of_a.node", "of_b.node").alias("id_a"), F.greatest("of_a.node", "of_b.node").alias("id_b"))


def _rest(met: DataFrame, links: DataFrame, sets: DataFrame, least: float, block_rows: int) -> DataFrame:
    """`id_a, id_b`: links of the classes that don't link with the owner of their band, with all others in the band."""
    linked = links.select(F.col("id_a").alias("owner"), F.col("id_b").alias("node"), F.lit(1).alias("looks"))
    members = met.filter("size > 2").join(linked, ["owner", "node"], "left").fillna(0, ["looks"])
    members = cut_lineage(members.select("band", "node", "looks"))
    loose = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("looks").alias("tied")).filter("tied = 0")
    loose = cut_lineage(loose.select("band", F.ceil(F.col("size") / block_rows).cast("int").alias("blocks")))
    left = cut_lineage(lookup(members, loose, ["band"], "node").filter("blocks is not null"))
    spread = left.withColumn("_row", F.pmod(F.xxhash64("band"), F.lit(1 << 40)))
    left = join_unique(spread, sets, ["node"], "_row", small=_BROADCAST).drop("_row")
    dealt = left.select("band", "node", "set", F.explode(block_pairs(F.col("node"), F.col("blocks"), F.col("looks"))).alias("at"))
    dealt = dealt.select("band", "at.i", "at.j", "at.side", "node", "set")

    def compare(block: pa.Table) -> pa.Table:
        return _links(block, least)

    return cut_lineage(dealt.groupBy("band", "i", "j").applyInArrow(compare, "id_a long, id_b long"))


def _links(block: pa.Table, least: float) -> pa.Table:
    """Side 0 is compared with its whole block, side 1 with side 2; rows that links connect already are not compared again."""
    block = block.sort_by([("side", "ascending"), ("node", "ascending")])
    side, node = block["side"].to_numpy(), block["node"].to_numpy()
    sets = [np.asarray(s, dtype=np.int64) for s in block["set"].to_pylist()]
    n = np.array([len(s) for s in sets])
    label = np.arange(len(node))
    found = []
    for x in np.flatnonzero(side != 2):
        may = (np.arange(len(node)) > x) & (label != label[x]) & (np.minimum(n, n[x]) / np.maximum(n, n[x]) >= least)
        if side[x] == 1:
            may &= side == 2
        others = np.flatnonzero(may)
        if not len(others):
            continue
        own = np.sort(sets[x])
        every = np.concatenate([sets[y] for y in others])
        at = np.searchsorted(own, every)
        same = own[np.minimum(at, len(own) - 1)] == every
        common = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(n[others])[:-1]]))
        for y in others[common / (n[others] + n[x] - common) >= least]:
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                found.append((node[x], node[y]))
    a, b = zip(*found) if found else ((), ())
    return pa.table({"id_a": pa.array(a, pa.int64()), "id_b": pa.array(b, pa.int64())})
