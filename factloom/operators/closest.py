"""Matching texts to the closest candidate by Jaro-Winkler similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.skew import join_unique
from factloom.session import cut_lineage, shuffle_partitions

HELD_CANDIDATES = 20_000     # most candidates handed to every task
HELD_BYTES = 16 << 20
BLOCK_ROWS = 2_000
BUCKETS = 64                 # of characters in a signature


def matching_form(c: Column) -> Column:
    """Whitespace removed, lower case."""
    return F.lower(F.regexp_replace(c, r"[ \t\n\x0B\f\r]", ""))


def jaro_winkler(a: str, b: str) -> float:
    """Similarity in single precision; the prefix bonus has no length limit and needs 0.7 or more."""
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    window = max(len(long) // 2 - 1, 0)
    free = [True] * len(long)
    hits_short = []
    for i, ch in enumerate(short):
        j = long.find(ch, max(i - window, 0), i + window + 1)
        while j >= 0 and not free[j]:
            j = long.find(ch, j + 1, i + window + 1)
        if j >= 0:
            free[j] = False
            hits_short.append(ch)
    m = len(hits_short)
    if not m:
        return 0.0
    hits_long = [ch for ch, f in zip(long, free) if not f]
    swaps = sum(x != y for x, y in zip(hits_short, hits_long)) // 2
    f32 = np.float32
    fm = f32(m)
    jaro = (fm / f32(len(a)) + fm / f32(len(b)) + (fm - f32(swaps)) / fm) / f32(3)
    if float(jaro) < 0.7:
        return float(jaro)
    prefix = 0
    while prefix < len(short) and short[prefix] == long[prefix]:
        prefix += 1
    bonus = min(f32(0.1), f32(1) / f32(len(long))) * f32(prefix) * (f32(1) - jaro)
    return float(jaro + bonus)


def closest_match_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, order: str,
                       held: int = HELD_CANDIDATES) -> DataFrame:
    """`left` with `match` (the closest `right_text`) and `similarity`.

    Of equally close candidates the one with the least `order` wins. Each distinct text is
    scored once, and only with candidates whose bound is not below the best similarity so far. Candidates up to a counted number are handed to every task; more than
    that are split into blocks and each block of texts meets each block of candidates in
    a task of its own.
    """
    texts = left.select(matching_form(F.col(left_text)).alias("form")).filter("form is not null").distinct()
    cands = (right.filter(F.col(right_text).isNotNull())
             .groupBy(matching_form(F.col(right_text)).alias("cand"))
             .agg(F.min(F.struct(F.col(order).cast("long").alias("ord"), F.col(right_text).alias("match"))).alias("m"))
             .select("cand", "m.ord", "m.match"))
    size = cands.limit(held + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("cand")).alias("bytes")).first()
    schema = "form string, ord long, similarity double"
    if size.n <= held and (size.bytes or 0) <= HELD_BYTES:
        table = cands.select("cand", "ord").toArrow()
        shared = left.sparkSession.sparkContext.broadcast(list(zip(table.column("ord").to_pylist(), table.column("cand").to_pylist())))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = _Candidates(shared.value)
            for batch in batches:
                yield _best(batch["form"], known)

        # Little data can be much scoring, so the texts are spread over all tasks.
        scored = texts.repartition(shuffle_partitions(left.sparkSession), "form").mapInPandas(scan, schema)
    else:
        n_right = max(1, -(-cands.count() // BLOCK_ROWS))
        n_left = max(1, -(-texts.count() // BLOCK_ROWS))
        lhs = texts.select("form", F.pmod(F.xxhash64("form"), F.lit(n_left)).alias("lb"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_right - 1).cast("long"))).alias("rb"))
        rhs = cands.select("cand", "ord", F.pmod(F.xxhash64("cand"), F.lit(n_right)).alias("rb"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long"))).alias("lb"))

        def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return _best(a["form"], _Candidates(list(zip(b["ord"], b["cand"]))))

        scored = lhs.groupBy("lb", "rb").cogroup(rhs.groupBy("lb", "rb")).applyInPandas(block, schema)
    best = W.partitionBy("form").orderBy(F.desc("similarity"), "ord")
    won = scored.withColumn("r", F.row_number().over(best)).filter("r = 1").withColumn("at", F.abs(F.xxhash64("form")))
    won = join_unique(cut_lineage(won), cands.select("ord", "match"), ["ord"], "at").select("form", "match", "similarity")
    # A text may be that of very many rows, a candidate the match of very many texts.
    keyed = left.withColumn("form", matching_form(F.col(left_text))).withColumn("_at", F.monotonically_increasing_id())
    return join_unique(keyed, won, ["form"], "_at").drop("form", "_at")


class _Candidates:
    """Candidates by `order`, with a signature each: how often the characters of every bucket occur.

    Two texts can't have more matching characters than the sum of the lesser counts, so the signatures bound the similarity
    of a text with all candidates at once.
    """

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        rows = sorted(rows)
        self.orders, self.texts = [o for o, _ in rows], [t for _, t in rows]
        self.place = {t: i for i, t in enumerate(self.texts)}
        self.sizes = np.array([len(t) for t in self.texts], np.float64)
        self.first = np.array([ord(t[0]) if t else -1 for t in self.texts])
        self.counts = np.array([signature(t) for t in self.texts], np.int32).reshape(-1, BUCKETS)

    def bounds(self, form: str) -> np.ndarray:
        """No less than the similarity of the text with each candidate."""
        most = np.minimum(self.counts, signature(form)[None]).sum(axis=1)
        size = float(len(form))
        short, long = np.minimum(self.sizes, size), np.maximum(self.sizes, size)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(most > 0, (most / size + most / self.sizes + 1) / 3, 0.0)
            prefix = np.where(self.first == (ord(form[0]) if form else -2), np.minimum(most, short), 0)
            bound = jaro + np.where(long > 0, np.minimum(0.1, 1 / long), 0.0) * prefix * (1 - jaro)
        return np.where(short > 0, bound, np.where(long > 0, 0.0, 1.0)) + 1e-5

    def best(self, form: str) -> tuple[int, float] | None:
        """(order, similarity) of the closest candidate, the least order of equals; candidates are visited by their bounds."""
        if form in self.place:
            return self.orders[self.place[form]], 1.0
        if not self.texts:
            return None
        bounds = self.bounds(form)
        top, at = -1.0, 0
        for i in np.argsort(-bounds, kind="stable").tolist():
            if bounds[i] < top:
                break
            s = jaro_winkler(form, self.texts[i])
            if s > top or (s == top and self.orders[i] < self.orders[at]):
                top, at = s, i
        return self.orders[at], top


def signature(text: str) -> np.ndarray:
    return np.bincount(np.fromiter(map(ord, text), np.int64, len(text)) % BUCKETS, minlength=BUCKETS).astype(np.int32)


def _best(forms: pd.Series, cands: _Candidates) -> pd.DataFrame:
    found = [(form, cands.best(form)) for form in forms]
    return pd.DataFrame([(form, *hit) for form, hit in found if hit is not None], columns=["form", "ord", "similarity"])
