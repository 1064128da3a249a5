"""Secret scan: rules of three kinds, and a character network over every other candidate.

A candidate is any run of twelve and more token characters that no rule's match touches. A convolutional network in numpy reads the candidate
with the characters around it, and once more alone; the candidates that reach its threshold either way are added as spans of kind `net`. It is trained on findings: what the
rules find, labelled secret, and candidates that no rule finds, labelled harmless. The characters around a training finding are blanked half of the time,
so that the look of a value counts also where no keyword stands before it.

All findings are learned from. A start is fitted on a few; then four fifths of all findings are dealt to buckets, each bucket goes on from the start in a
task of its own, and the weights of the buckets are averaged. The calibration and the threshold come from all of the last fifth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.calibration import platt, sigmoid
from factloom.session import cut_lineage, shuffle_partitions

# The rules, the least length of what they find, and the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")        # whole runs: the same matches as runs of any length of which the short ones are dropped
KEYWORDS = ("passw", "secret", "token", "api")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "net")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
AROUND, PIECE, PIECE_STEP = 24, 48, 32     # characters before and after; of a candidate read at once; to the next piece
LENGTH = 2 * AROUND + PIECE
SAMPLE_PER_CLASS = 2000                    # findings that the start is fitted on, per label
BUCKET_ROWS = 16384                        # about so many findings go on from the start in one task
PASS_RATE = 0.01                           # of the steps of a bucket
LEAST_RECALL = 0.95                        # of the secrets kept out of the training, that the threshold must leave
_FILTERS, _WIDTH, _SIZE = 24, 5, 8
_EPOCHS, _BATCH = 12, 64


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def rule_spans(text: str) -> list[Span]:
    """What the rules find, by start and then kind. Per kind the leftmost matches that don't overlap; those too short are dropped."""
    found = []
    small = text.lower()
    if any(k in small for k in KEYWORDS):
        found += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs of token characters, of letters alone too, that touch no span; `taken` is in order of start."""
    out, at, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at].start < m.end():
            reach = max(reach, taken[at].end)
            at += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def value_span(text: str, span: Span) -> tuple[int, int]:
    """Where the value of a rule's match stands: of an assignment what is assigned, else all."""
    return ASSIGN.match(text, span.start).span(2) if span.kind == "assign" else (span.start, span.end)


def pieces(text: str, start: int, end: int) -> list[str]:
    """The views of a value: every piece of it, overlapping, with the characters around the piece. Always LENGTH characters."""
    views = []
    for lo in range(start, max(start + 1, end - PIECE + PIECE_STEP), PIECE_STEP):
        hi = min(lo + PIECE, end)
        views.append(text[max(0, lo - AROUND):lo].rjust(AROUND, "\0") + text[lo:hi].ljust(PIECE, "\0") + text[hi:hi + AROUND].ljust(AROUND, "\0"))
    return views


def _codes(views: list[str]) -> np.ndarray:
    """Characters as numbers: ASCII as it is, the rest as one."""
    flat = np.frombuffer("".join(views).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(flat, 128).astype(np.int64).reshape(len(views), LENGTH)


@dataclass
class Network:
    """Character vectors with a mark for the value's place, one layer of filters, the largest answer of each, a logit."""
    chars: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1        # above every probability: adds nothing until it is fitted

    @staticmethod
    def fresh(seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        return Network(rng.normal(size=(129, _SIZE)) * 0.3, rng.normal(size=(_WIDTH * (_SIZE + 1), _FILTERS)) * 0.2,
                       np.zeros(_FILTERS), rng.normal(size=_FILTERS) * 0.2, np.zeros(1))

    def _answers(self, codes: np.ndarray) -> tuple:
        place = np.zeros((len(codes), LENGTH, 1))
        place[:, AROUND:AROUND + PIECE] = 1
        x = np.concatenate([self.chars[codes], place], axis=2)
        view = np.lib.stride_tricks.sliding_window_view(x, _WIDTH, axis=1).transpose(0, 1, 3, 2)
        view = view.reshape(len(codes), LENGTH - _WIDTH + 1, -1)
        answer = view @ self.filters + self.bias
        top = answer.argmax(axis=1)
        best = np.take_along_axis(answer, top[:, None], axis=1)[:, 0]
        return np.maximum(best, 0), best, top, view

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._answers(codes[at:at + 512])[0] @ self.out + self.out_bias[0] for at in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.logits(codes) + self.shift)

    def learn(self, codes: np.ndarray, truth: np.ndarray, sums: dict, rate: float = 0.05, weight: np.ndarray | float = 1.0) -> None:
        pooled, best, top, view = self._answers(codes)
        off = weight * (sigmoid(pooled @ self.out + self.out_bias[0]) - truth) / len(truth)
        d_best = off[:, None] * self.out * (best > 0)
        picked = np.take_along_axis(view, top[:, :, None], axis=1)            # the window behind each filter's largest answer
        d_filters = np.einsum("nfd,nf->df", picked, d_best)
        d_window = (d_best[:, :, None] * self.filters.T[None]).reshape(*d_best.shape, _WIDTH, _SIZE + 1)[..., :_SIZE]
        at = codes[np.arange(len(codes))[:, None, None], top[:, :, None] + np.arange(_WIDTH)]
        d_chars = np.zeros_like(self.chars)
        np.add.at(d_chars, at, d_window)
        for name, g in (("chars", d_chars), ("filters", d_filters), ("bias", d_best.sum(axis=0)), ("out", off @ pooled), ("out_bias", np.array([off.sum()]))):
            seen = sums.setdefault(name, np.full_like(getattr(self, name), 1e-6))
            seen += g * g
            setattr(self, name, getattr(self, name) - rate * g / np.sqrt(seen))


def fit(views: list[str], labels: list[int], seed: int = 9) -> Network:
    """A network fitted on four fifths of the findings. On the rest its logit is calibrated to a probability, and the threshold is the
    largest that leaves LEAST_RECALL of the secrets there when no keyword stands beside them, whatever that lets through of the others. Without
    findings of both labels nothing is added."""
    net, rng, truth = Network.fresh(), np.random.default_rng(seed), np.array(labels, float)
    if len(set(truth)) < 2:
        return net
    codes, order = _codes(views), rng.permutation(len(views))
    aside, rest = order[:len(order) // 5], order[len(order) // 5:]
    if len(set(truth[aside])) < 2 or len(set(truth[rest])) < 2:
        aside = rest = order
    sums: dict = {}
    groups = [rest[truth[rest] == k] for k in (0, 1)]
    for _ in range(_EPOCHS * -(-len(rest) // _BATCH)):
        batch = np.concatenate([rng.choice(g, _BATCH // 2) for g in groups])
        net.learn(_blanked(codes[batch], rng), truth[batch], sums)
    logit = net.logits(_blanked(codes[aside], rng))
    net.scale, net.shift = platt(logit, truth[aside])
    found = np.sort(net.probabilities(_alone(codes[aside[truth[aside] == 1]])))
    net.threshold = float(found[int((1 - LEAST_RECALL) * len(found))])
    return net


def _alone(codes: np.ndarray) -> np.ndarray:
    """The views with nothing around the value."""
    codes = codes.copy()
    codes[:, :AROUND] = 0
    codes[:, AROUND + PIECE:] = 0
    return codes


def _blanked(codes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return np.where((rng.random(len(codes)) < 0.5)[:, None], _alone(codes), codes)


def every_finding(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`view, label` (1 for what a rule finds and 0 for other candidates): all different findings of all documents."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, truth = [], []
            for text in batch.column(0).to_pylist():
                spans = rule_spans(text or "")
                for at, label in [*((value_span(text, s), 1) for s in spans), *((c, 0) for c in candidates(text or "", spans))]:
                    views.append(pieces(text, *at)[0])
                    truth.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(views, pa.string()), pa.array(truth, pa.int32())], ["view", "label"])

    return cut_lineage(docs.select(F.col(text_col)).mapInArrow(find, "view string, label int").distinct())


def _least(every: DataFrame, per_class: int) -> tuple[list[str], list[int]]:
    sample = []
    for k in (0, 1):
        sample += every.filter(F.col("label") == k).orderBy(F.xxhash64("view"), "view").limit(per_class).collect()
    return [r.view for r in sample], [r.label for r in sample]


def findings(docs: DataFrame, text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> tuple[list[str], list[int]]:
    """At most `per_class` different findings of each label over all documents, those with the least hashes."""
    return _least(every_finding(docs, text_col), per_class)


def train(docs: DataFrame, text_col: str = "text", per_class: int = SAMPLE_PER_CLASS, bucket_rows: int = BUCKET_ROWS) -> Network:
    """A network fitted, calibrated and given its threshold on all findings. Up to `per_class` of each label `fit` takes them all at once.

    Findings are dealt by hashes of their views, and weights are summed as whole numbers, so reruns agree.
    """
    every = every_finding(docs, text_col)
    aside = F.pmod(F.xxhash64(F.lit("aside"), "view"), F.lit(5)) == 0
    counted = every.groupBy("label", aside.alias("aside")).agg(F.count(F.lit(1)).alias("n")).collect()       # four rows at most
    n = {(r.label, r.aside): r.n for r in counted}
    total = {k: n.get((k, True), 0) + n.get((k, False), 0) for k in (0, 1)}
    if max(total.values()) <= per_class or not all(total.values()):
        return fit(*_least(every, per_class))
    held = rest = every             # where a label is too rare to be parted
    if len(n) == 4:
        held, rest, total = every.filter(aside), every.filter(~aside), {k: n[k, False] for k in (0, 1)}
    start = fit(*_least(rest, per_class))
    return _calibrated(_passed(rest, total, start, bucket_rows), held)


def _passed(rest: DataFrame, total: dict[int, int], start: Network, bucket_rows: int) -> Network:
    """The mean, by rows, of the weights that the buckets of `rest` reach from `start` in one pass. Both labels weigh the same."""
    rows = sum(total.values())
    buckets = -(-rows // bucket_rows)
    scale = np.array([rows / (2 * total[k]) for k in (0, 1)])
    sent = rest.sparkSession.sparkContext.broadcast(vars(start))
    shapes = [(name, getattr(start, name).shape) for name in ("chars", "filters", "bias", "out", "out_bias")]

    def go_on(key: tuple, block: pa.Table) -> pa.Table:
        block, model, sums = block.sort_by("view"), Network(**sent.value), {}
        codes, truth = _codes(block["view"].to_pylist()), block["label"].to_numpy().astype(float)
        rng = np.random.default_rng(int(key[0].as_py()))
        order = rng.permutation(len(truth))
        for lo in range(0, len(order), _BATCH):
            at = order[lo:lo + _BATCH]
            model.learn(_blanked(codes[at], rng), truth[at], sums, PASS_RATE, scale[truth[at].astype(int)])
        flat = np.concatenate([getattr(model, name).ravel() for name, _ in shapes])
        return pa.table({"at": pa.array(np.arange(len(flat))), "value": pa.array(np.round(flat * 2.0 ** 32).astype(np.int64) * len(truth))})

    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64(F.lit("deal"), "view"), F.lit(buckets)))
    parts = dealt.groupBy("bucket").applyInArrow(go_on, "at long, value long")
    means = cut_lineage(parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("double").alias("value")))
    flat = np.array([r.value for r in means.orderBy("at").collect()]) / 2.0 ** 32 / rows          # the weights of one network
    model, lo = Network(**vars(start)), 0
    for name, shape in shapes:
        size = int(np.prod(shape))
        setattr(model, name, flat[lo:lo + size].reshape(shape))
        lo += size
    return model


def _calibrated(net: Network, held: DataFrame) -> Network:
    """`net` with its calibration and threshold from all findings of `held`. Logits are counted by hundredths, and the threshold is the least
    probability in its ten-thousandth, so it leaves LEAST_RECALL of the secrets or a little more."""
    sent = held.sparkSession.sparkContext.broadcast(vars(net))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(**sent.value)
        for batch in batches:
            codes = _codes(batch.column(0).to_pylist())
            alone = model.logits(_alone(codes))
            blank = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.where(blank, alone, model.logits(codes))), pa.array(alone)],
                                             ["label", "logit", "alone"])

    blank = (F.pmod(F.xxhash64(F.lit("blank"), "view"), F.lit(2)) == 0).alias("blank")
    spread = held.repartition(shuffle_partitions(held.sparkSession), "view")          # little data is much reading
    answers = cut_lineage(spread.select("view", "label", blank).mapInArrow(answer, "label int, logit double, alone double"))
    bins = answers.groupBy("label", F.round("logit", 2).alias("logit")).agg(F.count(F.lit(1)).alias("n")).orderBy("label", "logit").collect()
    net.scale, net.shift = platt(np.array([r.logit for r in bins]), np.array([r.label for r in bins], float), np.array([r.n for r in bins], float))
    p = 1 / (1 + F.exp(-(F.lit(net.scale) * F.col("alone") + F.lit(net.shift))))
    found = (answers.filter("label = 1").groupBy(F.floor(p * 10000).alias("bin"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("alone").alias("lo"), F.max("alone").alias("hi")).orderBy("bin").collect())
    upto = np.cumsum([r.n for r in found])
    at = found[int(np.searchsorted(upto, int((1 - LEAST_RECALL) * upto[-1]), side="right"))]
    net.threshold = float(sigmoid(net.scale * np.array([at.lo, at.hi]) + net.shift).min())
    return net


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, spans` for every row: all spans (kind, start, end, p), by start and then kind; positions count code points, the end is exclusive.

    p is 1 for the rules and the network's probability for the rest. A null or empty text has no spans. Of a very long candidate every
    piece is read, and the largest probability counts. Rows are scanned one by one, so null ids and repeated rows change nothing. No column but the two named ones is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(net))       # plain arrays: workers need no copy of this package

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,p:double>>")
    def spans(texts: pa.Array) -> pa.Array:
        model, out, views, owner = Network(**sent.value), [], [], []
        for n, text in enumerate(texts.to_pylist()):
            base = rule_spans(text or "")
            out.append([(s.kind, s.start, s.end, 1.0) for s in base])
            for at in candidates(text or "", base):
                cut = pieces(text, *at)
                views += cut
                owner += [(n, at)] * len(cut)
        best: dict = {}
        codes = _codes(views)
        for key, p in zip(owner, np.maximum(model.probabilities(codes), model.probabilities(_alone(codes))) if views else []):
            best[key] = max(best.get(key, 0.0), float(p))
        for (n, at), p in best.items():
            if p >= model.threshold:
                out[n].append(("net", *at, round(p, 6)))
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
        rows = [[dict(zip(("kind", "start", "end", "p"), s)) for s in sorted(o, key=lambda s: (s[1], KINDS.index(s[0])))] for o in out]
        return pa.array(rows, pa.list_(kind))

    return docs.select(F.col(id_col).alias("id"), spans(F.col(text_col)).alias("spans"))
