"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read in overlapping windows of words. Each word enters as a vector of its own and as the sum of the vectors of its character n-grams (both
hashed into tables), so unseen spellings of known words still say something. A window's hidden states of both directions are pooled by attention
into one logit; the text's logit is the largest of all its windows. Training knows only a text's label, so the windows of a text share it
through a smooth maximum. The logit becomes a probability by a logistic fit on texts kept out of the training.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.calibration import platt, sigmoid
from factloom.session import cut_lineage

WINDOW, STRIDE = 32, 24       # words of a window, and from one to the next
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 16
SIZE, HIDDEN = 12, 12
SAMPLE_PER_CLASS = 1500       # labelled rows fitted on, per class
SAMPLE_CHARS = 6000           # longer texts are left out of the sample, never out of the scores
STEPS, BATCH = 240, 48
REJECT = 0.3                  # score from which a text counts as toxic
_CHUNK = 1667 * STRIDE        # words scored together; longer texts go in parts that have the same windows
_WINDOWS = 1024
_GRAMS = (3, 4, 5)
_SPACED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_DEAL = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[bytes]:
    """Words of letters and digits, in lower case."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word in the word table, rows in the character table, where each word's rows begin).

    Every word has its n-grams with an edge mark at both ends; words of one character have one gram.
    """
    ends = np.cumsum([len(w) + 2 for w in words])
    text = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    begins = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(words)), ends - begins)
    rows, who = [], []
    rolling = np.zeros(len(text), np.uint64)
    for n in range(1, max(_GRAMS) + 1):
        rolling = rolling[:len(text) - n + 1] * np.uint64(257) + text[n - 1:]
        if n in _GRAMS:
            inside = np.flatnonzero(np.arange(n - 1, len(text)) < ends[owner[:len(rolling)]])
            mixed = (rolling[inside] + np.uint64(n)) * _DEAL
            rows.append((mixed >> np.uint64(40)).astype(np.int64) % CHAR_ROWS)
            who.append(owner[inside])
    rows, who = np.concatenate(rows), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    rows, who = rows[order], who[order]
    whole = np.add.reduceat(text * (np.uint64(1) + np.arange(len(text), dtype=np.uint64) - begins[owner].astype(np.uint64)) * _DEAL, begins)
    return ((whole * _DEAL) >> np.uint64(40)).astype(np.int64) % WORD_ROWS, rows, np.searchsorted(who, np.arange(len(words)))


@dataclass
class Windows:
    """Texts as windows of word numbers. `of`: the text of each window; `mask`: where a window has words."""
    ids: np.ndarray
    mask: np.ndarray
    of: np.ndarray
    words: list[bytes]
    n_texts: int


def windows(texts: list[list[bytes]]) -> Windows:
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for t in texts for w in t] or [0], np.int64)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    count = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    of = np.repeat(np.arange(len(texts)), count)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = inside[:, None] * STRIDE + np.arange(WINDOW)[None]
    mask = at < sizes[of][:, None]
    ids = flat[np.minimum(begins[of][:, None] + at, len(flat) - 1)]
    return Windows(np.where(mask, ids, 0), mask, of, list(number) or [b"?"], len(texts))


def _parts(found: list[bytes]) -> Iterator[list[bytes]]:
    """A text's words in parts whose windows together are the text's own windows."""
    yield found[:_CHUNK + WINDOW - STRIDE]
    for lo in range(_CHUNK, len(found) - (WINDOW - STRIDE), _CHUNK):
        yield found[lo:lo + _CHUNK + WINDOW - STRIDE]


@dataclass
class Network:
    """The weights; `scale` and `shift` turn a text's logit into a probability."""
    word: np.ndarray
    char: np.ndarray
    into: np.ndarray          # (2, inputs, 3 * HIDDEN): update, reset, candidate, for both directions
    bias: np.ndarray
    back: np.ndarray          # (2, HIDDEN, 3 * HIDDEN)
    attend: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    sums: dict = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, size: float) -> np.ndarray:
            return (rng.normal(size=shape) * size).astype(np.float32)

        return Network(normal(WORD_ROWS, SIZE, size=0.01), normal(CHAR_ROWS, SIZE, size=0.01), normal(2, 2 * SIZE, 3 * HIDDEN, size=0.3),
                       np.zeros((2, 3 * HIDDEN), np.float32), normal(2, HIDDEN, 3 * HIDDEN, size=0.25), normal(2 * HIDDEN, size=0.1),
                       normal(2 * HIDDEN, size=0.3), np.full(1, -1, np.float32))

    def inputs(self, words: list[bytes]) -> tuple:
        """The input vectors of different words, and what they came from."""
        whole, rows, begins = _grams(words)
        many = np.diff(np.append(begins, len(rows)))
        weight = (1 / np.sqrt(many))[:, None].astype(np.float32)
        chars = np.add.reduceat(self.char[rows], begins, axis=0) * weight
        return np.concatenate([self.word[whole], chars], axis=1), (whole, rows, many, weight)

    def forward(self, gates: list[np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        """Window logits, and with `keep` all that the way back needs."""
        n, steps = ids.shape
        hidden, trace = np.zeros((steps, n, 2 * HIDDEN), np.float32), []
        H = HIDDEN
        for way in (0, 1):
            h = np.zeros((n, H), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x, r = gates[way][ids[:, t]], h @ self.back[way]
                zr = sigmoid(x[:, :2 * H] + r[:, :2 * H])
                c = np.tanh(x[:, 2 * H:] + zr[:, H:] * r[:, 2 * H:])
                z = zr[:, :H] * mask[:, t, None]          # beyond the text the state stays
                if keep:
                    trace.append((way, t, h, zr[:, :H], zr[:, H:], c, r[:, 2 * H:]))
                h = h + z * (c - h)
                hidden[t, :, way * H:(way + 1) * H] = h
        score = np.where(mask.T, hidden @ self.attend, -30.0)
        share = np.exp(score - score.max(axis=0))
        share = (share / share.sum(axis=0)).astype(np.float32)
        pooled = (share[:, :, None] * hidden).sum(axis=0)
        return pooled @ self.out + self.out_bias[0], (hidden, share, pooled, trace)

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """The largest window logit of each text."""
        w = windows(texts)
        vectors, _ = self.inputs(w.words)
        gates = [vectors @ self.into[k] + self.bias[k] for k in (0, 1)]
        best = np.full(w.n_texts, -np.inf)
        for at in range(0, len(w.of), _WINDOWS):
            part = slice(at, at + _WINDOWS)
            found, _ = self.forward(gates, w.ids[part], w.mask[part].astype(np.float32))
            np.maximum.at(best, w.of[part], found)
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities that texts are toxic; every window of every text counts."""
        best, held, owner, size = np.full(len(texts), -np.inf), [], [], 0

        def take() -> None:
            np.maximum.at(best, owner, self.logits(held))
            held.clear(), owner.clear()

        for n, text in enumerate(texts):
            for part in _parts(split_words(text)):
                held.append(part)
                owner.append(n)
                size += len(part)
                if size >= _CHUNK:
                    take()
                    size = 0
        if held:
            take()
        return np.round(sigmoid(self.scale * best + self.shift), 6)

    def learn(self, texts: list[list[bytes]], labels: np.ndarray, sharp: float, rate: float) -> None:
        """One step of gradient descent on a batch of texts."""
        w = windows(texts)
        vectors, (whole, rows, many, weight) = self.inputs(w.words)
        gates = [vectors @ self.into[k] + self.bias[k] for k in (0, 1)]
        mask = w.mask.astype(np.float32)
        logit, (hidden, share, pooled, trace) = self.forward(gates, w.ids, mask, keep=True)
        top = np.full(w.n_texts, -np.inf)
        np.maximum.at(top, w.of, logit)
        part = np.exp(sharp * (logit - top[w.of]))            # smooth maximum over a text's windows
        total = np.bincount(w.of, part, w.n_texts)
        size = np.bincount(w.of, minlength=w.n_texts)
        text = top + np.log(total / size) / sharp
        off = (sigmoid(text) - labels) / len(labels)
        d_logit = (off[w.of] * part / total[w.of]).astype(np.float32)
        grads = {"out": d_logit @ pooled, "out_bias": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * self.out
        d_share = (hidden * d_pooled[None]).sum(axis=2)
        d_score = share * (d_share - (share * d_share).sum(axis=0)) * mask.T
        grads["attend"] = np.einsum("tn,tnh->h", d_score, hidden)
        d_hidden = share[:, :, None] * d_pooled[None] + d_score[:, :, None] * self.attend
        H = HIDDEN
        into, bias, back = np.zeros_like(self.into), np.zeros_like(self.bias), np.zeros_like(self.back)
        d_vectors, d_h, before = np.zeros_like(vectors), None, None
        used = w.ids.T.ravel()
        by_word = np.argsort(used, kind="stable")
        begins = np.searchsorted(used[by_word], np.arange(len(w.words)))      # every word occurs in some window
        for way, t, h, z, r, c, rc in reversed(trace):
            if way != before:
                d_h, before, flows = np.zeros_like(h), way, np.empty((w.ids.shape[1], len(w.of), 3 * H), np.float32)
            d_h = d_h + d_hidden[t, :, way * H:(way + 1) * H]
            on = mask[:, t, None]
            d_c = d_h * z * on * (1 - c * c)
            d_z = d_h * (c - h) * on * z * (1 - z)
            d_r = d_c * rc * r * (1 - r)
            flows[t] = np.concatenate([d_z, d_r, d_c], axis=1)
            flow = np.concatenate([d_z, d_r, d_c * r], axis=1)
            back[way] += h.T @ flow
            d_h = d_h * (1 - z * on) + flow @ self.back[way].T
            if t == (0 if way == 0 else w.ids.shape[1] - 1):      # the first step of this direction: all words are in
                d_gate = np.add.reduceat(flows.reshape(-1, 3 * H)[by_word], begins, axis=0)
                into[way] = vectors.T @ d_gate
                bias[way] = d_gate.sum(axis=0)
                d_vectors += d_gate @ self.into[way].T
        grads |= {"into": into, "bias": bias, "back": back}
        for name, g in grads.items():
            self._move(name, slice(None), g, rate)
        self._rows("word", whole, d_vectors[:, :SIZE], rate)
        self._rows("char", rows, np.repeat(d_vectors[:, SIZE:] * weight, many, axis=0), rate)

    def _rows(self, name: str, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        order = np.argsort(rows, kind="stable")
        different, begins = np.unique(rows[order], return_index=True)
        self._move(name, different, np.add.reduceat(grad[order], begins, axis=0), rate)

    def _move(self, name: str, at, grad: np.ndarray, rate: float) -> None:
        weights = getattr(self, name)
        seen = self.sums.setdefault(name, np.full_like(weights, 1e-6))
        seen[at] += grad * grad
        weights[at] -= (rate * grad / np.sqrt(seen[at])).astype(np.float32)


def fit(texts: list[str], labels: list[int], counts: tuple[int, int] | None = None, seed: int = 5, steps: int = STEPS) -> Network:
    """A network fitted on four fifths of the texts and calibrated on the rest. `counts` are the clean and toxic rows that the texts were drawn from: a
    sample with another share of toxic rows has its logit shifted by the difference of the odds, so a probability means the same at every size."""
    net, rng = Network.fresh(), np.random.default_rng(seed)
    split, truth = [split_words(t) for t in texts], np.array(labels, float)
    order = rng.permutation(len(split))
    aside, rest = order[:len(order) // 5], order[len(order) // 5:]
    groups = [[i for i in rest if truth[i] == k] for k in (0, 1)]
    if not all(groups):          # nothing to tell apart: the share of toxic rows is all there is to say
        net.scale, net.shift = 0.0, 20.0 if len(truth) and truth.mean() == 1 else -20.0
        return net
    for step in range(steps):
        batch = np.concatenate([rng.choice(g, BATCH // 2) for g in groups])
        net.learn([split[i] for i in batch], truth[batch], 1.0 if step < steps // 3 else 3.0, 0.08 if step < steps // 2 else 0.03)
    if len(set(truth[aside])) < 2:
        aside = order
    net.scale, net.shift = platt(net.logits([split[i] for i in aside]), truth[aside])
    if counts is not None and all(counts):
        net.shift += float(np.log(counts[1] / counts[0]) - np.log(truth.sum() / (len(truth) - truth.sum())))
    net.sums = {}
    return net


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> Network:
    """A network fitted on at most `per_class` labelled rows of each class, those with the least hashes of their ids. Labels of
    held-out rows, null labels and null ids are not used; of several labels of an id the largest counts. Texts beyond `max_chars` are not in the sample.
    Both classes are counted over all usable labels for the calibration. The sample has a fixed bound, so one task
    fits the network and only its weights come to the driver."""
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    total = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = (total.get(0, 0), total.get(1, 0))
    short = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = None
    for k in (0, 1):
        picked = known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class)
        found = short.join(F.broadcast(picked), "id").filter(F.char_length("text") <= max_chars)      # at most per_class ids
        one = found.groupBy("id", "label").agg(F.max("text").alias("text"))
        sample = one if sample is None else sample.unionByName(one)

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, truth = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            truth += batch.column(1).to_pylist()
        weights = pickle.dumps(vars(fit(texts, truth, counts)), protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary())], ["weights"])

    placed = sample.repartition(1).sortWithinPartitions("label", F.xxhash64("id")).select("text", "label")
    fitted = placed.mapInArrow(fit_all, "weights binary").first()
    return Network(**pickle.loads(fitted.weights)) if fitted else fit([], [])


def score(docs: DataFrame, net: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a score in the column `out`, from the text alone. Every whole text gets one; a null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(net))       # plain arrays: workers need no copy of this package

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(Network(**sent.value).scores(texts.to_pylist()))

    return docs.withColumn(out, scored(F.col(text_col)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """`id, held_out, score, predicted` for every row. Rows with null ids are scored and never held out; a repeated row is
    scored again; without labels of both classes every score is next to 0 (or 1 if all are toxic)."""
    net = train(docs, labels, id_col, text_col, label_col)
    rows = score(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), net)
    rows = cut_lineage(rows.select("id", held_out(F.col("id")).alias("held_out"), "score"))
    return rows.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))
