"""Quality classifier: a generalised additive model with pairwise interactions.

A text's numeric features are binned; boosting goes over the features in turn, each round adding a shallow tree on one
feature's bins to that feature's lookup table, then over the strongest pairs with trees on pairs of bins. A score is the
sum of the tables' entries at the text's bins, so scoring is a few vectorised additions.

Fitted on at most SAMPLE labelled rows outside the held-out part (crc32 of the doc_id as text, modulo 5, is not 0),
chosen by hash. Features come from whole texts alone: labels, lang, source and doc_id are no inputs.

Edge cases: a null text counts as empty, and empty texts are scored by the same tables; a null doc_id is held out
(crc32 of the empty text is 0); without labels of both kinds every score is the share of good labels (1 without labels);
an empty table gives an empty result; other columns are ignored, or kept by `keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textstats
from corpuslab.llm.common import leanly
from corpuslab.llm.quality_rules import labelled_sample, platt, sigmoid

SAMPLE = 20000
THRESHOLD = 0.3
BINS = 48
PAIR_BINS = 12
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.15
NAMES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "exclamation_share", "punctuation_share", "pipe_share",
    "non_ascii_share", "duplicate_lines", "words_a_line", "repeated_words", "distinct_words", "top_word_share", "symbol_ended_words", "one_char_words",
)

_UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT[48:58] = True
_MARK[list(b".,;:!?()'\"-")] = True


def held_out(doc_id):
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def features(texts: pa.Array) -> np.ndarray:
    b = textstats.block(texts)
    base = textstats.base_counts(b)
    dup, lines = textstats.duplicate_lines(texts)
    d = b.data
    starts = (d & 0xC0) != 0x80
    chars = np.maximum(b.per_text(starts), 1)
    n = np.maximum(base["n_words"], 1)
    one = np.maximum
    index = b.words.indices.to_numpy().astype(np.int64)
    values = b.words.dictionary.cast(pa.large_binary()).to_pylist()
    odd = np.array([w[-1] in b"#*$%&|<>!" for w in values], dtype=bool)
    short = np.array([len(w) == 1 for w in values], dtype=bool)
    key, count = np.unique(b.word_doc.astype(np.int64) * (len(values) + 1) + index, return_counts=True)
    owner = key // (len(values) + 1)
    top = np.zeros(b.n)
    np.maximum.at(top, owner, count)
    ends = np.bincount(b.word_doc, weights=odd[index], minlength=b.n) if len(index) else np.zeros(b.n)
    ones = np.bincount(b.word_doc, weights=short[index], minlength=b.n) if len(index) else np.zeros(b.n)
    upper, lower = b.per_text(_UPPER[d]), b.per_text(_LOWER[d])
    columns = (
        np.log1p(base["n_words"]), base["word_chars"] / n, upper / one(upper + lower, 1), b.per_text(_DIGIT[d]) / chars, base["n_symbols"] / chars,
        b.per_text(d == 33) / chars, b.per_text(_MARK[d]) / chars, b.per_text(d == 124) / chars, b.per_text(starts & (d >= 128)) / chars,
        dup / one(lines, 1), base["n_words"] / one(lines, 1), textstats.repeated_words(b) / n, np.bincount(owner, minlength=b.n) / n, top / n, ends / n, ones / n,
    )
    return np.column_stack(columns).astype(np.float64)


class Additive:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, share: float):
        self.bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pair_edges: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.slope, self.shift = 1.0, 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {}
        for i, j, table in self.pairs:
            for k in (i, j):
                if k not in coarse:
                    coarse[k] = np.searchsorted(self.pair_edges[k], x[:, k], side="right")
            z += table[coarse[i], coarse[j]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.log_odds(x) + self.shift)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0, least: float = 0.5) -> np.ndarray:
    """A shallow tree on ordered bins, grown leaf by leaf: the step for each bin from its sums of gradients."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    value = lambda lo, hi: (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            at = np.arange(lo + 1, hi)
            gain = (cg[at] - cg[lo]) ** 2 / (ch[at] - ch[lo] + ridge) + (cg[hi] - cg[at]) ** 2 / (ch[hi] - ch[at] + ridge) - value(lo, hi)
            gain[(ch[at] - ch[lo] < least) | (ch[hi] - ch[at] < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], p, int(at[k]))
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = -(cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0, least: float = 0.5) -> tuple[np.ndarray, float]:
    """The best cross of one cut in each feature: four leaves; and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = G[-1, -1], H[-1, -1]
    quads = []
    for S, total in ((G, tg), (H, th)):
        a = S[:-1, :-1]
        quads.append((a, S[:-1, -1:] - a, S[-1:, :-1] - a, total - S[:-1, -1:] - S[-1:, :-1] + a))
    gain = sum(x * x / (y + ridge) for x, y in zip(*quads)) - tg * tg / (th + ridge)
    gain[np.minimum.reduce([np.broadcast_to(y, gain.shape) for y in quads[1]]) < least] = -np.inf
    at = np.unravel_index(np.argmax(gain), gain.shape)
    if not np.isfinite(gain[at]):
        return np.zeros(g.shape), 0.0
    out = np.zeros(g.shape)
    i, j = at[0] + 1, at[1] + 1
    for rows, columns, q in ((slice(i), slice(j), 0), (slice(i), slice(j, None), 1), (slice(i, None), slice(j), 2), (slice(i, None), slice(j, None), 3)):
        out[rows, columns] = -quads[0][q][at] / (quads[1][q][at] + ridge)
    return out, float(gain[at])


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    model = Additive(float(y.mean()) if len(y) else 1.0)
    kept = np.arange(len(y)) % 5 == 0  # for the calibration
    if len(y) < 20 or len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        return model
    X, t = x[~kept], y[~kept]
    cuts = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
    model.edges = [cuts(X[:, j], BINS) for j in range(X.shape[1])]
    model.pair_edges = [cuts(X[:, j], PAIR_BINS) for j in range(X.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, X[:, j], side="right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, X[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    z = np.full(len(t), model.bias)
    for _ in range(ROUNDS):
        for j, at in enumerate(fine):
            p = sigmoid(z)
            step = RATE * _tree(np.bincount(at, p - t, len(model.tables[j])), np.bincount(at, p * (1 - p), len(model.tables[j])))
            model.tables[j] += step
            z += step[at]

    def sums(i, j):
        p, shape = sigmoid(z), (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        at = coarse[i] * shape[1] + coarse[j]
        return at, [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (p - t, p * (1 - p))]

    names = [(i, j) for i in range(X.shape[1]) for j in range(i) if len(model.pair_edges[i]) and len(model.pair_edges[j])]
    strong = sorted(names, key=lambda ij: -_pair_tree(*sums(*ij)[1])[1])[:PAIRS]
    model.pairs = [(i, j, np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1))) for i, j in strong]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            at, (g, h) = sums(i, j)
            step = RATE * _pair_tree(g, h)[0]
            table += step
            z += step.ravel()[at]
    model.slope, model.shift = platt(model.log_odds(x[kept]), y[kept])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    rows = labelled_sample(docs, labels, sample, where=~held_out(F.col("doc_id")))

    def scan(batches):
        for batch in leanly(batches):
            for lo, hi in textstats.pieces(batch.column(0)) if batch.num_rows else []:
                part = batch.slice(lo, hi - lo)
                x = features(part.column(0))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    found = sorted(rows.mapInArrow(scan, "id long, label int, x array<double>").collect(), key=lambda r: (r[0], r[2]))
    return fit(np.array([r[2] for r in found]).reshape(-1, len(NAMES)), np.array([r[1] for r in found], dtype=np.float64))


def _score_batches(batches, model: Additive, threshold: float, rows: bool):
    for batch in leanly(batches):
        for lo, hi in textstats.pieces(batch.column(1)) if batch.num_rows else []:
            part = batch.slice(lo, hi - lo)
            s = model.score(features(part.column(1)))
            if rows:
                yield pa.RecordBatch.from_arrays([*part.filter(pa.array(s >= threshold)).columns], names=part.schema.names)
            else:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["doc_id", "score"])


def classify(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(train_docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(lambda batches: _score_batches(batches, model, threshold, False), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are predicted to be good, with all their columns."""
    model = train(train_docs, labels, sample)
    names = ["doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    rows = docs.select(*[docs[c] for c in names])
    return rows.mapInArrow(lambda batches: _score_batches(batches, model, threshold, True), rows.schema).select(*docs.columns)
