"""Quality rules: base rules on counts, then a calibrated n-gram logistic regression.

Base rules reject a text with under 50 words or with over half its words in repeated three-word windows. A logistic
regression on hashed n-grams judges the rest: the shares of a text's trigrams of characters, words and pairs of words in
DIMENSIONS buckets. It is fitted on at most SAMPLE labelled rows, chosen by hash; a fifth of them is kept out and fits the
two numbers of the calibration. Texts pass with a calibrated probability of at least KEEP.

The features of the sample are made on the executors; only they are collected, at most DIMENSIONS pairs for a row.

Edge cases: a null text has no words and fails the base rules; without labels of both kinds the base rules decide alone;
null or repeated labels of a document count by their rounded mean; of rows that repeat a labelled doc_id one text is learned from, that of the least
hash; very long texts are read whole; ties with the threshold are kept; an empty table gives an empty result; other columns are ignored,
or kept by `keep_good`; null doc_ids are scored like others but can't be labelled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import textstats
from corpuslab.llm.common import leanly

MIN_WORDS = 50
MAX_REPEATED = 0.5
#: Buckets for trigrams of characters; as many again serve words and pairs of words.
HALF = 1 << 13
DIMENSIONS = 2 * HALF
SAMPLE = 4000
KEEP = 0.5
SCALE = 30.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def code_points(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where code points begin in UTF-8 bytes, and a number for each: its bytes, the first lowest."""
    at = np.flatnonzero((d & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(d)))
    value = d[at].astype(np.uint32)
    for k in range(1, 4):
        more = size > k
        value[more] |= d[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return at, value


def features(b: textstats.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of each trigram of characters, and of each word and pair of words."""
    import xxhash

    at, c = code_points(b.data)
    tri = _mix(c[:-2] + c[1:-1] * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0x85EBCA77)) % np.uint32(HALF) if len(c) > 2 else np.zeros(0, dtype=np.uint32)
    doc = np.repeat(np.arange(b.n, dtype=np.int32), np.diff(b.starts))[at]
    inside = doc[:-2] == doc[2:] if len(c) > 2 else np.zeros(0, dtype=bool)
    hashes = np.array([xxhash.xxh32_intdigest(w) for w in b.words.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint32)
    word = hashes[b.words.indices.to_numpy()] if len(hashes) else np.zeros(0, dtype=np.uint32)
    pair = _mix(word[:-1] * np.uint32(31) + word[1:])
    near = b.word_doc[:-1] == b.word_doc[1:]
    low = np.concatenate((word % np.uint32(HALF), pair[near] % np.uint32(HALF))) + np.uint32(HALF)
    return tri[inside], doc[:-2][inside] if len(c) > 2 else doc[:0], low, np.concatenate((b.word_doc, b.word_doc[:-1][near]))


def _score(b: textstats.Block, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(b.n, bias)
    tri, tri_doc, low, low_doc = features(b)
    for bucket, doc in ((tri, tri_doc), (low, low_doc)):
        n = np.bincount(doc, minlength=b.n)
        out += SCALE * np.bincount(doc, weights=weights[bucket], minlength=b.n) / np.maximum(n, 1)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, seed: int = 11, where=None) -> DataFrame:
    """text, label: of at most `sample` labelled documents, those of the least hashes. The sample, ids with labels, is
    bounded by that parameter; so is its broadcast."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if where is not None:
        own = own.where(where)
    own = own.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select(F.col("doc_id").alias("__id"), "label")
    found = docs.select(F.col("doc_id").alias("__doc"), F.col("text").cast("string").alias("text"))
    joined = found.join(F.broadcast(own), F.col("__doc") == F.col("__id"))
    one = joined.groupBy("__id", "label").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))
    return one.select("text", "label", F.col("__id").alias("id"))


def sample_features(sample: DataFrame) -> list:
    def scan(batches):
        for batch in leanly(batches):
            for lo, hi in textstats.pieces(batch.column(0)) if batch.num_rows else []:
                part = batch.slice(lo, hi - lo)
                b = textstats.block(part.column(0))
                tri, tri_doc, low, low_doc = features(b)
                at, values = [], []
                keys, share = [], []
                for bucket, doc in ((tri, tri_doc), (low, low_doc)):
                    n = np.bincount(doc, minlength=b.n)
                    k, c = np.unique(doc.astype(np.int64) * DIMENSIONS + bucket, return_counts=True)
                    keys.append(k)
                    share.append(c / n[k // DIMENSIONS])
                k, v = np.concatenate(keys), np.concatenate(share)
                order = np.argsort(k, kind="stable")
                k, v = k[order], v[order]
                ends = np.searchsorted(k // DIMENSIONS, np.arange(b.n + 1))
                for i in range(b.n):
                    own = slice(ends[i], ends[i + 1])
                    at.append((k[own] % DIMENSIONS).astype("<u2").tobytes())
                    values.append(v[own].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["id", "label", "at", "v"])

    return sorted(sample.mapInArrow(scan, "id long, label int, at binary, v binary").collect(), key=lambda r: (r[0], r[2]))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list, steps: int = 200, l2: float = 1e-4) -> tuple[np.ndarray, float, float, float] | None:
    """Weights, bias, and the calibration's slope and shift; None without labels of both kinds."""
    y = np.array([r[1] for r in rows], dtype=np.float64)
    held = np.arange(len(rows)) % 5 == 0
    if len(rows) < 10 or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return None
    at = [np.frombuffer(bytes(r[2]), "<u2") for r in rows]
    v = [np.frombuffer(bytes(r[3]), "<f4") * SCALE for r in rows]

    def matrix(which):
        n = [len(at[i]) for i in which]
        return np.repeat(np.arange(len(which)), n), np.concatenate([at[i] for i in which]).astype(np.int32), np.concatenate([v[i] for i in which])

    fitted = np.flatnonzero(~held)
    row, col, val = matrix(fitted)
    t = y[fitted]
    weight = np.where(t > 0, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9)) / len(t)
    w, bias = np.zeros(DIMENSIONS), 0.0
    m, s, mb, sb = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    for k in range(1, steps + 1):  # Adam on the whole sample
        p = sigmoid(np.bincount(row, weights=val * w[col], minlength=len(t)) + bias)
        r = (p - t) * weight
        g, gb = np.bincount(col, weights=val * r[row], minlength=DIMENSIONS) + l2 * w, r.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.05 * np.sqrt(1 - 0.99**k) / (1 - 0.9**k)
        w -= rate * m / (np.sqrt(s) + 1e-8)
        bias -= rate * mb / (np.sqrt(sb) + 1e-8)
    row, col, val = matrix(np.flatnonzero(held))
    z = np.bincount(row, weights=val * w[col], minlength=int(held.sum())) + bias
    return w, bias, *platt(z, y[held])


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift for the log odds, by Newton steps with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        h = p * (1 - p) + 1e-9
        H = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(H, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    return fit(sample_features(labelled_sample(docs, labels, sample)))


def judge_batches(batches, model, extra: bool):
    """From (doc_id, text, ...) batches: the counts, the verdict, and the probability."""
    for batch in leanly(batches):
        for lo, hi in textstats.pieces(batch.column(1)) if batch.num_rows else []:
            part = batch.slice(lo, hi - lo)
            b = textstats.block(part.column(1))
            base = textstats.base_counts(b)
            dup, _ = textstats.duplicate_lines(part.column(1))
            rep = textstats.repeated_words(b)
            n = base["n_words"]
            failed = (n < MIN_WORDS) | (100 * rep > 100 * MAX_REPEATED * n)
            if model is None:
                p = np.ones(b.n)
            else:
                w, bias, slope, shift = model
                p = sigmoid(slope * _score(b, w, bias) + shift)
            kept = ~failed & (p >= KEEP)
            if extra:
                yield pa.RecordBatch.from_arrays([*part.filter(pa.array(kept)).columns], names=part.schema.names)
                continue
            arrays = [part.column(0).cast(pa.int64()), *[pa.array(x, pa.int64()) for x in (n, base["word_chars"], base["n_symbols"], dup, rep)], pa.array(failed), pa.array(kept), pa.array(p)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"])


def judge(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good."""
    model = train(train_docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"
    return rows.mapInArrow(lambda batches: judge_batches(batches, model, False), schema)


def keep_good(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    model = train(train_docs, labels, sample)
    names = ["doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    rows = docs.select(*[docs[c] for c in names])
    return rows.mapInArrow(lambda batches: judge_batches(batches, model, True), rows.schema).select(*docs.columns)
