"""Operators without SQL against plain versions of what they say they do."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from corpuslab.llm import licenses, quality_gam, quality_rules, sharding, textstats  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_texts(n: int, seed: int) -> list[str | None]:
    r = random.Random(seed)
    words = ["alpha", "beta", "naïve", "北京", "don't", "été", "x", "ГОД", "1234", "a#b", "**"]
    return [None, "", " \n", "ab", *("".join(r.choice(words) + r.choice((" ", " ", "\n", "\t")) for _ in range(r.randrange(1, 120))) for _ in range(n))]


def test_shards_in_one_sort(spark):
    import zlib

    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", 0) for i, t in enumerate(some_texts(240, 1))] + [(5, "ab", "en", None, 0), (5, "ab", "en", None, 0), (None, "ab", "en", None, 0)]
    lot = lambda d, t: hashlib.md5(f"{sharding.SEED}|{'~' if d is None else d}|{zlib.crc32((t or '').encode())}".encode()).hexdigest()
    by_source = collections.defaultdict(list)
    for d, t, _, s, _ in rows:
        by_source["1" if s is None else f"0{s}"].append((int(lot(d, t)[:4], 16) % sharding.PARTS, lot(d, t), -1 if d is None else d, zlib.crc32((t or "").encode())))
    placed = sorted(((2 * r + 1) / (2 * len(own)), s, r, x[2], x[3]) for s, own in by_source.items() for r, x in enumerate(sorted(own)))
    n = len(placed)
    first = [-(-s * n // sharding.SHARDS) for s in range(sharding.SHARDS)]
    want = sorted((d, c, g * sharding.SHARDS // n, g - first[g * sharding.SHARDS // n]) for g, (_, _, _, d, c) in enumerate(placed))
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want


def terms(text: str) -> list[str]:
    return [re.sub(r"[.+-]+$", "", t) for t in re.findall(r"[^\W_](?:[^\W_]|[.+-])*", text.lower())]


def test_licence_cosines(spark):
    """Cosines of every line, paragraph, whole text, and run of terms where a template can lie, counted plainly."""
    r = random.Random(4)
    filler = "compute the value of alpha and beta for each row of this table".split()
    texts = [" ".join(r.choice(filler) for _ in range(30)) for _ in range(30)]
    for i, (_, body) in enumerate(licenses.TEMPLATES[3:]):
        words = body.split()
        if i % 3 == 1:
            words.insert(len(words) // 2, "surely")
        texts.append("\n".join([" ".join(r.choice(filler) for _ in range(8)), *([" ".join(words)] if i % 2 else [" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])]), "end of it"]))
    vocabulary = {t for _, b in licenses.TEMPLATES for t in terms(b)}
    df = collections.Counter(t for x in texts for t in set(terms(x)) & vocabulary)
    idf = lambda t: math.log((len(texts) + 1) / (df[t] + 1)) + 1 if t in vocabulary else math.log(len(texts) + 1) + 1
    vector = lambda ts: {t: c * idf(t) for t, c in collections.Counter(ts).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(terms(b))) for name, b in licenses.TEMPLATES]
    lay = licenses.laid(licenses.TEMPLATES)

    def best(text: str):
        if not re.search(licenses.ANCHORS[4:], text, re.I):
            return None
        found = terms(text)
        blocks = [b for b in re.split(r"\n[^\w\n]*\n", text) if "\n" in b]
        units = [terms(u) for u in text.split("\n") + blocks if re.search(licenses.ANCHORS[4:], u, re.I)] + [found]
        units += [found[max(i - p, 0) : max(i - p, 0) + n - max(p - i, 0)] for i, t in enumerate(found) for p, n in lay.get(t, ())]
        scores = [(round(sum(x * v.get(t, 0.0) for t, x in w.items()) / (norm(w) * norm(v)), 9), name) for u in units if u for v in (vector(u),) for name, w in templates]
        score, name = min(((-s, name) for s, name in scores), default=(0, None))
        return (name, -score) if -score >= licenses.THRESHOLD else None

    got = {x["doc_id"]: (x["license"], x["score"]) for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(None)).collect()}
    assert sum(best(t) is not None for t in texts) >= 15
    for i, t in enumerate(texts):
        want = best(t)
        assert (got[i] == (None, None)) if want is None else (got[i][0] == want[0] and math.isclose(got[i][1], want[1], abs_tol=2e-9)), (i, t, got[i], want)


def mix(x: int) -> int:
    x = (x ^ x >> 15) * 0x85EBCA6B & 0xFFFFFFFF
    x = (x ^ x >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return x ^ x >> 16


def test_quality_rules_probability():
    """The score of each text from its own n-grams, one by one."""
    import xxhash

    texts = some_texts(60, 2)
    weights = np.random.default_rng(3).normal(size=quality_rules.DIMENSIONS)
    model, half = (weights, 0.3, 1.7, -0.2), quality_rules.HALF
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = {r["doc_id"]: r for b in quality_rules.judge_batches([batch], model, False) for r in b.to_pylist()}
    for i, t in enumerate(texts):
        c = [int.from_bytes(x.encode(), "little") for x in t or ""]
        tri = [mix((a + b * 0x9E3779B1 + d * 0x85EBCA77) & 0xFFFFFFFF) % half for a, b, d in zip(c, c[1:], c[2:])]
        h = [xxhash.xxh32_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        low = [half + x % half for x in h] + [half + mix((a * 31 + b) & 0xFFFFFFFF) % half for a, b in zip(h, h[1:])]
        z = 0.3 + sum(quality_rules.SCALE * sum(weights[k] for k in own) / len(own) for own in (tri, low) if own)
        odds = min(40.0, max(-40.0, 1.7 * z - 0.2))
        assert math.isclose(got[i]["p_good"], 1 / (1 + math.exp(-odds)), rel_tol=1e-6), t
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["p_good"] >= quality_rules.KEEP)


def test_calibration_minimises_log_loss():
    r = np.random.default_rng(5)
    z = r.normal(size=400) * 2
    y = (r.random(400) < 1 / (1 + np.exp(-(0.8 * z + 0.4)))).astype(float)
    slope, shift = quality_rules.platt(z, y)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    loss = lambda a, b: -np.mean(target * np.log(quality_rules.sigmoid(a * z + b)) + (1 - target) * np.log(1 - quality_rules.sigmoid(a * z + b)))
    assert all(loss(slope, shift) <= loss(slope + da, shift + db) + 1e-9 for da in (-0.02, 0, 0.02) for db in (-0.02, 0, 0.02))


def test_additive_score_is_the_sum_of_its_tables():
    r = np.random.default_rng(6)
    x = r.normal(size=(500, len(quality_gam.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert len(model.pairs) == quality_gam.PAIRS
    for row, got in zip(x[:50], model.score(x[:50])):
        z = model.bias + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables))
        place = lambda k: sum(row[k] >= e for e in model.pair_edges[k])
        z += sum(t[place(i), place(j)] for i, j, t in model.pairs)
        assert math.isclose(got, 1 / (1 + math.exp(-(model.slope * z + model.shift))), rel_tol=1e-9)
    # The pair (0, 1) carries the answer: without pairs it couldn't be learned.
    assert ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.9


def test_additive_features():
    texts = ["Aa bb! Aa 12 |", "", None, "é é é"]
    got = quality_gam.features(pa.array(texts, pa.string()))
    names = {n: i for i, n in enumerate(quality_gam.NAMES)}
    assert got.shape == (4, len(names))
    assert math.isclose(got[0, 0], math.log(6)) and math.isclose(got[3, 0], math.log(4)) and got[1, 0] == got[2, 0] == 0
    b = textstats.base_counts(textstats.block(pa.array(texts, pa.string())))
    assert b["n_words"].tolist() == [5, 0, 0, 3] and math.isclose(got[0, 1], 10 / 5)
