"""Invariants and literals that hold whatever the data."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import tails
from corpuslab.operators import audits, corpus, gate, grouping, metrics, mixing, runs, similarity, splits, statistics


def test_t_quantiles():
    for df, want in ((2, 4.302653), (4, 2.776445), (9, 2.262157)):
        assert math.isclose(tails.t_quantile(0.975, df), want, abs_tol=1e-6)
    assert math.isclose(tails.chi2_upper(3.841459, 1), 0.05, abs_tol=1e-6)


def test_majority_prediction_has_chance_recall(spark):
    rows = [(t, 0) for t, n in ((0, 70), (1, 20), (2, 7), (3, 3)) for _ in range(n)]
    e = metrics.evaluate(spark.createDataFrame(rows, "y_true int, y_pred int")).first()
    assert e["balanced_accuracy"] == 0.25 and e["accuracy"] == 0.7


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.004), ("b", 0.03), ("c", 0.41)], "name string, p double")
    assert {r["name"]: r["reject"] for r in statistics.holm(t).collect()} == {"a": True, "b": False, "c": False}


def test_exchange_rate(spark):
    k, y = [0.0, 0.5, 1.5, 3.5], [0.41, 0.45, 0.53, 0.57]
    for target, want in ((0.53, 1.5), (0.49, 1.0), (0.40, 0.0), (0.58, math.inf)):
        c = spark.createDataFrame([("x", a, b, target) for a, b in zip(k, y)], "g string, k double, y double, target double")
        assert math.isclose(statistics.first_crossing(c, ["g"], "k", "y", "target").first()["k"], want, abs_tol=1e-9)


def test_trend_of_published_slopes(spark):
    rows = [(s, x, b * x) for s, b in enumerate((-0.2, -0.3, -0.4)) for x in (0.0, 0.5, 1.0)]
    t = statistics.trend(spark.createDataFrame(rows, "seed int, x double, y double"), [], "x", "y").first()
    assert math.isclose(t["slope"], -0.3, abs_tol=1e-12) and math.isclose(t["lo"], -0.3 - 0.1 / math.sqrt(3) * 4.302653, abs_tol=1e-6)
    assert math.isclose(t["p"], 0.0350988, abs_tol=1e-4)


def test_empty_interval(spark):
    one = statistics.mean_ci(spark.createDataFrame([("a", 1.0), ("b", None)], "g string, x double"), ["g"], "x")
    got = {r["g"]: (r["n"], r["point"], r["lo"]) for r in one.collect()}
    assert got == {"a": (1, 1.0, None), "b": (0, None, None)}


def corpus_of(spark, per_class_real=4, per_class_pool=20):
    rows = [(i * 4 + c, f"r{i}_{c}", c, "real", f"r{i}_{c}") for i in range(per_class_real) for c in range(4)]
    rows += [(1000 + i * 4 + c, f"s{i}_{c}", c, "synth_open", f"s{i}_{c}") for i in range(per_class_pool) for c in range(4)]
    return spark.createDataFrame(rows, "ord long, path string, label int, source string, grp string")


def test_mixtures_keep_the_budget_and_nest(spark):
    c = corpus_of(spark, 8, 40)
    specs = [mixing.MixSpec("substitution", p, seed=2) for p in (0.0, 0.25, 0.5, 1.0)]
    got = mixing.build_mixtures(corpus.real(c), corpus.synthetic(c), mixing.arms(spark, specs)).collect()
    sets = {i: {r["ord"] for r in got if r["arm_id"] == i and r["part"] == "real"} for i in range(4)}
    assert [sum(r["arm_id"] == i for r in got) for i in range(4)] == [32] * 4
    assert sets[3] == set() and sets[2] < sets[1] < sets[0]


def test_seeds_take_different_synthetic_records(spark):
    c = corpus_of(spark)
    specs = [mixing.MixSpec("substitution", 1.0, seed=s) for s in range(5)]
    got = mixing.build_mixtures(corpus.real(c), corpus.synthetic(c), mixing.arms(spark, specs)).collect()
    sets = [{r["ord"] for r in got if r["seed"] == s} for s in range(5)]
    assert all(not a & b for i, a in enumerate(sets) for b in sets[:i])


def test_shortage_is_an_error(spark):
    c = corpus_of(spark)
    with pytest.raises(mixing.ShortageError):
        mixing.build_mixtures(corpus.real(c), corpus.synthetic(c), mixing.arms(spark, [mixing.MixSpec("additive", synthetic_multiplier=50.0)]))


def test_groups_never_straddle(spark):
    rows = [(i, f"p{i % 60}", i % 4, f"grp{(i % 60) // 3}") for i in range(180)]
    parts = splits.with_splits(spark.createDataFrame(rows, "ord long, path string, label int, grp string"))
    assert corpus.assert_disjoint(parts).count() == 0
    assert parts.count() == 180


def test_sealed_test_part(spark, tmp_path):
    rows = [(i, f"p{i}", i % 4, f"g{i}") for i in range(200)]
    parts = splits.with_splits(spark.createDataFrame(rows, "ord long, path string, label int, grp string"))
    b = splits.SplitBundle.save(parts, f"{tmp_path}/split", f"{tmp_path}/log.jsonl")
    with pytest.raises(splits.SealedError):
        _ = b.test
    assert b.unseal_test("final", "run1").count() == b.test_size()
    assert len((tmp_path / "log.jsonl").read_text().splitlines()) == 1


def test_leakage_guard(spark):
    a = spark.createDataFrame([("p", "g")], "path string, grp string")
    with pytest.raises(splits.LeakageError):
        splits.check_disjoint(a, a)


def test_one_hot_identities(spark):
    rows = [(i, [1.0 if j == i % 8 else 0.0 for j in range(16)]) for i in range(40)]
    d = grouping.identity_diversity(spark.createDataFrame(rows, "ord long, v array<double>")).first()
    assert d["n_clusters"] == 8 and math.isclose(d["effective"], 8.0)
    none = grouping.identity_diversity(spark.createDataFrame([(1, [0.0] * 4)], "ord long, v array<double>")).first()
    assert none["n_clusters"] == 0 and none["effective"] == 0


def test_calibration(spark):
    import random

    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(60)]
    c = grouping.calibrate(spark.createDataFrame(rows, "ord long, v array<double>"), 0.1, "per_item", reference=0.99)
    assert c.achieved <= 0.1 and c.usable and c.recommended >= c.threshold
    with pytest.raises(ValueError):
        grouping.calibrate(spark.createDataFrame(rows[:2], "ord long, v array<double>"))


def test_hamming_pairs_match_brute_force(spark):
    import random

    r = random.Random(2)
    base = [r.getrandbits(63) for _ in range(20)]
    rows = [(i, h ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63))) for i, h in enumerate(base * 5)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 3}
    got = {(x["a"], x["b"]) for x in similarity.hamming_pairs(spark.createDataFrame(rows, "ord long, h long"), 3).collect()}
    assert got == want


def test_class_weights(spark):
    c = spark.createDataFrame([(i, 0 if i < 80 else 1) for i in range(100)], "ord long, label int")
    w = {r["label"]: r["weight"] for r in corpus.class_weights(c).collect()}
    assert w[2] == w[3] == 0 and math.isclose(80 * w[0], 20 * w[1])


def test_validation(spark):
    bad = spark.createDataFrame([("p", 7, "real", "")], "path string, label int, source string, grp string")
    assert corpus.violations(bad).count() == 1
    with pytest.raises(Exception, match="bad record"):
        corpus.validated(bad).collect()


def test_refused_names(spark):
    log = [("a", 1, None, "empty"), ("a", 2, None, "empty"), ("b", 1, None, "HTTP 429"), ("b", 2, None, "HTTP 429"), ("c", 1, None, "empty"), ("c", 2, "x", None), ("c", 3, None, "empty"), ("d", 1, None, None), ("d", 2, None, "HTTP 429"), ("d", 3, None, "no image")]
    df = spark.createDataFrame(log, "name string, ord int, path string, blocked_reason string")
    assert {r["name"] for r in audits.persistently_refused(df).collect()} == {"a", "d"}
    assert {r["name"]: r["state"] for r in audits.last_state(df).collect()} == {"a": "empty", "b": "429", "c": "ok", "d": "empty"}


def test_shared_arm_counts_for_both(spark):
    r = spark.createDataFrame([("none", 0.0, 1), ("closed", 1.0, 1), ("open", 1.0, 1)], "generator string, frac double, seed int")
    got = {(x["generator"], x["frac"]) for x in runs.expand_shared(r).collect()}
    assert got == {("closed", 0.0), ("closed", 1.0), ("open", 0.0), ("open", 1.0)}


def test_bibliography():
    assert gate.bib_entries("@book{k1, title = {A {B} C}}\n@misc{k2,}") == [("book", "k1", "title = {A {B} C}"), ("misc", "k2", "")]
