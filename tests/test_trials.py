"""Leakage trials against a plain version, on odd tables."""

from __future__ import annotations

import collections
import hashlib

import duckdb
import pyarrow as pa
import pytest

from corpuslab.functions import digests
from corpuslab.functions.digests import md5_of
from corpuslab.operators import splits
from corpuslab.queries import views as V
from corpuslab.registry import ORACLES, QUERIES
from tests.conftest import SF


def plain(rows, trials, f):
    """(trial, item) to whether it leaked, of held-out rows; rows: distinct (item, group)."""
    cut, out = int((1 - f) * len(rows)), {}
    for k in range(trials):
        order = sorted(rows, key=lambda r: hashlib.md5(f"{k}|{r[0]}".encode()).hexdigest())
        train = {g for _, g in order[:cut]}
        out |= {(k, i): g in train for i, g in order[cut:]}
    return out


def test_digests():
    texts = ["", None, "é|ü", *("a" * n for n in range(40, 70)), "b" * 300, *map(str, range(9000))]
    for seed, high, low in md5_of([0, 9, 10, 100, 12345], pa.array(texts)):
        assert [f"{int(h):016x}{int(x):016x}" for h, x in zip(high, low)] == [hashlib.md5(f"{seed}|{t or ''}".encode()).hexdigest() for t in texts]


@pytest.mark.parametrize("n", [1, 2, 7, 90, 1999])
def test_trials_are_those_of_one_sort(spark, n):
    rows = [(f"{i}" + "x" * (i % 80), None if i % 11 == 0 else f"g{i % 701}") for i in range(n)]
    d = spark.createDataFrame(rows, "item string, grp string")
    got = {(r["trial"], r["item"]): r["leaked"] for r in splits.leakage_trials(d, "item", "grp", 70, 0.2).collect()}
    want = plain(rows, 70, 0.2)
    assert got == want
    counts = {r["trial"]: (r["held"], r["leaked"]) for r in splits.leakage_counts(splits.held_out(d, "item", ["grp"], 70, 0.2), "grp", 70).collect()}
    held, leaked = collections.Counter(k for k, _ in want), collections.Counter(k for (k, _), x in want.items() if x)
    assert counts == {k: (held[k], leaked[k]) for k in held}


def test_keys_that_crowd_are_found_by_wider_search(spark):
    """One item in half the rows: places are far from where even digests would have them, and its rows are told apart."""
    d = spark.createDataFrame([("same" if i % 2 else f"i{i}", f"g{i % 5}", f"c{i % 3}" if i % 7 else None) for i in range(3000)], "item string, grp string, kind string")
    held = splits.held_out(d, "item", ["grp", "kind"], 65, 0.2)
    assert {r["held"] for r in splits.leakage_counts(held, "grp", 65).collect()} == {600}
    by_kind = splits.leakage_counts(held, "grp", 65, ["kind"]).groupBy("trial").sum("held").collect()
    assert {r[1] for r in by_kind} == {600}


def test_empty_table(spark):
    d = spark.createDataFrame([], "item long, grp string")
    assert splits.leakage_trials(d, "item", "grp", 3, 0.2).count() == 0


@pytest.mark.parametrize("name", ["aud5_two_level_leakage", "aud7_leakage_by_class", "jn4_semi_join_flags", "smp11_image_level_leakage"])
def test_rows_arent_repeated_for_each_trial(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_digests_of_a_batch_take_one_pass_for_each_seed(monkeypatch):
    """Calls on short arrays cost more than their work: Spark's batches are put together, and none leaves a short rest."""
    batches = [pa.RecordBatch.from_arrays([pa.array(range(at, at + n))], ["x"]) for at, n in ((0, 10_000), (10_000, 10_000), (20_000, 0), (20_000, 5_000), (25_000, 90_000))]
    got = list(splits._gathered(batches, 32_768))
    assert [b.num_rows for b in got] == [25_000, 32_768, 32_768, 24_464]
    assert pa.Table.from_batches(got)["x"].to_pylist() == list(range(115_000))
    assert list(splits._gathered([], 10)) == list(splits._gathered(batches[2:3], 10)) == []
    calls, block = [], digests._block
    monkeypatch.setattr(digests, "_block", lambda words, n: calls.append(n) or block(words, n))
    texts = [str(i) for i in range(digests.STEP + 5)]
    assert len(list(digests.md5_of([7, 123], pa.array(texts[:30_000])))) == 2 and calls == [30_000] * 2
    for seed, high, low in digests.md5_of([31], pa.array(texts)):
        assert [f"{int(h):016x}{int(x):016x}" for h, x in zip(high[-9:], low[-9:])] == [hashlib.md5(f"{seed}|{t}".encode()).hexdigest() for t in texts[-9:]]


@pytest.mark.parametrize("name", ["aud5_two_level_leakage", "aud7_leakage_by_class", "jn4_semi_join_flags", "smp11_image_level_leakage"])
@pytest.mark.parametrize("n", [0, 1, 1002])
def test_any_number_of_rows_is_cut_as_in_sql(spark, tmp_path, name, n):
    V.table(spark, SF, "orders").limit(n).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)
