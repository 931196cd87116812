"""Readers, writers and streams on files of a temporary folder."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpuslab.functions.scalars import object_hash
from corpuslab import __main__ as cli
from corpuslab.operators import audits, corpus, gate, images, similarity
from corpuslab.operators.runs import load_runs
from corpuslab.registry import QUERIES
from corpuslab.sources import readers, writers


def test_records_keep_the_order_of_their_lines(spark, tmp_path):
    rows = [{"path": f"p{i}.png", "label": i % 4, "source": "real"} for i in range(50)]
    (tmp_path / "a.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows[:30]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r) for r in rows[30:]))
    got = readers.read_records(spark, str(tmp_path / "*.jsonl")).orderBy("ord").collect()
    assert [r["path"] for r in got] == [r["path"] for r in rows] and [r["ord"] for r in got] == list(range(50))


def test_object_hash_is_that_of_the_driver(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    got = [r[0] for r in df.orderBy("a").select(object_hash({"b": F.col("b"), "a": F.col("a")})).collect()]
    assert got == [writers.object_hash({"a": 1, "b": "x"}), writers.object_hash({"a": 2, "b": None})]
    assert writers.run_identity({"name": "n", "x": 1}, 0)[0] == writers.object_hash({"generator": "none", "x": 1})


def test_bibliography_counts_braces(spark):
    df = spark.createDataFrame([("f1", "@article{k1, title={A {B} c}}\n@book{k2, x={y}}"), ("f2", None), ("f3", "none")], "file string, value string")
    got = sorted(tuple(r) for r in gate.bibliography(df).collect())
    assert got == [("f1", "article", "k1", "title={A {B} c}"), ("f1", "book", "k2", "x={y}")]


def test_empty_classes_stay(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "label int, path string")
    assert sorted((r["label"], r["path"] or "") for r in corpus.buckets(df, 4).collect()) == [(0, ""), (1, "a"), (1, "b"), (2, ""), (3, "c")]


def test_pair_consistency_of_nothing(spark):
    r = audits.pair_consistency(spark.createDataFrame([], "d string, l int, c int"), "d", "l", "c").first()
    assert (r["pairs"], r["same_label"], r["same_count"], r["median"]) == (0, 0, 0, None)


def png(pixels: np.ndarray) -> bytes:
    """An image file of (height, width, 3) bytes, uncompressed filters."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = pixels.shape
    rows = b"".join(b"\0" + r.tobytes() for r in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    r = np.random.default_rng(0)
    base = np.kron(r.integers(0, 256, (8, 8, 3)), np.ones((12, 16, 1)))
    pictures = {"a": base, "b": np.clip(base + r.normal(0, 2, base.shape), 0, 255), "c": r.integers(0, 256, (50, 40, 3)), "d": np.full((4, 4, 3), 90)}
    for name, p in pictures.items():
        (tmp_path / f"{name}.png").write_bytes(png(np.asarray(p)))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG nothing")
    assert {(s["path"][-5], s["width"], s["height"]) for s in readers.image_sizes(spark, str(tmp_path)).collect()} == {("a", 128, 96), ("b", 128, 96), ("c", 40, 50), ("d", 4, 4)}
    loaded = images.load(spark, str(tmp_path))
    h = {s["path"][-5]: s["h"] for s in images.hashes(loaded).collect()}
    apart = lambda p, q: ((h[p] ^ h[q]) & (2**64 - 1)).bit_count()
    assert apart("a", "b") <= 8 < apart("a", "c")
    plain = np.asarray(pictures["a"]).astype(np.uint8).astype(float)
    assert h["a"] % 2**64 == images.perceptual_hash(plain)
    v = {s["path"][-5]: s["v"] for s in images.pixel_vectors(loaded).collect()}
    small = plain.reshape(32, 3, 32, 4, 3).mean(axis=(1, 3)).ravel() / 255
    assert len(v["a"]) == 32 * 32 * 3 and np.allclose(v["a"], small - small.mean()) and np.allclose(v["d"], 0)
    pairs = similarity.hamming_pairs(images.hashes(loaded), 8, "path").collect()
    assert {(p["a"][-5], p["b"][-5]) for p in pairs} == {("a", "b")}


def test_hamming_pairs_are_all_pairs(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 40)
    hashes = np.concatenate([base, *(base ^ np.bitwise_or.reduce(1 << r.integers(0, 63, (k, 40)), axis=0) for k in (1, 4, 8, 9))])
    rows = [(int(i), int(h)) for i, h in enumerate(hashes)] + [(1000 + k, int(hashes[0])) for k in range(60)]
    got = {(p["a"], p["b"], p["distance"]) for p in similarity.hamming_pairs(spark.createDataFrame(rows, "ord long, h long"), 8, chunk=16).collect()}
    want = {(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 8}
    assert got == want


def test_ranks_of_pairs_are_those_of_a_sort(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.normal(size=(90, 6))
    x[40:60] = x[39]  # ties
    x[5] = 0  # says nothing
    df = spark.createDataFrame([(i, i // 3, v.tolist()) for i, v in enumerate(x)], "ord long, grp long, v array<double>")
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    s = np.array([u[i] @ u[j] for i in range(90) for j in range(i) if i // 3 != j // 3 and 5 not in (i, j)])
    monkeypatch.setattr(similarity, "FEW", 50)
    n, ranked, q, counts, most = similarity.pair_ranks(df, lambda n: [0, n // 2, n - 1], [0.25, 0.9, 0.999], [0.5, 0.999999], apart="grp", block=20)
    assert n == len(s) and np.allclose(ranked, np.sort(s)[[0, n // 2, n - 1]]) and np.allclose(q, np.quantile(s, [0.25, 0.9, 0.999]))
    assert counts[0] == ((s >= 0.5).sum(), (s > 0.5).sum()) and np.isclose(most, s.max())
    best = {b["i"]: b["score"] for b in similarity.best_of_each(df, block=20).collect()}
    full = u @ u.T - 3 * np.eye(90)
    full[:, 5] = -3
    assert 5 not in best and all(np.isclose(best[i], full[i].max()) for i in range(90) if i != 5)


def test_report_and_audit_log(spark, tmp_path):
    writers.write_report(spark.createDataFrame([(1, "x")], "a int, b string"), f"file://{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1, "b": "x"}


def test_head_queries(spark, sf):
    one = QUERIES["cls2_heads"](spark, sf).collect()
    assert {r["head"] for r in one} == {"logreg", "forest"} and all(0 <= r["accuracy"] <= 1 and r["n"] > 0 for r in one)
    two = {r["arm"]: r for r in QUERIES["cls3_arm_sweep"](spark, sf).collect()}
    assert set(two) == {"all", "half"} and two["all"]["n"] == two["half"]["n"]
    folds, stratum = QUERIES["cls8_cross_validated"](spark, sf).first(), QUERIES["abl3_stratum_feature"](spark, sf).first()
    assert folds["n"] == spark.read.parquet(f"{sf}/embeddings.parquet").count() and 0 <= stratum["accuracy"] <= 1


def test_stream_counts_every_window_that_is_closed(spark, sf):
    got = QUERIES["str1_manifest_stream"](spark, sf).collect()
    events = spark.read.parquet(f"{sf}/events.parquet")
    total = sum(sum(v for k, v in r.asDict().items() if k in ("ok", "empty", "throttled")) for r in got)
    assert 0 < total <= events.count() and len({(r["substrate"], r["start"]) for r in got}) == len(got)


def test_command_line(spark, tmp_path, capsys):
    r = np.random.default_rng(4)
    for k, (seed, frac) in enumerate((s, f) for s in range(3) for f in (0.0, 0.5, 1.0)):
        config = {"arm": f"sub_p{int(100 * frac):03d}", "mix_kind": "substitution", "synthetic_fraction": frac, "generator": "synth_open", "init": "scratch", "seed": seed}
        (tmp_path / "runs" / str(seed)).mkdir(parents=True, exist_ok=True)
        record = {"run_id": f"r{k}", "config": config, "val": {"balanced_accuracy": 0.6 - 0.2 * frac + 0.005 * r.random()}}
        (tmp_path / "runs" / str(seed) / f"run_{k}.json").write_text(json.dumps(record))
    (tmp_path / "runs" / "run_copy.json").write_text((tmp_path / "runs" / "0" / "run_0.json").read_text())
    runs = load_runs(spark, str(tmp_path / "runs"))
    assert runs.count() == 9 and {x["split"] for x in runs.collect()} == {"val"}
    assert cli.main(["smoke", str(tmp_path / "runs")]) == 0
    assert cli.main(["smoke", str(tmp_path / "runs"), "--gap", "0"]) == 1
    assert cli.main(["smoke", str(tmp_path / "runs"), "--log", f"{tmp_path}/none.jsonl"]) == 1
    x = r.normal(size=(40, 8))
    x[30:] = x[:10] + 0.001
    rows = [(i, "real" if i < 20 else "synth_open", v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "ord long, source string, v array<double>").write.parquet(f"{tmp_path}/v.parquet")
    capsys.readouterr()
    assert cli.main(["calibrate", f"{tmp_path}/v.parquet", "--mode", "per_pair", "--rate", "0.02", "--reference", "0.99"]) == 0
    out = capsys.readouterr().out
    found = json.loads(out[out.index("{") : out.index("}") + 1])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.sort((u @ u.T)[np.triu_indices(40, 1)])
    assert found["pairs"] == len(s) and np.isclose(found["median"], np.median(s)) and np.isclose(found["threshold"], min(s[len(s) - 1 - int(0.02 * len(s))], 1.0))
    assert cli.main(["controls", f"{tmp_path}/v.parquet", f"{tmp_path}/out"]) == 0
    report = spark.read.csv(f"{tmp_path}/out/memorisation", header=True, inferSchema=True).first()
    assert report["n"] == 20 and np.isclose(report["rate"], 0.5)
    assert cli.main(["list"]) == 0 and "flagship_cluster_report" in capsys.readouterr().out


def test_readers_of_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('id\tname\n1\t"a b"\n2\tc\n')
    (tmp_path / "m.csv").write_text('id,name\n1,"a, b"\n')
    (tmp_path / "l_3.txt").write_text("p1.jpg 2 14 extra\nbad\np2.jpg 0 3\np3.jpg 9 1\n\n")
    coco = {"images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}], "annotations": [{"id": 7, "image_id": 1}, {"id": 8, "image_id": 1}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    assert [tuple(r)[:2] for r in readers.read_tsv(spark, str(tmp_path / "m.tsv"), "id string, name string").orderBy("id").collect()] == [("1", "a b"), ("2", "c")]
    assert [tuple(r)[:2] for r in readers.read_csv(spark, str(tmp_path / "m.csv"), "id string, name string").collect()] == [("1", "a, b")]
    assert sorted((r["name"], r["grade"], r["lesions"]) for r in readers.read_labels(spark, str(tmp_path / "l_3.txt")).collect()) == [("p1.jpg", 2, 14), ("p2.jpg", 0, 3)]
    assert {(r["file_name"], r["n"]) for r in readers.read_coco(spark, str(tmp_path / "c.json")).collect()} == {("a.jpg", 2), ("b.jpg", 0)}
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.png").write_bytes(b"123")
    assert [(r["name"], r["length"]) for r in readers.list_files(spark, str(tmp_path / "x"), "*.png").collect()] == [("f.png", 3)]
