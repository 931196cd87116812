"""The pipeline on small tables of its own: each stage on its own input against a plain version, and tables that are odd or empty."""

from __future__ import annotations

import base64
import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corpuslab.llm import quality_gam, quality_rules, simhash  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, `__skey` string"
LABELS = "doc_id long, quality int, toxic int"


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(600)]
    docs, labels = [], []
    for i in range(260):
        own = [r.choice(words) for _ in range(r.randrange(60, 150))]
        bad = i % 4 == 0
        text = " ".join(w + r.choice(["***", "$$$", "###"]) if bad else w for w in own)
        docs.append((i, text, "en", r.choice(["a", "b", "b", None]), 0, "x", "y"))
        labels.append((i, int(not bad), 0))
    good = [d for d in docs if d[0] % 4]
    docs += [(1000 + k, d[1], *d[2:]) for k, d in enumerate(good[:20])]  # copies
    docs += [(2000 + k, d[1] + " oneword", *d[2:]) for k, d in enumerate(good[20:30])]
    docs += [good[0], good[0], (None, good[1][1], *good[1][2:]), (3000, None, "en", "a", None, None, None), (3001, "", None, None, 0, "", ""), (3002, good[2][1] * 40, "en", "a", 1, "x", "y")]
    return write(spark, tmp_path_factory.mktemp("pipeline"), docs, labels)


def components(rows):
    """The least doc_id of each document's component, by comparing all pairs."""
    fps = [(r["doc_id"], simhash.fingerprint((r["text"] or "").encode())) for r in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j][1]).bit_count() <= simhash.DISTANCE:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(fps):
        if d is not None:
            groups[find(i)].append(d)
    return {min(g) for g in groups.values()}


def test_each_stage_on_its_own_input(spark, tables):
    import tiktoken

    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    kept = corpus_pipeline.rules(spark, docs, tables)
    judged = [r for r in quality_rules.judge(docs, docs, labels).collect() if r["kept"]]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in judged) and kept.columns == docs.columns
    good = corpus_pipeline.classifier(spark, kept, tables)
    model = quality_gam.train(docs, labels)
    import pyarrow as pa

    rows = kept.collect()
    scores = model.score(quality_gam.features(pa.array([r["text"] for r in rows], pa.string())))
    assert sorted(str(r["doc_id"]) for r in good.collect()) == sorted(str(r["doc_id"]) for r, s in zip(rows, scores) if s >= quality_gam.THRESHOLD)
    once = corpus_pipeline.near_duplicates(spark, good, tables)
    got = once.collect()
    assert {r["doc_id"] for r in got if r["doc_id"] is not None} == components(good.collect()) and len(got) == len({(r["doc_id"], r["text"]) for r in got})
    mixed = corpus_pipeline.mixture(spark, once, tables).collect()
    times = collections.Counter((r["doc_id"], r["text"]) for r in mixed)
    size = lambda t: len((t or "").split())
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r["source"]] += size(r["text"])
    for r in mixed:
        taken[r["source"]] += size(r["text"])
    total, largest = sum(sizes.values()), max(size(r["text"]) for r in got)
    assert max(times.values()) <= 3 and abs(sum(taken.values()) - total) <= largest * len(sizes)
    assert all(taken[s] <= 3 * sizes[s] for s in sizes)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = corpus_pipeline.tokens(spark, spark.createDataFrame(mixed, docs.schema), tables).collect()
    text_of = {r["doc_id"]: r["text"] for r in mixed}
    assert len(ids) == len(mixed) and all(r["round_trip"] and r["ids"] == encoding.encode_ordinary(text_of[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"]) for r in ids)


def test_run_is_its_stages(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    again = corpus_pipeline.run(spark, tables).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, again)) and all(r["round_trip"] for r in rows)
    ids = {r["doc_id"] for r in rows}
    assert not ids & {3000, 3001} and not ids & set(range(1000, 1020)) and not ids & set(range(0, 260, 4))


def test_run_on_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, write(spark, tmp_path / "none", [], []))
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"] and out.count() == 0


def test_run_without_labels(spark, tmp_path):
    words = [f"word{i}" for i in range(400)]
    docs = [(i, " ".join(words[i : i + 80]), "en", "a", 0, "x", "y") for i in range(0, 300, 60)]
    out = corpus_pipeline.run(spark, write(spark, tmp_path / "bare", docs, [])).select("doc_id").distinct().count()
    assert out == len(docs)


def test_fields_of_documents_stay(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert corpus_pipeline.near_duplicates(spark, docs, tables).columns == docs.columns
    assert corpus_pipeline.mixture(spark, docs.where(F.col("doc_id") < 50), tables).columns == docs.columns


def test_workers_take_few_times_their_batch():
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(words[k % 7 :]) + f" {k}" for k in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    rules = lambda: quality_rules.judge_batches([batch], (np.zeros(quality_rules.DIMENSIONS), 0.0, 1.0, 0.0), True)
    classifier = lambda: quality_gam._score_batches([batch], quality_gam.Additive(0.5), 0.3, True)
    for stage in (rules, classifier):
        tracemalloc.start()
        assert sum(part.num_rows for part in stage()) in (0, len(texts))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 4 * batch.nbytes


def test_texts_pass_in_small_batches(spark, tables):
    """A stage is lazy: the batches are small when its rows are written, and the session's own again after run()."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for stage in (corpus_pipeline.rules, corpus_pipeline.classifier, corpus_pipeline.near_duplicates):
            spark.conf.set(key, "10000")
            stage(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
            assert int(spark.conf.get(key)) <= 1000
        spark.conf.set(key, "10000")
        corpus_pipeline.run(spark, tables)
        assert spark.conf.get(key) == "10000"
    finally:
        spark.conf.set(key, before)
