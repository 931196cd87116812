"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's bit is 1 if it is set in over half the 64-bit hashes of the text's word shingles. Fingerprints are split
into `parts` blocks; two that differ in at most `distance` bits agree in at least `parts - distance` blocks, so
each combination of that many blocks is a key, and only fingerprints that share a key are compared. More parts
make longer keys: their number follows the count of distinct fingerprints, and changes no result.

A key with over `chunk` fingerprints is divided into chunks, and each pair of chunks is a group of its own, so no task
holds a hot key. A group's links are reduced to a spanning forest where they are found; components
of the forest are found by passing least labels along links, with pointer jumping.

Edge cases: a null text counts as empty; a text without words has fingerprint 0, linked like any other; equal texts
have equal fingerprints and are compared once; null doc_ids get the component of their fingerprint, null if it has no other
document; a very long text is read whole; an empty table gives an empty result; other columns are ignored or, in `drop_copies`, kept.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.common import leanly
from corpuslab.operators.components import components
from corpuslab.plans.scratch import cut

SHINGLE = 4
DISTANCE = 4
#: Most fingerprints of a key that are compared in one group.
CHUNK = 2048
#: Fingerprints a key should hold on average, at most, by chance.
PER_KEY = 16.0


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Of UTF-8 bytes, as an unsigned integer."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())
    hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 32768):
        part = hashes[at : at + 32768]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: fp is the fingerprint as a signed long."""

    def scan(batches):
        for batch in leanly(batches):
            texts = batch.column(1).cast(pa.binary())  # taken one at a time: a list would hold the batch twice
            out = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, fp long")


def key_masks(n: int, distance: int) -> list[int]:
    """Masks of the bits that make each key, for n distinct fingerprints."""
    for parts in itertools.count(distance + 2):
        bits = 64 * (parts - distance) // parts
        if n / 2.0**bits <= PER_KEY or parts >= distance + 6:
            break
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(blocks, parts - distance)]


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, first node reached) that join what is linked among these fingerprints."""
    left, src, dst = np.arange(len(fps)), [], []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            found = left[near]
            if len(found):
                src.append(found)
                dst.append(np.full(len(found), root))
                queue.extend(found.tolist())
                left = left[~near]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(src) if src else none), (np.concatenate(dst) if dst else none)


def linked(fps: np.ndarray, runs: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of sorted group numbers: pairs for runs of up to 8, else a spanning forest."""
    starts = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(runs)])))
    size_of = np.repeat(sizes, sizes)
    src, dst = [], []
    for k in range(1, 8):
        i = np.flatnonzero((runs[k:] == runs[:-k]) & (size_of[k:] <= 8)) if len(runs) > k else np.zeros(0, dtype=np.int64)
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]) <= distance]
        src.append(fps[i + k])
        dst.append(fps[i])
    for at in np.flatnonzero(sizes > 8):
        own = fps[starts[at] : starts[at] + sizes[at]]
        a, b = forest(own, distance)
        src.append(own[a])
        dst.append(own[b])
    return np.concatenate(src), np.concatenate(dst)


def links(nodes: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """a, b: pairs of linked fingerprints whose components are those of all links. nodes: distinct fp."""
    masks = key_masks(nodes.count(), distance)
    # Each key is a masked fingerprint with the number of its mask hashed in; equal keys of other masks are told apart by k.
    keys = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("k", "key"))
    keys = keys.select("fp", F.col("k").cast("byte").alias("k"), "key")
    counts = keys.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(counts, ["k", "key"])
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("c")).cast("int")
    shared = shared.withColumn("c", chunks).withColumn("own", own)
    other = F.explode(F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda j: j != F.col("own"))))
    shared = shared.withColumn("other", other)
    shared = shared.withColumn("sub", F.greatest("own", "other") * F.lit(65536) + F.least("own", "other"))
    grouped = shared.select("k", "key", "sub", "fp").repartition("k", "key", "sub").sortWithinPartitions("k", "key", "sub")

    def verify(batches):
        rest: list[pa.RecordBatch] = []

        def flush(table):
            columns = [table.column(i).to_numpy() for i in range(3)]
            fps = table.column(3).to_numpy().view(np.uint64)
            new = np.zeros(len(fps), dtype=np.int64)
            for x in columns:
                new[1:] |= x[1:] != x[:-1]
            a, b = linked(fps, np.cumsum(new), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in leanly(batches):
            if not batch.num_rows:
                continue
            rest.append(batch)
            last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(3)]
            first = [rest[0].column(i)[0].as_py() for i in range(3)]
            if first == last:
                continue
            table = pa.Table.from_batches(rest)
            own = np.ones(table.num_rows, dtype=bool)
            for i in range(3):
                own &= table.column(i).to_numpy() == last[i]
            done = int(np.flatnonzero(~own)[-1]) + 1
            yield flush(table.slice(0, done))
            rest = table.slice(done).combine_chunks().to_batches()
        if rest:
            yield flush(pa.Table.from_batches(rest))

    return grouped.mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: for each row of docs (doc_id, text)."""
    # Narrow rows are gathered into few files: each file that is written starts processes of the executor.
    own = cut(fingerprints(docs, shingle).hint("rebalance"), "fingerprints")
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"), distance))
    placed = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(smallest, "label").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_copies(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Rows that repeat both that doc_id and
    the text leave one row; rows of null doc_id can't be told apart and stay."""
    classes = near_duplicates(docs, distance, shingle)
    keep = classes.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__keep")).distinct()
    # One shuffle by doc_id serves the join and the duplicates.
    kept = docs.join(keep, docs["doc_id"] == F.col("__keep"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def hex_of(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
