"""Exact nearest neighbours by inner product: a block matrix join of int8 tiles, recomputed in float where they can matter.

Queries and candidates are dealt to (query block, candidate slice) groups. In a group, candidates pass in batches:
vectors are quantised to int8 with a scale each; the integer products of a tile give every inner product up to
|q'||e| + |e'||c|, where e and e' are the quantisation errors. A pair survives if its upper bound
reaches the query's k-th best so far (or, at first, the k-th best lower bound of the tile); survivors
are recomputed in double precision from the original vectors and merged into the query's heap. The heaps of a
query's slices, one row each, are merged at the end.

Integer products are taken in float32, where they are exact up to 2**24: any dimension up to 1040; beyond it in float64.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, and neither do rows of null id;
vectors of another dimension than the query's are no candidates; ties go to the smaller id; repeated ids are
candidates of their own, except for the query's own id; a query repeated with the same vector counts once, with other vectors once for each; fewer candidates than k give fewer rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 20
#: Queries in a block: with their heaps, what a task keeps in memory.
BLOCK = 8192
#: Candidates in a slice, about, and the least number of slices; a query is dealt to each slice and leaves one heap there.
SLICE, SLICES = 65536, 8
#: Candidates that pass at once.
TILE = 2048


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, norms of the quantised vectors, norms of the errors. Norms are rounded up a little."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    up = 1 + 1e-9
    return q, scale, np.linalg.norm(back, axis=1) * up, np.linalg.norm(x - back, axis=1) * up


class Heaps:
    """The k best candidates of each query of one dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.rows, self.x, self.k = ids, rows, vectors, k
        self.slack = 4 * (vectors.shape[1] + 4) * 2.0**-52
        self.q, self.scale, self.norm, self.err = quantise(vectors)
        self.exact = np.float32 if vectors.shape[1] <= 1040 else np.float64
        self.q = self.q.astype(self.exact)
        self.full = np.linalg.norm(vectors, axis=1) * (1 + 1e-9)
        self.best = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        c, scale, _, err = quantise(vectors)
        c = c.astype(self.exact)
        full = np.linalg.norm(vectors, axis=1) * (1 + 1e-9)
        for at in range(0, len(self.ids), 1024):
            rows = slice(at, at + 1024)
            near = (self.q[rows] @ c.T).astype(np.float64) * self.scale[rows, None] * scale[None, :]
            # What rounding can add, in these products and in the exact ones, is below the last term.
            bound = self.norm[rows, None] * err[None, :] + self.err[rows, None] * full[None, :] + self.slack * self.full[rows, None] * full[None, :]
            floor = self.best[rows, -1]
            if len(ids) > self.k and np.isneginf(floor).any():  # the k-th best lower bound, one more for the query's own row
                lower = np.partition(near - bound, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1]
                floor = np.maximum(floor, np.where((self.ids[rows, None] == ids[None, :]).sum(axis=1) <= 1, lower, -np.inf))
            i, j = np.nonzero(near + bound >= floor[:, None])
            own = self.ids[rows][i] != ids[j]
            i, j = i[own] + at, j[own]
            for part in range(0, len(i), 262144):
                self.merge(i[part : part + 262144], j[part : part + 262144], ids, vectors)

    def merge(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(i):
            return
        score = np.einsum("nd,nd->n", self.x[i], vectors[j])
        touched, start = np.unique(i, return_index=True)
        old = np.repeat(touched, self.k)
        row = np.concatenate((old, i))
        s = np.concatenate((self.best[touched].ravel(), score))
        w = np.concatenate((self.who[touched].ravel(), ids[j]))
        order = np.lexsort((w, -s, row))
        row, s, w = row[order], s[order], w[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        take = first[:, None] + np.arange(self.k)[None, :]
        self.best[touched], self.who[touched] = s[take], w[take]


def parse(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(is_query, ids, row numbers, vectors as float64) for each dimension in the batch."""
    lists = batch.column("v")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    query, ids, rows = batch.column("query").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(), batch.column("row").to_numpy()
    out = []
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out.append((query[at], ids[at], rows[at], flat[starts[at][:, None] + np.arange(d)[None, :]]))
    return out


def slice_search(batches, k: int):
    """Rows come sorted by (block, slice), queries first. Yields a heap for each query of each group."""

    def give(queries):
        heaps = [h for x in queries.values() for h in x if isinstance(h, Heaps)]
        for h in heaps:
            for at in range(0, len(h.ids), 2048):
                n = (h.who[at : at + 2048] != np.iinfo(np.int64).max).sum(axis=1)
                mask = np.arange(k)[None, :] < n[:, None]
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                who = pa.ListArray.from_arrays(offsets, pa.array(h.who[at : at + 2048][mask]))
                best = pa.ListArray.from_arrays(offsets, pa.array(h.best[at : at + 2048][mask]))
                yield pa.RecordBatch.from_arrays([pa.array(h.ids[at : at + 2048]), pa.array(h.rows[at : at + 2048]), who, best], ["query_id", "row", "ids", "scores"])

    group, queries = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = (batch.column("block").to_numpy().astype(np.int64) << 32) + batch.column("slice").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if keys[lo] != group:
                yield from give(queries)
                group, queries = keys[lo], {}
            for query, ids, rows, x in parse(batch.slice(lo, hi - lo)):
                own = queries.setdefault(x.shape[1], [])
                if query.any():
                    own.append((ids[query], rows[query], x[query]))
                ids, x = ids[~query], x[~query]
                if not len(ids) or not own:
                    continue
                if not isinstance(own[0], Heaps):
                    own[:] = [Heaps(*(np.concatenate([o[i] for o in own]) for i in range(3)), k)]
                for at in range(0, len(ids), TILE):
                    own[0].add(ids[at : at + TILE], x[at : at + TILE])
    yield from give(queries)


def nearest(vectors: DataFrame, is_query, k: int = K, block: int = BLOCK, slices: int | None = None, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on the rows of vectors."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    good = F.col(vec).isNotNull() & F.col(key).isNotNull()
    rows = vectors.where(good).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"), v.alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("x", lambda x: x != 0)
    rows = rows.where(sound).drop("x")
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("query"), 1)).alias("q")).first()
    blocks = max(1, math.ceil(counted["q"] / block))
    slices = slices or max(SLICES, math.ceil(counted["n"] / SLICE))
    # A row's number: rows of one id and other vectors are queries of their own.
    rows = rows.withColumn("row", F.xxhash64("v"))
    queries = rows.where("query").dropDuplicates(["id", "v"]).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    candidates = rows.withColumn("query", F.lit(False)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("slice", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(slices)).cast("int"))
    both = queries.unionByName(candidates).select("block", "slice", "query", "id", "row", "v")
    both = both.repartition("block", "slice").sortWithinPartitions("block", "slice", F.desc("query"))
    heaps = both.mapInArrow(lambda batches: slice_search(batches, k), "query_id long, row long, ids array<long>, scores array<double>")
    pairs = F.arrays_zip(F.col("ids"), F.col("scores"))
    ordered = F.transform(pairs, lambda p: F.struct((-p["scores"]).alias("s"), p["ids"].alias("vec_id"), p["scores"].alias("score")))
    merged = heaps.groupBy("query_id", "row").agg(F.slice(F.array_sort(F.flatten(F.collect_list(ordered))), 1, k).alias("top"))
    out = merged.select("query_id", F.posexplode("top").alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
