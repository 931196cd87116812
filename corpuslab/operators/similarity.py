"""Joins by similarity: cosine pairs, Hamming pairs, nearest neighbours."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block: two blocks of 512-dimensional doubles take 16 MB in a task.
BLOCK = 2048


def detected(v: Column) -> Column:
    """Whether a vector says anything: a zero vector means that nothing was found."""
    return F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def normalised(v: Column, epsilon: float = 1e-12) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / (n + F.lit(epsilon))))[0]


def _unit(column) -> np.ndarray:
    x = np.vstack(column.to_numpy()) if len(column) else np.zeros((0, 1))
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def _dealt(vectors: DataFrame, key: str, vec: str, block: int, more: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """hi, lo, __b, id, v: rows dealt to all pairs of blocks with their own; and the key's type."""
    rows, n = _blocks(vectors.where(detected(F.col(vec))).select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"), *more), "id", block)
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("__o", other).select(F.greatest("__b", "__o").alias("hi"), F.least("__b", "__o").alias("lo"), "__b", "id", "v", *more)
    return dealt, rows.schema["id"].dataType.simpleString()


def _sides(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The two blocks of a group, and whether they are one."""
    lo, hi = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
    return group[group["__b"] == lo], group[group["__b"] == hi], lo == hi


def _products(group: pd.DataFrame, rows: int = 256):
    """(left rows, right rows, similarities, which of them are pairs of two rows, each once) in strips of `rows`; of one group's columns `apart`, equal values are no pair."""
    left, right, same = _sides(group)
    if not len(left) or not len(right):
        return
    x, y, a, b = _unit(left["v"]), _unit(right["v"]), left["id"].to_numpy(), right["id"].to_numpy()
    for at in range(0, len(left), rows):
        own = slice(at, at + rows)
        pairs = (a[own, None] < b[None, :]) if same else (a[own, None] != b[None, :])
        if "apart" in group:
            pairs &= left["apart"].to_numpy()[own, None] != right["apart"].to_numpy()[None, :]
        yield a[own], b, x[own] @ y.T, pairs


#: Ranges in which similarities are counted at once; a range of at most this many similarities is put in order.
RANGES, FEW = 4096, 200_000


def pair_ranks(vectors: DataFrame, ranks=None, quantiles: list[float] = (), thresholds: list[float] = (), key: str = "ord", vec: str = "v", apart: str | None = None, block: int = BLOCK):
    """(pairs, the similarities at ranks from the least, at the quantiles with linear interpolation, the numbers of
    similarities at least and above each threshold, the greatest) of all pairs of rows; rows of one value of `apart` are no pair. `ranks`
    gives the ranks for the number of pairs.

    No pair leaves its task. Each pair of blocks counts its similarities in RANGES ranges; the ranges in which ranks fall are counted again in
    finer ones until FEW are left, which are put in order. What reaches the driver is a row for each range of one rank.
    """
    more = () if apart is None else ("apart",)
    dealt, _ = _dealt(vectors if apart is None else vectors.withColumn("apart", F.col(apart)), key, vec, block, more)
    thresholds = list(thresholds)

    def totals(group: pd.DataFrame) -> pd.DataFrame:
        n, most, at_least, above = 0, -np.inf, np.zeros(len(thresholds), dtype=np.int64), np.zeros(len(thresholds), dtype=np.int64)
        for _, _, sim, pairs in _products(group):
            s = sim[pairs]
            n += len(s)
            most = max(most, s.max(initial=-np.inf))
            at_least += np.array([(s >= t).sum() for t in thresholds], dtype=np.int64)
            above += np.array([(s > t).sum() for t in thresholds], dtype=np.int64)
        return pd.DataFrame({"n": [n], "most": [most], "at_least": [at_least.tolist()], "above": [above.tolist()]})

    sums = [F.sum(F.get(c, i)).alias(f"{c}{i}") for c in ("at_least", "above") for i in range(len(thresholds))]
    total = dealt.groupBy("lo", "hi").applyInPandas(totals, "n long, most double, at_least array<long>, above array<long>").agg(F.sum("n").alias("n"), F.max("most").alias("most"), *sums).first()
    n = total["n"] or 0
    counts = [(total[f"at_least{i}"] or 0, total[f"above{i}"] or 0) for i in range(len(thresholds))]
    if not n:
        return 0, [], [None for _ in quantiles], counts, None
    ranks = ranks(n) if ranks else []
    places = [(n - 1) * q for q in quantiles]
    wanted = sorted({*ranks, *(k for p in places for k in (math.floor(p), math.ceil(p)))})
    found = _at_ranks(dealt, wanted)
    between = lambda p: found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p))
    return n, [found[k] for k in ranks], [between(p) for p in places], counts, total["most"]


def _at_ranks(dealt: DataFrame, wanted: list[int]) -> dict[int, float]:
    """The similarities at ranks (from 0, ascending)."""
    found: dict[int, float] = {}
    # (low, high, similarities below low, ranks within): a similarity s belongs to a range if low <= s < high.
    open_ranges = [(-1.5, 1.5, 0, wanted)] if wanted else []
    while open_ranges:
        edges = [np.linspace(lo, hi, RANGES + 1) for lo, hi, _, _ in open_ranges]

        def count(group: pd.DataFrame) -> pd.DataFrame:
            sums = np.zeros((len(edges), RANGES), dtype=np.int64)
            for _, _, sim, pairs in _products(group):
                s = sim[pairs]
                for k, e in enumerate(edges):
                    own = s[(s >= e[0]) & (s < e[-1])]
                    sums[k] += np.bincount(np.searchsorted(e, own, "right") - 1, minlength=RANGES)[:RANGES]
            k, i = np.nonzero(sums)
            return pd.DataFrame({"k": k, "i": i, "n": sums[k, i]})

        sums = np.zeros((len(edges), RANGES), dtype=np.int64)
        for r in dealt.groupBy("lo", "hi").applyInPandas(count, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
            sums[r["k"], r["i"]] = r["n"]
        finer, few = [], []
        for (_, _, below, ranks), e, own in zip(open_ranges, edges, sums):
            before = below + np.concatenate(([0], np.cumsum(own)))
            by_range: dict[int, list[int]] = {}
            for rank in ranks:
                by_range.setdefault(int(np.searchsorted(before, rank, "right")) - 1, []).append(rank)
            for i, inside in by_range.items():
                narrow = e[i + 1] - e[i] < 1e-14
                (few if own[i] <= FEW or narrow else finer).append((float(e[i]), float(e[i + 1]), int(before[i]), inside))
        if few:

            def give(group: pd.DataFrame) -> pd.DataFrame:
                out = [(k, s[(s >= lo) & (s < hi)]) for _, _, sim, pairs in _products(group) for s in (sim[pairs],) for k, (lo, hi, _, _) in enumerate(few)]
                values = [np.unique(s, return_counts=True) for _, s in out]
                return pd.DataFrame({"k": np.repeat([k for k, _ in out], [len(v) for v, _ in values]), "s": np.concatenate([v for v, _ in values]) if values else [], "n": np.concatenate([c for _, c in values]) if values else []})

            # At most FEW similarities of each range; within a range too narrow to part they are all but one value.
            rows = dealt.groupBy("lo", "hi").applyInPandas(give, "k long, s double, n long").groupBy("k", "s").agg(F.sum("n").alias("n")).toPandas()
            for k, (_, _, below, ranks) in enumerate(few):
                own = rows[rows["k"] == k].sort_values("s")
                after = below + np.cumsum(own["n"].to_numpy())
                for rank in ranks:
                    found[rank] = float(own["s"].to_numpy()[np.searchsorted(after, rank, "right")])
        open_ranges = finer
    return found


def best_of_each(vectors: DataFrame, key: str = "ord", vec: str = "v", apart: str | None = None, block: int = BLOCK) -> DataFrame:
    """i, score: each row's greatest similarity to another row, of another value of `apart`. A pair of blocks gives one row for each of its rows."""
    more = () if apart is None else ("apart",)
    dealt, kind = _dealt(vectors if apart is None else vectors.withColumn("apart", F.col(apart)), key, vec, block, more)

    def best(group: pd.DataFrame) -> pd.DataFrame:
        left, right, _ = _sides(group)
        score = pd.Series(-np.inf, index=pd.unique(pd.concat([left["id"], right["id"]])))
        for a, b, sim, pairs in _products(group):
            sim = np.where(pairs, sim, -np.inf)
            for ids, top in ((a, sim.max(axis=1)), (b, sim.max(axis=0))):
                score.loc[ids] = np.maximum(score.loc[ids].to_numpy(), top)
        score = score[np.isfinite(score)]
        return pd.DataFrame({"i": score.index, "score": score.to_numpy()})

    return dealt.groupBy("lo", "hi").applyInPandas(best, f"i {kind}, score double").groupBy("i").agg(F.max("score").alias("score"))


def _blocks(df: DataFrame, key: str, block: int) -> tuple[DataFrame, int]:
    n = max(1, math.ceil(df.count() / block))
    return df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def cosine_pairs(vectors: DataFrame, threshold: float, key: str = "ord", vec: str = "v", block: int = BLOCK) -> DataFrame:
    """a, b, sim: pairs a < b whose cosine is at least the threshold; zero vectors pair with nothing.

    Rows are dealt to blocks; a pair of blocks is one matrix product, so a task holds two blocks and gives only the pairs that count.
    """
    dealt, kind = _dealt(vectors, key, vec, block)

    def product(group: pd.DataFrame) -> pd.DataFrame:
        found = [(a[i], b[j], sim[i, j]) for a, b, sim, pairs in _products(group) for i, j in (np.nonzero(pairs & (sim >= threshold)),)]
        a, b, s = (np.concatenate([f[k] for f in found]) if found else [] for k in range(3))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": s} if len(a) else {"a": [], "b": [], "sim": []})

    return dealt.groupBy("lo", "hi").applyInPandas(product, f"a {kind}, b {kind}, sim double")


#: Most hashes of a key that are compared in one task, and how many a key should hold by chance.
CHUNK, PER_KEY = 2048, 16.0


def hamming_keys(n: int, most: int, width: int = 64) -> list[int]:
    """Masks of the bits that make each key, for n hashes: of `parts` blocks at least parts - most are equal, so each
    combination of that many blocks is a key. More parts make longer keys and change no result."""
    for parts in itertools.count(most + 1):
        if n / 2.0 ** (width * (parts - most) // parts) <= PER_KEY or math.comb(parts, most) > 600:
            break
    edges = [round(width * i / parts) for i in range(parts + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(blocks, parts - most)]


def hamming_pairs(hashes: DataFrame, most: int, key: str = "ord", bits: str = "h", width: int = 64, chunk: int = CHUNK) -> DataFrame:
    """a, b, distance: pairs a < b of hashes of `width` bits that differ in at most `most`. Rows that share a key are compared;
    a key of more than `chunk` rows is parted, and each pair of its parts is a group of its own."""
    rows = hashes.select(F.col(key).alias("id"), F.col(bits).cast("long").alias("h")).where("h IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    masks = hamming_keys(rows.count(), most, width)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = rows.select("id", "h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("k", "key"))
    counts = keys.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(counts, ["k", "key"]).withColumn("c", F.ceil(F.col("n") / chunk).cast("int"))
    shared = shared.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    dealt = shared.select("k", "key", F.greatest("own", "other").alias("hi"), F.least("own", "other").alias("lo"), "own", "id", "h")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        left, right = group[group["own"] == lo], group[group["own"] == hi]
        a, b, x, y = left["id"].to_numpy(), right["id"].to_numpy(), left["h"].to_numpy().view(np.uint64), right["h"].to_numpy().view(np.uint64)
        distance = np.bitwise_count(x[:, None] ^ y[None, :])
        near = distance <= most
        near &= (a[:, None] < b[None, :]) if lo == hi else (a[:, None] != b[None, :])
        # A pair is given by the first key that it shares.
        mine, k = near.copy(), int(group["k"].iloc[0])
        for m in masks[:k]:
            mine &= ((x[:, None] ^ y[None, :]) & np.uint64(m)) != 0
        i, j = np.nonzero(mine)
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "distance": distance[i, j].astype(np.int32)})

    return dealt.groupBy("k", "key", "lo", "hi").applyInPandas(verify, f"a {kind}, b {kind}, distance int")


def nearest(queries: DataFrame, reference: DataFrame, key: str = "ord", vec: str = "v", by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """id, ref, sim: the most similar reference row of each query, the smallest key among equals (to 12 digits).

    Blocks of queries meet blocks of the reference; a query's best of each block are reduced to one. `by` names columns of both
    sides (few values, such as a fold) within which to search.
    """
    by = by or []
    q, nq = _blocks(queries.select(*by, F.col(key).alias("id"), F.col(vec).alias("v")), "id", block)
    r, nr = _blocks(reference.select(*by, F.col(key).alias("id"), F.col(vec).alias("v")), "id", block)
    q = q.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).select(*by, F.col("__b").alias("qb"), F.col("__o").alias("rb"), "id", "v")
    r = r.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select(*by, F.col("__o").alias("qb"), F.col("__b").alias("rb"), "id", "v")
    kinds = {f.name: f.dataType for f in q.schema.fields}
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in by], T.StructField("id", kinds["id"]), T.StructField("ref", kinds["id"]), T.StructField("sim", T.DoubleType())])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        right = right.sort_values("id")
        sim = np.round(_unit(left["v"]) @ _unit(right["v"]).T, 12)
        at = sim.argmax(axis=1)
        out = left[[*by, "id"]].copy()
        out["ref"], out["sim"] = right["id"].to_numpy()[at], sim[np.arange(len(left)), at]
        return out

    keys = [*by, "qb", "rb"]
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(best, schema)
    return found.groupBy(*by, "id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "ref", "sim")).alias("x")).select(*by, "id", F.col("x.ref").alias("ref"), F.col("x.sim").alias("sim"))
