"""Splits in which no group crosses a boundary, the sealed test part, and leakage by simulation."""

from __future__ import annotations

import datetime
import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpuslab.functions.digests import STEP, md5_of
from corpuslab.functions.draws import order_key
from corpuslab.operators.corpus import majority_label
from corpuslab.plans.scratch import append_line, cut, drop

FRACTIONS = {"train": 0.65, "val": 0.15, "test": 0.20}
SEED = 20260101
#: Digests of trials that a task makes, about, up to so many tasks.
DIGESTS, PARTS = 5_000_000, 4096


class SplitError(ValueError):
    """A split that is too small or misses a class."""


class SealedError(RuntimeError):
    """The test part was read before it was unsealed."""


class LeakageError(ValueError):
    """Records or groups are in more than one part."""


def stratified_groups(records: DataFrame, group: str = "grp", fractions: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """group, glabel, size, split: whole groups dealt to splits, class by class of their majority label.

    Within a class, groups come by size, largest first, equals by a seeded digest; each goes to the split that is furthest below
    its quota, the first in order among equals. The deal is a fold over a class, so a class is one task; it
    gets a row for each group, not for each record.
    """
    parts = fractions or FRACTIONS
    names, shares = list(parts), list(parts.values())
    sized = majority_label(records, group).withColumn("__k", order_key(seed, F.col(group)))
    kind = records.schema[group].dataType.simpleString()

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "__k", group], ascending=[False, True, True])
        total = float(rows["size"].sum())
        left, out = [s * total for s in shares], []
        for size in rows["size"].tolist():
            at = max(range(len(left)), key=lambda i: (left[i], -i))
            left[at] -= size
            out.append(names[at])
        return rows[[group, "glabel", "size"]].assign(split=out)

    return sized.groupBy("glabel").applyInPandas(deal, f"{group} {kind}, glabel int, size long, split string")


def with_splits(records: DataFrame, group: str = "grp", fractions: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    return records.join(stratified_groups(records, group, fractions, seed).select(group, "split"), group)


def split_quality(parts: DataFrame, fractions: dict[str, float] | None = None, strict: bool = False) -> DataFrame:
    """split, n, requested, realised, classes, ok: a split is bad below half of its request or without a class."""
    wanted = fractions or FRACTIONS
    spark = parts.sparkSession
    asked = spark.createDataFrame([(k, float(v)) for k, v in wanted.items()], "split string, requested double")
    n_classes, total = parts.select(F.count_distinct("label"), F.count(F.lit(1))).first()
    got = parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes"))
    out = asked.join(got, "split", "left").select("split", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "requested", F.round(F.coalesce("n", F.lit(0)) / F.lit(max(total, 1)), 9).alias("realised"), F.coalesce("classes", F.lit(0)).cast("long").alias("classes"))
    out = out.withColumn("ok", (F.col("realised") >= 0.5 * F.col("requested")) & (F.col("classes") == n_classes))
    if strict:
        bad = out.where("NOT ok").first()
        if bad:
            raise SplitError(f"split {bad['split']} holds {bad['n']} records and {bad['classes']} of {n_classes} classes")
    return out


def check_disjoint(train: DataFrame, held_out: DataFrame, keys: tuple[str, ...] = ("path", "grp")) -> None:
    """Raises LeakageError if a record or group of the one is in the other."""
    for k in keys:
        n = train.select(k).distinct().join(held_out.select(k), k, "left_semi").count()
        if n:
            raise LeakageError(f"{n} values of {k} are in both")


class SplitBundle:
    """Parts written by split; the test part's path is kept and not read until unsealed, and the log line is written first."""

    def __init__(self, spark, root: str, log: str):
        self._spark, self._root, self._log, self._open = spark, root, log, False

    @classmethod
    def save(cls, parts: DataFrame, root: str, log: str) -> SplitBundle:
        parts.write.partitionBy("split").parquet(root)
        return cls(parts.sparkSession, root, log)

    def _part(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._root}/split={name}")

    @property
    def train(self) -> DataFrame:
        return self._part("train")

    @property
    def val(self) -> DataFrame:
        return self._part("val")

    @property
    def test(self) -> DataFrame:
        if not self._open:
            raise SealedError("the test part is sealed; call unseal_test(reason, run_id)")
        return self._part("test")

    def test_size(self) -> int:
        return self._part("test").count()

    def unseal_test(self, reason: str, run_id: str) -> DataFrame:
        if not reason:
            raise ValueError("a reason is needed")
        line = {"timestamp": datetime.datetime.now(datetime.timezone.utc).isoformat(), "run_id": run_id, "reason": reason, "n_test": self.test_size()}
        append_line(self._spark, self._log, json.dumps(line))
        self._open = True
        return self.test

    def summary(self) -> DataFrame:
        """Class counts of the open parts; of the test part only its size."""
        open_parts = self.train.withColumn("split", F.lit("train")).unionByName(self.val.withColumn("split", F.lit("val")))
        shown = open_parts.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
        hidden = self._spark.createDataFrame([("test", None, self.test_size())], "split string, label int, n long")
        return shown.unionByName(hidden)


def _bits(held: np.ndarray) -> list[pa.Array]:
    """A row for each trial as words of 64 bits."""
    trials, n = held.shape
    raw = np.zeros((n, -(-trials // 64) * 8), dtype=np.uint8)
    raw[:, : -(-trials // 8)] = np.packbits(held, axis=0, bitorder="little").T
    return [pa.array(np.ascontiguousarray(w)) for w in raw.view("<i8").T]


def _held(batch: pa.RecordBatch, trials: int, prefix: str = "__h") -> np.ndarray:
    """The words of a batch as a row for each trial."""
    words = np.column_stack([batch.column(f"{prefix}{i}").to_numpy() for i in range(-(-trials // 64))])
    raw = np.ascontiguousarray(words.astype("<i8")).view(np.uint8)
    return np.unpackbits(raw, axis=1, bitorder="little")[:, :trials].T


def _gathered(batches, most: int):
    """The rows of batches in larger ones, of so many rows at most: Spark's hold 10,000, unless it is told otherwise."""
    kept, n = [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            batch = whole.slice(at, most)
            if n + batch.num_rows > most:
                yield pa.concat_batches(kept)
                kept, n = [], 0
            kept.append(batch)
            n += batch.num_rows
    if kept:
        yield pa.concat_batches(kept)


def _marked(rows: DataFrame, item: str, trials: int, share: float, width: float, parts: int) -> DataFrame:
    """rows with __id, with a bit for each trial in which their key is beyond the share and the width, and with the trials, the numbers and the
    keys of those that are within the width of it."""
    words = [f"__h{i}" for i in range(-(-trials // 64))]
    least, most = (min(max(int(x * 2**64), 0), 2**64 - 1) for x in (share - width, share + width))
    kept = [f for f in rows.schema.fields]
    schema = T.StructType([*kept, T.StructField("__id", T.LongType()), *[T.StructField(w, T.LongType()) for w in words], *[T.StructField(k, T.ArrayType(t)) for k, t in (("__trial", T.IntegerType()), ("__high", T.LongType()), ("__low", T.LongType()))]])
    names = schema.names
    sign = np.uint64(1 << 63)  # so that signed numbers sort as unsigned ones do

    def mark(batches):
        for batch in _gathered(batches, STEP):
            held, near = np.zeros((trials, batch.num_rows), dtype=bool), []
            for k, high, low in md5_of(list(range(trials)), batch.column(batch.num_columns - 1)):
                held[k] = high > np.uint64(most)
                own = np.flatnonzero((high >= np.uint64(least)) & ~held[k])
                near.append((own, np.full(len(own), k, dtype=np.int32), (high[own] ^ sign).view(np.int64), (low[own] ^ sign).view(np.int64)))
            row, trial, high, low = (np.concatenate([x[i] for x in near]) for i in range(4))
            order = np.argsort(row, kind="stable")
            ends = pa.array(np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (trial, high, low)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_bits(held), *lists], names)

    numbered = rows.repartition(parts).withColumn("__id", F.monotonically_increasing_id()).withColumn("__text", F.coalesce(F.col(item).cast("string"), F.lit("")))
    return numbered.mapInArrow(mark, schema)


def _counted(rows: DataFrame, trials: int, keys: list[str], by: str | None = None) -> DataFrame:
    """trial, keys, held, and with `by`, the prefix of other words, leaked: how often both bits are set."""
    schema = T.StructType([T.StructField("trial", T.LongType()), *rows.select(*keys).schema.fields, T.StructField("held", T.LongType()), T.StructField("leaked", T.LongType())])

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = np.zeros(batch.num_rows, dtype=np.int64)
            for k in keys:
                coded = batch.column(k).dictionary_encode(null_encoding="encode")
                kind = np.unique(kind * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
            _, first, which = np.unique(kind, return_index=True, return_inverse=True)
            held = _held(batch, trials)
            both = held & _held(batch, trials, by) if by else held
            for at, i in enumerate(first.tolist()):
                own = which == at
                columns = [pa.array(np.arange(trials)), *[batch.column(k).take(pa.array([i] * trials)) for k in keys]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x[:, own].sum(axis=1, dtype=np.int64)) for x in (held, both)]], schema.names)

    words = [c for c in rows.columns if c.startswith(("__h", by or "__h")) and c[-1].isdigit()]
    return rows.select(*keys, *words).mapInArrow(count, schema).groupBy("trial", *keys).agg(F.sum("held").alias("held"), F.sum("leaked").alias("leaked"))


def held_out(rows: DataFrame, item: str, columns: list[str], trials: int, test_fraction: float, whole: Callable[[float], int] = int) -> DataFrame:
    """item, columns, and a bit for each trial, in words __h0 and on: whether the row is held out in the trial's random split.

    A row is held out in a trial when its place in the trial's permutation is beyond whole((1 - f) n). Places are those of digests, which spread
    evenly, so the row at that place has a digest near 1 - f: each digest is made once, and only rows near that are put in order, some 6 sqrt(n)
    in a trial. Whether the place is among them is counted, and if it isn't, more rows are. Rows of one item are told apart by a number.
    """
    n = rows.count()
    cut_at = whole((1 - test_fraction) * n)
    share = cut_at / max(n, 1)
    width = 8 * math.sqrt(max(share * (1 - share), 1 / max(n, 1)) / max(n, 1))
    names = list(dict.fromkeys([item, *columns]))
    parts = min(n * trials // DIGESTS + 1, PARTS)  # narrow files come in few parts
    while True:
        marked = cut(_marked(rows.select(*names), item, trials, share, width, parts), "trials")
        beyond = _counted(marked, trials, []).select(F.col("trial").cast("int").alias("__t"), F.col("held").alias("beyond"))
        near = marked.where(F.size("__trial") > 0).select("__id", F.explode(F.arrays_zip("__trial", "__high", "__low")).alias("x")).select("__id", "x.*")
        placed = near.withColumn("rn", F.row_number().over(W.partitionBy("__trial").orderBy(F.desc("__high"), F.desc("__low"), F.desc("__id"))))
        # The place is counted from the end: the first row that isn't held out, after n - cut that are.
        last = placed.join(F.broadcast(beyond), F.col("__trial") == F.col("__t")).where(F.col("rn") + F.col("beyond") == n - cut_at + 1)
        found = {r[0]: r[1:] for r in last.select("__trial", "__high", "__low", "__id").collect()}
        if n == 0 or len(found) == trials or width >= 1:
            break
        drop(marked)
        width *= 8

    words = [f"__h{i}" for i in range(-(-trials // 64))]

    def settle(batches):
        lowest = (-(2**63), -(2**63), -1)
        high, low, number = (np.array([found.get(k, lowest)[i] for k in range(trials)], dtype=np.int64) for i in range(3))
        for batch in batches:
            held, lists = _held(batch, trials).copy(), batch.column("__trial")
            t, h, w = (batch.column(k).flatten().to_numpy() for k in ("__trial", "__high", "__low"))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            own = batch.column("__id").to_numpy()[row]
            over = (h > high[t]) | (h == high[t]) & ((w > low[t]) | (w == low[t]) & (own > number[t]))
            held[t[over], row[over]] = 1
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], *_bits(held)], [*names, *words])

    kinds = T.StructType([*marked.select(*names).schema.fields, *[T.StructField(w, T.LongType()) for w in words]])
    return marked.mapInArrow(settle, kinds)


def with_leaks(held: DataFrame, group: str) -> DataFrame:
    """held_out's rows with words __l0 and on: the trials in which a row of their group is in training. Rows without a group are one group."""
    words = [c for c in held.columns if c.startswith("__h")]
    train = held.groupBy(F.col(group).alias("__g")).agg(*[F.bit_or(F.bitwise_not(w)).alias(f"__l{w[3:]}") for w in words])
    return held.join(train, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def leakage_counts(held: DataFrame, group: str, trials: int, extra: list[str] | None = None) -> DataFrame:
    """trial, extra, held, leaked: of each trial's held-out rows their number, and that of those whose group is in training. held: of held_out."""
    return _counted(with_leaks(held, group), trials, extra or [], "__l").where("held > 0")


def leakage_trials(rows: DataFrame, item: str, group: str, trials: int, test_fraction: float, extra: list[str] | None = None) -> DataFrame:
    """trial, item, group, extra, leaked: the held-out rows of each random split, and whether their group is in training."""
    columns = list(dict.fromkeys([item, group, *(extra or [])]))
    both = with_leaks(held_out(rows, item, columns, trials, test_fraction), group)
    words = range(-(-trials // 64))
    bits = lambda name: F.array(*[F.col(f"{name}{i}") for i in words])
    t = both.select(*columns, bits("__h").alias("__h"), bits("__l").alias("__l"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))).alias("trial"))
    at = lambda name: F.getbit(F.get(name, F.floor(F.col("trial") / 64).cast("int")), (F.col("trial") % 64).cast("int")) == 1
    return t.where(at("__h")).select("trial", *columns, at("__l").alias("leaked"))


def expected_leakage(sizes: DataFrame, f: float, size: str = "s") -> Column:
    """The closed form: the mean over items of 1 - (1 - f)^(k - 1), k the size of the item's group."""
    return F.sum(F.col(size) * (1 - F.pow(F.lit(1 - f), F.col(size) - 1))) / F.sum(size)
