"""Records of a labelled corpus: validation, filters, histograms, set operations, ranks.

A record is (ord, path, label, source, grp, meta): `ord` carries the order, which has a meaning here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpuslab.plans.scratch import cut

SOURCES = ("real", "synth_closed", "synth_open", "synth_edit")
LABELS = ("mild", "moderate", "severe", "very_severe")
RECORD = T.StructType([
    T.StructField("path", T.StringType(), False), T.StructField("label", T.IntegerType(), False), T.StructField("source", T.StringType(), False),
    T.StructField("grp", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])


class RecordError(ValueError):
    """A record with a label or a source that does not exist."""


def label_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(LABELS)], "label int, name string")


def violations(records: DataFrame) -> DataFrame:
    """Records that break a rule, with the rule."""
    rule = F.when(F.col("label").isNull() | ~F.col("label").between(0, len(LABELS) - 1), "label out of range").when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "unknown source")
    return records.withColumn("rule", rule).where(F.col("rule").isNotNull())


def validated(records: DataFrame) -> DataFrame:
    """The records, with empty groups set to their paths; raises on the first action if one breaks a rule."""
    ok = F.coalesce(F.col("label").between(0, len(LABELS) - 1) & F.col("source").isin(*SOURCES), F.lit(False))
    return records.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("bad record "), F.col("path"))).cast("boolean"))).withColumn("grp", F.coalesce(F.nullif("grp", F.lit("")), "path"))


def matching(records: DataFrame, **fields) -> DataFrame:
    """Records whose fields equal all these values; None matches null."""
    tests = [F.col(k).eqNullSafe(F.lit(v)) for k, v in fields.items()]
    return records.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def real(records: DataFrame) -> DataFrame:
    return records.where(F.col("source") == "real")


def synthetic(records: DataFrame) -> DataFrame:
    return records.where(F.col("source") != "real")


def by_source_label(records: DataFrame) -> DataFrame:
    """Label 0 for real records, 1 for synthetic ones."""
    return records.withColumn("label", F.when(F.col("source") == "real", 0).otherwise(1).cast("int"))


def class_counts(records: DataFrame) -> DataFrame:
    """label, name, n: classes without records count 0."""
    n = records.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return label_dimension(records.sparkSession).join(n, "label", "left").select("label", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def source_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def concat(*corpora: DataFrame) -> DataFrame:
    """All records, those of the first corpus first: (part, ord) is the order."""
    return reduce(lambda a, b: a.unionByName(b), [c.withColumn("part", F.lit(i)) for i, c in enumerate(corpora)])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by the order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def first_appearance_ids(df: DataFrame, group: str, order: str, prefix: str, out: str = "gid") -> DataFrame:
    """Canonical ids of groups by first appearance. Groups are numbered in a table of their own, a row for each, and joined back."""
    first = numbered(df.groupBy(group).agg(F.min(order).alias("__first")), [F.col("__first")], "__place", 0)
    number = F.col("__place").cast("string")
    ids = first.select(group, F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0"))).alias(out))
    return df.join(ids, group)


def group_report(groups: DataFrame, group: str, warn_at: float = 0.05) -> DataFrame:
    """One row: items, groups, groups of several items, items in those, the largest group, its share, and whether it is suspiciously large."""
    sizes = groups.groupBy(group).agg(F.count(F.lit(1)).alias("s"))
    total = F.sum("s")
    share = F.max("s") / F.when(total > 0, total)
    return sizes.agg(
        F.coalesce(total, F.lit(0)).cast("long").alias("n_items"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("s") > 1).alias("n_multi"),
        F.coalesce(F.sum(F.when(F.col("s") > 1, F.col("s"))), F.lit(0)).cast("long").alias("items_in_multi"), F.coalesce(F.max("s"), F.lit(0)).cast("long").alias("largest"),
        F.round(share, 9).alias("largest_share"), F.coalesce(share > warn_at, F.lit(False)).alias("over_clustered"),
    )


def majority_label(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """group, glabel, size: the most frequent label, the lowest among equals."""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(group).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("glabel"), F.sum("n").cast("long").alias("size"))


def class_weights(records: DataFrame) -> DataFrame:
    """label, weight: inverse frequency over the classes present; 0 for a class without records."""
    counts = class_counts(records)
    totals = counts.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("present"))
    return counts.crossJoin(F.broadcast(totals)).select("label", F.when(F.col("n") > 0, F.col("total") / (F.col("present") * F.col("n"))).otherwise(0.0).alias("weight"))


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """by, entropy, effective: Shannon's entropy of the shares in nats, and its exponential."""
    total = counts.groupBy(*by).agg(F.sum(n).alias("__t"))
    joined = counts.where(F.col(n) > 0).join(total, by) if by else counts.where(F.col(n) > 0).crossJoin(F.broadcast(total))
    p = F.col(n) / F.col("__t")
    h = joined.groupBy(*by).agg(F.sum(-p * F.log(p)).alias("entropy"))
    return h.withColumn("effective", F.exp("entropy"))


def average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1, the mean rank among equals."""
    w, tied = W.partitionBy(*by).orderBy(value), W.partitionBy(*by, value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(tied) - 1) / 2)


def ordinal_rank(df: DataFrame, by: list[str], value: str, order: str, out: str) -> DataFrame:
    """Ranks from 0, equals in their order."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(value, order)) - 1)


def assert_disjoint(corpora: DataFrame, part: str = "split", keys: tuple[str, ...] = ("path", "grp")) -> DataFrame:
    """key, value, n_parts: what occurs in more than one part. Empty means disjoint."""
    out = []
    for k in keys:
        shared = corpora.groupBy(F.col(k).cast("string").alias("value")).agg(F.count_distinct(part).alias("n_parts")).where("n_parts > 1")
        out.append(shared.select(F.lit(k).alias("key"), "value", "n_parts"))
    return reduce(lambda a, b: a.unionByName(b), out)


def numbered(df: DataFrame, order: list[Column], out: str = "place", start: int = 1) -> DataFrame:
    """All rows with their place by the order, from `start`. Rows are dealt to ranges and numbered within them, after the counts of the
    ranges before, a row for each range: no task holds all rows. The order must tell rows apart."""
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    before = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = (F.col("__before") + F.row_number().over(W.partitionBy("__part").orderBy(*order)) + (start - 1)).cast("long")
    return dealt.join(F.broadcast(before), "__part").withColumn(out, place).drop("__part", "__before")


def buckets(df: DataFrame, n: int, label: str = "label") -> DataFrame:
    """The rows of each class from 0 to n - 1; a class without rows gives one row of nulls beside its label."""
    classes = df.sparkSession.range(n).select(F.col("id").cast("int").alias("__class"))
    # A row for each class.
    found = F.broadcast(classes.join(df.select(label).distinct(), F.col("__class") == F.col(label), "left_anti"))
    empty = found.select(*[F.col("__class").cast(f.dataType).alias(f.name) if f.name == label else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.where(F.col(label).between(0, n - 1)).unionByName(empty)
