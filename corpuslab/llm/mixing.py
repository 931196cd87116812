"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source gets a target in proportion to its weight, but never more than `epochs` times its own size;
the excess goes to the other sources by weight until none is above. A source's target is met by whole
repetitions of all its documents and one fractional repetition, a seeded sample whose size comes
within half a document of what is left.

Lots are digests of doc_id, size and text. Rows that are equal in these draw one lot; where the sample ends among them, as many of them
as are left are taken, no matter which.

Edge cases: a null text has size 0; a null source is a source of its own, sorted last; documents of size 0
take nothing; very long texts count whole; an empty table gives an empty result; other columns
are ignored by `mix` and kept by `repeat_documents`. Null doc_ids take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.llm.common import WORD, bucketed_rank, seeded, source_key
from corpuslab.plans.scratch import cut

SEED = 20240
EPOCHS = 3
WEIGHTS = (1, 2, 3)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which sum(least(weight * level, cap)) is the total. Only sums reach the driver."""
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("cap")
        full, free = sources.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(~over, F.col("weight")).otherwise(0.0))
        ).first()
        if not free:
            return float("inf") if full else level
        found = (total - full) / free
        if found <= level:
            return level
        level = found


def targets(sized: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """skey, source_size, target: one row for each source. sized: skey, size."""
    totals = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = cut(
        totals.withColumn("weight", weight).withColumn("cap", F.lit(float(epochs)) * F.col("source_size")), "sources"
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, float(total))
    return sources.select("skey", "source_size", F.round(F.least(F.col("cap"), F.col("weight") * F.lit(level)), 6).alias("target"))


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, skey, size, lot: the narrow table that the draw is made from."""
    return docs.select("doc_id", source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size"), lots(seed, docs).alias("lot"))


def lots(seed: int, docs: DataFrame):
    return seeded(seed, docs["doc_id"], word_count(docs["text"]), F.md5(docs["text"]))


def plan(sized: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """skey, source_size, target, whole, border, more: a source takes every document `whole` times, and once more those whose
    lot is less than `border`, and `more` of those whose lot is `border`. A row for each source.

    Sums over 256 ranges of lots, then over 256 parts of the range in which the sample ends, leave one of 65,536
    parts of a source to be ordered row by row.
    """
    goal = targets(sized, weights, epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    def crossing(frame: DataFrame, limits: DataFrame, digits: int) -> DataFrame:
        """skey, the first range of lots (by its leading digits) whose running sum passes the rest, the sum before it."""
        sums = frame.groupBy("skey", F.substring("lot", 1, digits).alias("range")).agg(F.sum("size").alias("s"))
        so_far = F.sum("s").over(W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
        passed = sums.withColumn("before", F.coalesce(so_far, F.lit(0))).join(limits, "skey").where(F.col("before") + F.col("s") > F.col("rest"))
        return passed.groupBy("skey").agg(F.min(F.struct("range", (F.col("rest") - F.col("before")).alias("rest"))).alias("x")).select("skey", "x.*")

    first = cut(crossing(sized, goal.select("skey", "rest"), 2), "mix1")
    inside = sized.join(first.select("skey", "range"), "skey").where(F.col("lot").startswith(F.col("range"))).drop("range")
    second = cut(crossing(inside, first.select("skey", "rest"), 4), "mix2")
    edge = sized.join(second, "skey").where(F.col("lot").startswith(F.col("range")))
    # Equal lots are of equal sizes. A lot's rows are counted before lots are put in order.
    edge = edge.groupBy("skey", "lot").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    so_far = F.coalesce(F.sum(F.col("size") * F.col("n")).over(W.partitionBy("skey").orderBy("lot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fit = F.when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor((F.col("rest") - so_far) / F.col("size") + 0.5)))
    taken = edge.join(second.select("skey", "rest"), "skey").withColumn("fit", fit).where("fit > 0").groupBy("skey").agg(F.max(F.struct("lot", "fit")).alias("last"))
    # A lot is longer than its leading digits and sorts after them; "g" sorts after all lots.
    found = second.select("skey", "range").join(taken, "skey", "left").select("skey", F.coalesce("last.lot", "range").alias("found"), F.coalesce("last.fit", F.lit(0)).alias("fit"))
    border = F.when(F.col("rest") <= 0, "").otherwise(F.coalesce("found", F.lit("g")))
    columns = ("skey", "source_size", "target", F.col("whole").cast("long").alias("whole"), border.alias("border"), F.coalesce("fit", F.lit(0)).alias("more"))
    return cut(goal.join(found, "skey", "left").select(*columns), "mix")


def repeated(rows: DataFrame) -> DataFrame:
    """rows (__skey, __lot, __goal.whole, .border, .more) with __times, how often each is taken. Few rows stand at their source's border; they are
    numbered in parts, since they may be copies of one row."""
    whole, lot, border = F.col("__goal.whole"), F.col("__lot"), F.col("__goal.border")
    apart = rows.where(lot != border).withColumn("__times", whole + F.when(lot < border, 1).otherwise(0))
    at = rows.where(lot == border).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.xxhash64("__id") % 256)
    at = bucketed_rank(cut(at, "mix_border"), ["__skey"], "__part", [F.col("__id")], "__rank")
    at = at.withColumn("__times", whole + F.when(F.col("__rank") <= F.col("__goal.more"), 1).otherwise(0))
    return apart.unionByName(at.drop("__id", "__part", "__rank"))


def keyed(goal: DataFrame) -> DataFrame:
    return goal.select(F.col("skey").alias("__skey"), F.struct("whole", "border", "more", "source_size", "target").alias("__goal"))


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats: for each row of docs (doc_id, source, text)."""
    sized = cut(sizes(docs, seed).hint("rebalance"), "sizes")
    rows = sized.withColumnsRenamed({"skey": "__skey", "lot": "__lot"}).join(keyed(plan(sized, weights, epochs)), "__skey")
    drawn = repeated(rows).select("doc_id", "size", "__goal.source_size", "__goal.target", F.col("__times").cast("long").alias("repeats"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def repeat_documents(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, with the columns of docs. Only the plan, a row
    for each source, is joined to the texts."""
    goal = keyed(plan(cut(sizes(docs, seed).hint("rebalance"), "sizes"), weights, epochs))
    rows = docs.withColumns({"__skey": source_key(F.col("source")), "__lot": lots(seed, docs)}).join(goal, "__skey")
    taken = repeated(rows).where(F.col("__times") > 0)
    return taken.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)
