"""Sharding by proportional stratified interleaving.

Rows of a source are put in a seeded random order; each gets the fractional rank (r - 1/2) / n of its n rows. All
rows sorted by that rank are cut into shards of equal counts, so every shard holds the sources in the mixture's
proportions, and so does every prefix of a shard.

Edge cases: a null text has no bytes and checksum 0; a null source is a source of its own, sorted last; equal rows
are placed one after the other; null doc_ids take part; a very long text counts as one row; other columns are ignored; an empty table gives no
rows; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import bucketed_rank, hex_prefix, seeded, source_key
from corpuslab.plans.scratch import cut

SEED = 977
SHARDS = 40
#: Ranges of lots within a source, and of fractional ranks overall. Fractional ranks are spread evenly whatever the
#: sizes of the sources, so no range is hot.
PARTS = 1024


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: for each row of docs (doc_id, source, text)."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id", source_key(F.col("source")).alias("skey"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    rows = rows.withColumn("lot", seeded(seed, F.col("doc_id"), F.col("text_crc32")))
    rows = cut(rows.withColumn("part", (hex_prefix(F.col("lot"), 4) % PARTS).cast("int")), "shard_rows")
    n = rows.count()
    order = [F.col("lot"), F.col("doc_id"), F.col("text_crc32")]
    ranked = bucketed_rank(rows, ["skey"], "part", order, "r")
    sizes = rows.groupBy("skey").agg(F.count(F.lit(1)).alias("n_source"))
    placed = ranked.join(sizes, "skey").withColumn("f", (2.0 * F.col("r") - 1.0) / (2.0 * F.col("n_source")))
    placed = placed.withColumn("range", F.floor(F.col("f") * PARTS).cast("int"))
    placed = bucketed_rank(placed, [], "range", [F.col("f"), F.col("skey"), F.col("r")], "g")
    at = F.col("g") - 1
    shard = F.floor(at * shards / n) if n == 0 else F.expr(f"((g - 1) * {shards}L) div {n}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.lit(0) if n == 0 else F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "size", "text_crc32", "shard", (at - first).cast("long").alias("slot"))
