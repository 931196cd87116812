"""Registered queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import ann, bpe, html_extract, licenses, mixing, quality_gam, quality_rules, sharding, simhash, token_file
from corpuslab.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer, ["doc_id"]), tokenizer)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The tables have no paths: a document's stands below its source and language.
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return licenses.scan(docs, path)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, docs, table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.classify(docs, docs, table(spark, sf_dir, "labels"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_token_ids, op3_mixing, op4_sharding, op5_licenses, op6_quality_rules, op7_quality_classifier, op8_nearest, op9_simhash, op10_html)}

#: Operators 1, 2, 4, 6, 7, 9 and 10 need byte-pair merges, checksums, fitted models, XXH64 or an HTML parser, which SQL lacks, and 5 a
#: tokeniser of its own: tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op3_mixing": """
WITH d AS (SELECT doc_id, text, CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS skey, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
l AS (SELECT *, md5(concat_ws('|', '20240', coalesce(doc_id::VARCHAR, '~'), size, coalesce(md5(text), '~'))) AS lot FROM d),
s AS (SELECT skey, sum(size)::BIGINT AS n, ((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY skey),
o AS (SELECT *, 3.0::DOUBLE * n AS cap, sum(n) OVER ()::DOUBLE AS total, sum(w) OVER () AS all_w, row_number() OVER (ORDER BY 3.0 * n / w, skey) AS k FROM s),
c AS (SELECT *, (total - coalesce(sum(cap) OVER p, 0)) / (all_w - coalesce(sum(w) OVER p, 0)) AS level FROM o WINDOW p AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT skey, n, round(least(cap, w * (SELECT level FROM c WHERE level <= cap / w ORDER BY k LIMIT 1)), 6) AS target FROM c),
g AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole, target - CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END * n AS rest FROM t),
r AS (SELECT l.*, g.n, g.target, g.whole, g.rest, sum(l.size) OVER (PARTITION BY l.skey ORDER BY l.lot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - l.size / 2 <= g.rest AND g.rest > 0 AS fits FROM l JOIN g ON g.skey = l.skey)
SELECT doc_id, size, n AS source_size, target, (size * (whole + CASE WHEN fits THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
    "op8_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
""",
}
