"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Every shard draws a number for a key from md5 of the key and the shard; the key goes to the shard with the smallest
-ln(u)/weight. A new shard only takes keys for which its own draw is the smallest, so no row moves between old shards,
and a shard gets keys in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table

SHARDS = 40


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) from the key's text and the shard's number, of 52 bits."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def best_shard(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, shard) of the winning shard among first, first + 1, ..."""
    share = F.array(*[F.lit(float(w)) for w in weights])
    text = F.coalesce(key.cast("string"), F.lit(""))
    numbers = F.sequence(F.lit(first), F.lit(first + len(weights) - 1))
    none = F.struct(F.lit(float("inf")).alias("score"), F.lit(first + len(weights)).alias("shard"))
    # One draw at a time, so that a row never holds an array of them.
    return F.aggregate(numbers, none, lambda best, s: F.least(best, F.struct((-F.log(draw(text, s)) / F.element_at(share, s - first + 1)).alias("score"), s.alias("shard"))))


def shard_rows(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0, parts: int = 2) -> DataFrame:
    """Adds shard, slot and grown_shard.

    shard is in 0 .. len(weights) - 1, grown_shard what it would be with one more shard of weight grown_weight, slot a
    number in the shard, gapless from 0, by the first `parts` hexadecimal digits of md5(key) and then the key. Slots are
    counted within 16 ** parts pieces of each shard and moved up by the sizes of the pieces before, so no task sees a
    whole shard. Rows with the same key (a hot key too) go to the same shard and get slots in any order; a null key counts
    as an empty one; an empty table gives no rows. Other columns are kept; those named shard, slot or grown_shard give way.
    Weights are finite and above 0; others raise.
    """
    if not weights or not all(0 < w < float("inf") for w in (*weights, grown_weight)):
        raise ValueError("weights must be finite and above 0, and there must be one")
    df = df.drop("shard", "slot", "grown_shard")
    best, part, first, count = fresh(df, "_best", "_part", "_first", "_n")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    grown = F.struct((-F.log(draw(text, F.lit(len(weights)))) / F.lit(float(grown_weight))).alias("score"), F.lit(len(weights)).alias("shard"))
    won = F.col(best)
    placed = df.withColumn(best, best_shard(F.col(key), weights)).withColumns(
        {"shard": won["shard"], "grown_shard": F.when(grown["score"] < won["score"], F.lit(len(weights))).otherwise(won["shard"]), part: F.substring(F.md5(text), 1, parts)}
    )
    pieces = placed.groupBy("shard", part).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = pieces.select("shard", part, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(first))
    ranked = placed.drop(best).withColumn(count, F.row_number().over(Window.partitionBy("shard", part).orderBy(key)))
    return ranked.join(firsts, ["shard", part]).withColumn("slot", F.col(first) + F.col(count) - 1).drop(part, first, count)


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law `key`; a null text has the size 16 and the checksum 0."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    )
    return shard_rows(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


#: md5 draws as above; crc32 by a table that is made from its polynomial, a byte at a time.
SQL = """
WITH RECURSIVE bits(b, step, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, step + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM bits WHERE step < 8),
lookup AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE step = 8),
raw AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT doc_id, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) AS crc FROM raw, lookup),
drawn AS (
  SELECT doc_id, s, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496) AS score
  FROM (SELECT DISTINCT doc_id FROM documents), (SELECT range AS s FROM range(41))),
placed AS (
  SELECT doc_id, arg_min(s, score) FILTER (s < 40) AS shard, arg_min(s, score) AS grown_shard FROM drawn GROUP BY doc_id)
SELECT c.doc_id, (n + 16)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(c.doc_id::VARCHAR), 1, 2), c.doc_id) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM crc c JOIN placed p ON c.doc_id IS NOT DISTINCT FROM p.doc_id
"""
