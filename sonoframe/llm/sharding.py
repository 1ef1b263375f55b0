"""Rendezvous sharding: each record goes to the shard with the best weighted score of (key, shard).

A score depends on the key and on that shard alone, so a further shard takes records only into itself, and one that goes
gives up only its own. With u uniform in (0, 1) from a digest of key and shard, the shard with the least -ln(u) / weight
wins; its share is its weight's (a race of exponentials).

Slots number the records of a shard without gaps. A window over a whole shard would be one task with an eighth of all
rows, so records are dealt into blocks by a second digest; each block is numbered alone and shifted by the rows in the
blocks before it.

Defined cases: a null text has size 1 and the checksum of no bytes; a null key counts as ''; repeated rows go to the same
shard and get slots of their own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import materialize, table

#: Rows that one numbering task takes at the mean.
BLOCK_ROWS = 20_000


def _uniform48(text: Column) -> Column:
    """The first 48 bits of the MD5 digest, as a long: digests that other engines can compute too."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) of a key under weights, one for each shard; a weight of 0 closes a shard."""
    scores = [
        F.struct((-F.ln((_uniform48(F.concat(key, F.lit(f":{k}"))) + F.lit(0.5)) / F.lit(float(1 << 48))) / F.lit(float(w))).alias("cost"), F.lit(k).alias("shard"))
        for k, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*scores))["shard"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] = (1.0,) * 9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) for (doc_id, text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    base = materialize(
        docs.select("doc_id", "text").select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            rendezvous(key, weights).alias("shard"),
            rendezvous(key, grown).alias("grown_shard"),
            _uniform48(F.concat(key, F.lit(":slot"))).alias("v"),
        ),
        "shards",
    )
    blocks = max(1, -(-base.count() // (block_rows * len(weights))))
    base = base.withColumn("block", F.floor(F.col("v") / F.lit(float(1 << 48)) * blocks).cast("long"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = base.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = base.withColumn("r", F.row_number().over(Window.partitionBy("shard", "block").orderBy("v", "doc_id", "text_crc32", "size")) - 1)
    return numbered.join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("r")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def op5_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _argmin_sql(n: int) -> str:
    costs = ", ".join(f"-ln((('0x' || substr(md5(k || ':{i}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0)" for i in range(n))
    return f"(list_position([{costs}], list_min([{costs}])) - 1)::INTEGER"


#: DuckDB has no CRC-32: the table of the polynomial and one fold over the bytes stand in.
ORACLE_SQL = f"""
WITH t AS (
  SELECT list((
    SELECT list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
  ) ORDER BY n) AS crc FROM range(256) AS r(n)
), d AS (
  SELECT doc_id, text, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS body FROM documents
), h AS (
  SELECT doc_id, k, strlen(body)::BIGINT + 1 AS size, hex(encode(body)) AS hx FROM d
), c AS (
  SELECT h.doc_id, k, size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, [('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT FOR i IN range(size - 1)]),
      lambda a, b: xor(t.crc[(xor(a, b) & 255) + 1], a >> 8))) AS text_crc32
  FROM h, t
), s AS (
  SELECT doc_id, size, text_crc32, {_argmin_sql(8)} AS shard, {_argmin_sql(9)} AS grown_shard,
    ('0x' || substr(md5(k || ':slot'), 1, 12))::BIGINT AS v FROM c
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY v, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM s
"""
