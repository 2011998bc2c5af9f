"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash of their id and ranked; rank r of n
becomes the fraction (2r + 1) / 2n.  Sorted by that fraction the sources interleave in
proportion, and the sorted order is cut into shards whose row counts differ by one at
most (law ``rows``), so that every shard has the mixture of the whole.

Both ranks are exact and distributed: rows are dealt to buckets by the leading bits of
a uniform key (the hash, then the fraction), counted, and ranked inside their bucket
behind the counts before it.  A source with a third of all rows spreads over all
buckets, and no text is shuffled.

Defined results: null text has size 8 and the crc32 of nothing; a null source is a
stratum of its own; rows with equal ids stand in the order of their text's crc32 and
size, so equal rows are interchangeable; copies are ordinary rows: shards of equal counts and groups kept
together exclude each other where a group is larger than a shard, so equal texts are dealt like any other
rows, and columns named like a result are replaced; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm._common import materialize, table

SHARDS, SEED = 24, "mix-1"
#: Rows of a bucket, about; there are at least MIN_BUCKETS and at most MAX_BUCKETS buckets.
BUCKET_ROWS, MIN_BUCKETS, MAX_BUCKETS = 100_000, 64, 16_384


def _offsets(rows: DataFrame, within: list[str], bucket: str) -> DataFrame:
    """For each bucket the number of rows in the buckets before it, and the number in all."""
    counts = rows.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("in_bucket"))
    order = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *within, bucket, F.coalesce(F.sum("in_bucket").over(order), F.lit(0)).alias("before"), F.sum("in_bucket").over(Window.partitionBy(*within)).alias("in_all")
    )


def shard(docs: DataFrame, shards: int = SHARDS, *, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, text_crc32, law, shard, slot, grown_shard of every row."""
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("stratum"),
        (F.octet_length(binary) + 8).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
        _hash(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("h"),
    )
    slim = materialize(slim, "shard-rows")
    total = slim.count()
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, total // BUCKET_ROWS))
    rows = slim.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets, 32))
    rows = rows.join(_offsets(rows, ["stratum"], "bucket"), ["stratum", "bucket"])
    within = Window.partitionBy("stratum", "bucket").orderBy("h", "id", "text_crc32", "size")
    rank = F.col("before") + F.row_number().over(within) - 1
    rows = rows.withColumn("fraction", (2 * rank + 1) / (2 * F.col("in_all"))).drop("bucket", "before", "in_all")
    # read twice below, for the counts and for the ranks
    rows = materialize(rows.withColumn("part", F.least(F.lit(buckets - 1), F.floor(F.col("fraction") * buckets))), "shard-fractions")
    parts = _offsets(rows, [], "part").drop("in_all")
    ordered = Window.partitionBy("part").orderBy("fraction", _hash(F.lit(f"{seed}:"), F.col("stratum")), "stratum", "h", "id", "text_crc32", "size")
    place = rows.join(parts, "part").withColumn("place", F.col("before") + F.row_number().over(ordered) - 1)
    chosen = f"(place * {shards} div {max(1, total)})"
    return place.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.expr(chosen).cast("int").alias("shard"),
        # the first place of shard k is ceil(k * total / shards)
        (F.col("place") - F.expr(f"({chosen} * {total}L + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat(*parts).cast("binary"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents into 24 shards under the law ``rows``."""
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: crc32 by its table of 256 remainders, itself made by eight shifts of each byte.
ORACLE_SQL = f"""
WITH RECURSIVE shifts(byte, step, crc) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END FROM shifts WHERE step < 8
), remainders AS (
  SELECT list(crc ORDER BY byte) AS t FROM shifts WHERE step = 8
), d AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS no_source, coalesce(text, '') AS text,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
         md5('{SEED}:' || coalesce('s' || source, 'n')) AS hs
  FROM documents
), sized AS (
  SELECT d.*, CAST(strlen(text) + 8 AS BIGINT) AS size,
         CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM d, remainders
), ranked AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY no_source, source ORDER BY h, doc_id, text_crc32, size) - 1) + 1)
            / CAST(2 * count(*) OVER (PARTITION BY no_source, source) AS DOUBLE) AS fraction
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, hs, no_source, source, h, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {SHARDS} // total AS INTEGER) AS shard,
       CAST(place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
