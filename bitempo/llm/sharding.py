"""Sharding by proportional stratified interleaving (operator 6), in DataFrame operations only.

Rows are ranked in a seeded shuffle within their source; rank over the source's size is the row's place
on a common line from 0 to 1, on which every source is spread evenly; a seeded phase of each source keeps
sources of one size from meeting at the same places. The line is cut into shards of equal counts, so each shard
holds every source in the proportion of the whole.

No rank needs one task for a whole source: a rank is the row's rank within a hash bucket of its source
plus the sizes of the buckets before, and the same again for places on the common line.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, table

SHARDS, SEED = 40, 20_240_601
#: Rows of a bucket that are ranked together, and the most buckets of a source (or of the line).
BUCKET_ROWS, MOST_BITS = 4096, 16


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and source of every row.

    The law is ``rows``: shard sizes differ by one at most. A null text has 0 bytes and the checksum of an
    empty text; rows without a source form a source of their own; a null doc_id is ranked like any other.
    Repeated rows get slots of their own. With fewer rows than shards some shards stay empty; an empty
    table gives no rows. Columns of ``docs`` beside doc_id, text and source are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("src"),
            F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(text)).alias("h"),  # rows of one doc_id spread by their texts
        ),
        "base",
    )
    rows = base.count()
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, rows) / bucket_rows))))
    base = base.withColumn("hb", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    before = Window.partitionBy("src").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("src")
    counts = base.groupBy("src", "hb").agg(F.count("*").alias("n"))
    counts = counts.select("src", "hb", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(own).alias("of"))
    inside = Window.partitionBy("src", "hb").orderBy("h", "doc_id", "text_crc32", "size")
    phase = (F.pmod(F.xxhash64(F.lit(seed), F.lit("phase"), F.col("src")), F.lit(1 << 20)) + 0.5) / (1 << 20)
    place = (F.col("ahead") + F.row_number().over(inside) - phase) / F.col("of")
    placed = keep(base.join(counts, ["src", "hb"]).select("doc_id", "size", "text_crc32", "src", "h", place.alias("place")), "placed")
    placed = placed.withColumn("fb", F.floor(F.col("place") * (1 << bits)))
    line = placed.groupBy("fb").agg(F.count("*").alias("n"))
    line = line.select("fb", F.coalesce(F.sum("n").over(Window.orderBy("fb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("fb").orderBy("place", "src", "h", "doc_id", "text_crc32", "size")
    at = placed.join(line, "fb").withColumn("at", F.col("ahead") + F.row_number().over(order) - 1)
    shard = F.expr(f"at * {shards} div {max(1, rows)}")
    at = at.withColumn("shard", shard.cast("int"))
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("at") - F.expr(f"(shard * {max(1, rows)}L + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.when(F.col("src") != "-", F.expr("substring(src, 2)")).alias("source"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))
