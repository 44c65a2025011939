"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; the fractional rank
(rank - 1/2) / size of the source interleaves the sources in proportion, and cutting that order into
runs whose lengths differ by one at most makes every shard match the mixture (law: rows).

The hash is over doc_id, checksum and size, so that rows without a doc_id, or with one in common, are shuffled too.

Defined cases: a null text has no bytes (size 16, checksum 0); a very long text is only measured where it is read; a null
source is a source of its own; repeated rows and repeated doc_ids are separate rows, ordered among themselves by their text's
checksum and size (rows that tie in all three are interchangeable); fewer rows than shards leave shards
empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bucket_count, materialize, ranked

OVERHEAD_BYTES = 16


def interleave_shards(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, position, source for every row.

    Two narrow shuffles (the texts stay where they are read); no group, shard or source is ever
    in one task: see common.ranked."""
    total = docs.count()
    buckets = bucket_count(total)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stratum"),
        (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = rows.withColumn("mix", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size")))
    # A bucket is a range of the hash, so that buckets in order are rows in order of the hash.
    bucket = F.floor(F.conv(F.substring("mix", 1, 8), 16, 10).cast("long") * buckets / float(1 << 32)).cast("long")
    tie = [F.col("mix"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    within = ranked(rows, ["stratum"], bucket, tie)
    # Both are whole numbers below 2^53 for any table that exists, so the quotient is the same everywhere.
    within = within.withColumn("fraction", (2 * F.col("rank_in_group") + 1) / (2 * F.col("n_in_group")))
    within = materialize(within.drop("n_in_group", "rank_in_group"), "shards")
    place = F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("long")
    rows = within.withColumn("_bucket", place)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    stratum_mix = F.md5(F.concat(F.lit(f"{seed}:"), "stratum"))
    order = Window.partitionBy("_bucket").orderBy("fraction", stratum_mix, "stratum", *tie)
    rows = rows.join(counts, "_bucket").withColumn("position", F.col("_before") + F.row_number().over(order) - 1)
    shard = F.expr(f"(position * {shards}L) div {max(1, total)}L")
    first = F.expr(f"(shard * {max(1, total)}L + {shards - 1}L) div {shards}L")
    return rows.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("position") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "position", "source",
    )
