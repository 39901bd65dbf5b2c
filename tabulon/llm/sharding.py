"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; row ``k`` of
``n`` gets the fractional rank ``(k - 1/2) / n``. Sorted by it, the sources are
interleaved in proportion, and any run of consecutive rows holds the mixture.
Cutting that order into equal runs gives shards whose row counts differ by at
most one and whose source counts differ from their share by at most one or two.

Both orders are made in two steps, so neither a hot source nor the whole table
meets in one task: rows fall into buckets (by hash within the source; by
fractional rank over all), the buckets' counts are summed up to offsets, and
rows are numbered within their bucket. Both keys are even by construction.

The law is ``rows``. Groups of equal texts are not kept together: the method
places rows singly, and a group above an eighth of all rows could not be.

Defined cases: null text has size 1 and checksum 0; the null source is a
source; null ids, ties and repeated rows are ordered by id, then text checksum,
and equal rows are interchangeable; an empty table gives no shards' rows. Extra
columns are kept by ``shard_rows`` unless they bear the name of an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import broadcast_if_small, stage

BROADCAST_BUCKETS = 100_000


def _numbered(rows: DataFrame, strata: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: 1-based rank within ``strata`` by (bucket, order), without a window over a stratum."""
    counts = rows.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("in_bucket"))
    before = Window.partitionBy(*strata).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*strata, bucket, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    offsets = broadcast_if_small(stage(offsets, "bucket-offsets"), BROADCAST_BUCKETS)
    within = rows.withColumn("within", F.row_number().over(Window.partitionBy(*strata, bucket).orderBy(*order)))
    return within.join(offsets, [*strata, bucket]).withColumn(out, F.col("offset") + F.col("within")).drop("offset", "within")


def interleave(rows: DataFrame, seed: int, bucket_rows: int) -> DataFrame:
    """Add ``place`` (0-based place in the interleaved order) and ``n_rows`` to ``rows``.

    ``rows`` needs ``doc_id``, ``source`` and ``tie``.
    """
    rows = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    rows = stage(rows.withColumn("mixed", F.xxhash64("doc_id", "tie", F.lit(seed))), "shard-rows")
    sizes = rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_source"))
    sizes = stage(sizes, "source-sizes")
    total = sizes.agg(F.sum("n_source")).first()[0] or 0
    rows = rows.join(broadcast_if_small(sizes, BROADCAST_BUCKETS), "source_key")
    buckets = F.ceil(F.col("n_source") / bucket_rows)
    unit = F.pmod("mixed", F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("bucket", F.floor(unit * buckets))
    rows = _numbered(rows, ["source_key"], "bucket", [unit, F.col("mixed"), F.col("doc_id"), F.col("tie")], "rank").drop("bucket")
    share = (F.col("rank") - 0.5) / F.col("n_source")
    rows = rows.withColumn("share", share).withColumn("slice", F.floor(F.col("share") * max(1, -(-total // bucket_rows))))
    # A source has at most one row at a place; the hash puts sources with equal shares in no fixed order.
    order = [F.col("share"), F.xxhash64("source_key", "rank", F.lit(seed)), F.col("source_key")]
    rows = _numbered(stage(rows, "shard-shares"), [], "slice", order, "place")
    return rows.withColumn("place", F.col("place") - 1).withColumn("n_rows", F.lit(total)).drop("slice", "share", "rank", "n_source", "mixed", "source_key")


def shard_of(place: Column, n_rows: Column, shards: int) -> tuple[Column, Column]:
    """The shard of a place when ``n_rows`` places are cut evenly, and the slot in it."""
    small, large = F.floor(n_rows / shards), n_rows % shards
    cut = (small + 1) * large
    shard = F.when(place < cut, F.floor(place / (small + 1))).otherwise(large + F.floor((place - cut) / F.greatest(small, F.lit(1))))
    start = shard * small + F.least(shard, large)
    return shard.cast("int"), (place - start).cast("long")


def shard_report(docs: DataFrame, shards: int = 8, seed: int = 23, bucket_rows: int = 50_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, source`` of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("tie"),
    )
    shard, slot = shard_of(F.col("place"), F.col("n_rows"), shards)
    placed = interleave(rows, seed, bucket_rows).withColumn("shard", shard).withColumn("slot", slot)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 23, bucket_rows: int = 50_000) -> DataFrame:
    """All columns of ``docs`` but ones named like them, with ``shard`` and ``slot``; equal rows are interchangeable."""
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    packed = docs.select("doc_id", "source", tie.alias("tie"), F.struct(*[f"`{c}`" for c in keep]).alias("user_row"))
    shard, slot = shard_of(F.col("place"), F.col("n_rows"), shards)
    return interleave(packed, seed, bucket_rows).select("user_row.*", shard.alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 23, files_per_shard: int = 1) -> None:
    """Write ``docs`` under ``path/shard=k``, each shard's files in slot order."""
    rows = shard_rows(docs, shards, seed)
    # Runs of equal length per shard; a shard has at most one row more than another.
    run = max(1, -(-(-(-docs.count() // shards)) // files_per_shard))
    rows = rows.withColumn("_file", F.floor(F.col("slot") / run))
    rows.repartition(shards * files_per_shard, "shard", "_file").sortWithinPartitions("shard", "_file", "slot").drop("_file").write.partitionBy("shard").parquet(path)
