"""Exact deduplication against a persistent digest index.

The index is a table in the warehouse, bucketed and sorted by digest. A batch
is reduced to one row per digest (a partial aggregate runs before the shuffle,
so a digest that holds a third of all rows costs one row per task), anti-joined
to the index by sort-merge, and what is left is appended. The index side of
that join is read by bucket and never shuffled again.

Defined cases: a null text counts as empty text; several rows with equal text
form one group whatever their other columns hold; rows with a null id take part
and lose against any id; of rows that share text and id, or text and having no
id, one stays; an empty batch appends nothing. Further columns, also
ones named like the outputs, are ignored by the index and by the report.
Everything here is DataFrame code.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import drop_stage, stage


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)`` of every row; the digest is SHA-256 of the UTF-8 text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    """A persistent set of digests, each with the id of the row that stays.

    Batches must come in the order of precedence: a digest keeps the id of the
    batch that brought it first, and within a batch the largest id stays.
    ``buckets`` is fixed when the table is made; give it about one bucket for
    each 100 MB the index is expected to hold.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (``doc_id``, ``digest``) that the index lacks."""
        groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        if self.exists():
            known = self.rows().select("digest").hint("merge")
            groups = groups.join(known, "digest", "left_anti")
        (
            groups.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def decide(self, batch: DataFrame) -> DataFrame:
        """What happens to each row of ``batch``, all of whose digests are indexed.

        ``doc_id, keep_id, group_size, kept, text_sha256``; ``group_size``
        counts the rows of ``batch``. The per-digest table is written and read
        again, so the join to the rows has a plain exchange on both sides and a
        hot digest is split by the adaptive skew join.
        """
        # Rows of one id and digest are alike; they are counted, told apart by number, and the first may stay.
        units = stage(batch.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("rows")), "digest-rows")
        sizes = units.groupBy("digest").agg(F.sum("rows").alias("group_size"))
        groups = stage(sizes.join(self.rows().hint("merge"), "digest"), "digest-groups")
        each = units.join(groups.hint("merge"), "digest").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        return each.select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """Deduplicate ``docs`` through ``index``; of equal texts the largest id stays.

    The rows are added in ``batches`` ranges of the id, the highest range
    first, as daily loads would arrive newest first; every batch after the
    first is anti-joined to what the index then holds.
    """
    rows = stage(digests(docs), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        low = high = 0
    width = max(1, -(-(high - low + 1) // batches))
    nth = F.lit(batches - 1)  # null ids come last
    for k in reversed(range(batches - 1)):
        # Ids may span all 64 bits, so ranges are told by their ends, not by differences.
        nth = F.when(F.col("doc_id") > F.lit(max(high - width * (k + 1), -(2**63))), k).otherwise(nth)
    for k in range(batches):
        index.add(rows.filter(nth == k))
    return index.decide(rows)


def dedup_report(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Decisions for a whole table through a new index in the warehouse."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return exact_dedup(docs, DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets))


__all__ = ["DigestIndex", "dedup_report", "digests", "drop_stage", "exact_dedup"]
