"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, with one row per digest. A batch is reduced to one row per
digest; a sort-merge anti-join against the index leaves the digests that are new, and these are appended. What the batch
says of digests that the index holds (more rows, perhaps one that rather stays) goes to sightings beside it, so the index
is never rewritten and a group's size and kept row are those of all batches. Only DataFrame and SQL functions run.

Defined results: a null text counts as empty; rows are documents, so repeated rows (also of one doc_id) each count in
``group_size`` and are all kept when they are the kept doc_id; of equally long texts the smallest doc_id stays; a null
doc_id sorts last, so it stays only when no row of its group that is as long has one; a very long text is hashed whole.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.storage import Scratch, new_path, partitions, table

#: The characters deleted before texts are compared (space, tab to carriage return).
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


#: Into how many batches a table is dealt that enters an index as a whole.
BATCHES = 2
GROUP = "digest binary, keep_id bigint, keep_len int, group_size bigint"


class DigestIndex:
    """Digests seen so far at ``path``: (digest, keep_id, keep_len, group_size, batch), bucketed and sorted by digest.

    An index written before is opened again by giving its path and number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_len INT, group_size BIGINT, batch INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/digests'"
        )
        none = spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in GROUP.split(", "))])
        none.write.mode("ignore").parquet(f"{path}/sightings/batch=0")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The same rows read as plain files, for joins in which Spark may split a hot digest."""
        return self.spark.read.schema(f"{GROUP}, batch int").parquet(f"{self.path}/digests")

    def sightings(self) -> DataFrame:
        """(digest, keep_id, keep_len, group_size) of the batches after a digest's first, one row per batch and digest."""
        return self.spark.read.schema(f"{GROUP}, batch int").parquet(f"{self.path}/sightings")

    def append(self, groups: DataFrame, batch: int | None = None) -> None:
        """Appends the groups whose digest the index does not hold, and notes the others.

        A batch appended twice under one number (after a lost job) counts once: its digests are there by then, and its
        sightings, those of digests from other batches, replace the ones noted before.
        """
        if batch is None:
            batch = 1 + (self.entries().select("batch").unionByName(self.sightings().select("batch")).agg(F.max("batch")).first()[0] or 0)
        fresh = groups.join(self.entries().hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        (
            fresh.select("digest", "keep_id", "keep_len", "group_size", "batch")
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.insertInto(self.name)
        )
        earlier = self.entries().where(F.col("batch") != batch).select("digest")
        again = groups.join(earlier.hint("merge"), "digest", "left_semi")
        again.select("digest", "keep_id", "keep_len", "group_size").write.mode("overwrite").parquet(f"{self.path}/sightings/batch={batch}")

    def groups(self) -> DataFrame:
        """(digest, keep_id, group_size) over all batches."""
        more = self.sightings().groupBy(F.col("digest").alias("again")).agg(_stays().alias("more"), F.sum("group_size").alias("size"))
        own = F.struct((-F.col("keep_len")).alias("neg"), F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id"))
        best = F.least(own, F.coalesce("more", own))
        return self.files().join(more.hint("merge"), F.col("digest") == F.col("again"), "left").select("digest", best["id"].alias("keep_id"), (F.col("group_size") + F.coalesce("size", F.lit(0))).alias("group_size"))


def _stays(length: str = "keep_len", doc_id: str = "keep_id") -> Column:
    """The row that stays, as (minus its length, whether its id is null, id): the longest, then the smallest id."""
    return F.min(F.struct((-F.col(length)).alias("neg"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id")))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, digest) of every row; the text goes no further than this projection."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.length("text"), F.lit(0)).alias("text_len"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest: the longest original text stays, then the smallest doc_id. Partial aggregation takes a hot group apart."""
    return rows.groupBy("digest").agg(_stays("text_len", "doc_id").alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.id").alias("keep_id"), (-F.col("best.neg")).alias("keep_len"), "group_size"
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. Groups are those of the index's earlier data and this."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = scratch.table(digests(docs), "digests")
    index = index or DigestIndex(spark, new_path(spark, "digest-index"), partitions(spark))
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for b in range(batches):
        index.append(groups_of(rows.where(deal == b)))
    groups = scratch.table(index.groups(), "digest-groups")
    return rows.join(groups.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
