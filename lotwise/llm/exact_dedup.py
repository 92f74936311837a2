"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest.  A batch is reduced
to one row per digest (map-side first, so a group of copies that holds a third
of all rows costs one row per task), anti-joined with the index by sort-merge
without moving the index, and what is new is appended.  A table is fed in batches
by falling id, so that the digests of the later ones meet those of the earlier.

Defined results: a null text counts as empty; of equal texts the largest
``doc_id`` stays (null is smallest); of repeated rows with that id one stays.
Empty tables give empty results.  Documents are carried as a struct, so extra
columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm.tables import cut, scratch, table

#: Batches in which a table is fed to the index.
BATCHES = 2


def digest(text: str = "text"):
    """SHA-256 of the whole UTF-8 text as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (digest, doc_id) with the number of such rows."""
    return (docs.select(digest(text_col).alias("digest"), F.col(id_col).alias("doc_id"))
            .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")))


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays, its copies, and the group's size."""
    return (rows.groupBy("digest")
            .agg(F.max(F.struct("doc_id", "copies")).alias("top"), F.sum("copies").alias("group_size"))
            .select("digest", F.col("top.doc_id").alias("keep_id"),
                    F.col("top.copies").alias("keep_copies"), "group_size"))


class DigestIndex:
    """A persistent table (digest, keep_id, keep_copies, group_size), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose digest the index lacks (sort-merge anti-join)."""
        if not self.exists():
            return batch
        return batch.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, batch: DataFrame) -> DataFrame:
        """Add the digests of ``batch`` (one row each) that are new, and return those."""
        fresh = cut(self.unseen(batch), "fresh-digests")
        (fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        return fresh

    def feed(self, rows: DataFrame, batches: int = BATCHES) -> DataFrame:
        """Append ``rows`` (``digest_rows``) in batches by falling id; the digests that were new.

        The first batch that holds a digest names the id that stays, so that is the
        largest; rows without an id come last.
        """
        shares = [F.lit(k / batches) for k in range(batches - 1, 0, -1)]
        cuts = rows.agg(F.percentile_approx("doc_id", F.array(*shares))).first()[0] if batches > 1 else None
        cuts = sorted(set(cuts or []), reverse=True)
        doc_id, fresh = F.col("doc_id"), None
        for above, below in zip([None, *cuts], [*cuts, None]):
            inside = F.lit(True) if above is None else F.coalesce(doc_id < above, F.lit(True))
            part = rows.where(inside if below is None else inside & (doc_id >= below))
            new = self.append(groups(part))
            fresh = new if fresh is None else fresh.unionByName(new)
        return fresh


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    path = scratch(spark, "digest-index")
    return DigestIndex(spark, path.rsplit("/", 1)[1].replace("-", "_"), path)


def verdicts(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document with the copy that stays, looked up in the index.

    The lookup reads the index's files without their buckets and shuffles both
    sides, so that AQE can split the digest of a large group.
    """
    files = index.spark.read.schema(index.read().schema).parquet(index.path).select("digest", "keep_id")
    sizes = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    found = rows.join(files.join(sizes, "digest"), "digest")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_unique(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; the index gets their digests.

    Texts that the index holds already go, and of equal new texts one stays.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"))
    fresh = index.feed(cut(digest_rows(docs, id_col, text_col), "digests"))
    winners = fresh.select(F.col("digest").alias("win"), "keep_id")
    same = Window.partitionBy("digest", "doc_id").orderBy(F.xxhash64("row"))
    return (packed.join(winners, (F.col("digest") == F.col("win"))
                        & F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .withColumn("copy", F.row_number().over(same)).where("copy = 1").select("row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` through a new digest index, in batches."""
    rows = cut(digest_rows(table(spark, sf_dir, "documents")), "digests")
    index = new_index(spark)
    index.feed(rows)
    return verdicts(rows, index)


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
