"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per
digest (with map-side combine, so a text with a third of all rows costs one row per task), then
sort-merge joined with the index bucket by bucket without moving the index: a left anti join
finds the new digests, which are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import SPACE, col, join_back, keyed, text_of

INDEX_SCHEMA = "digest string, keep_id bigint, keep_chars bigint, batch string"


def normalized(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, f"{SPACE}+", "")


class DigestIndex:
    """Digests seen so far, with the row that stays for each.

    The files outlive the session: opening an index at a path that holds one continues it. The number
    of ``buckets`` is fixed and written beside the index when it is made (64 if not given; choose it so that a
    bucket fits a task); opening it with another number raises ValueError, as digests would be
    looked up in the wrong buckets. ``close`` takes the table out of the catalog and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        note = f"{path.rstrip('/')}.buckets"
        at = spark._jvm.org.apache.hadoop.fs.Path(note)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            self.buckets = spark.read.schema("buckets int").json(note).first()[0]
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        else:
            self.buckets = int(buckets or 64)
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.json(note)
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex[:16]}"
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, entries: DataFrame) -> None:
        """Add entries, one file for each bucket."""
        entries.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)

    def compact(self, path: str) -> DigestIndex:
        """A copy of the index at another path with a single file for each bucket."""
        out = DigestIndex(self.spark, path, self.buckets)
        out.append(self.entries())
        return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key, id, code points and SHA-256 of the normalised text of each row."""
    text = text_of(text_col)
    return keyed(
        docs,
        col(id_col).alias("doc_id"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.sha2(normalized(text).cast("binary"), 256).alias("digest"),
    )


def ingest(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Deduplicate ``docs`` against the index and among themselves, and append what is new.

    Returns a row for each input row: __row, doc_id, keep_id, group_size (rows of this batch with
    the text), kept, text_sha256. Null text counts as empty. Of equal texts that are new, the row
    with the most code points stays, then that with the smallest id (null ids last), then the first
    by place in its file, so of repeated rows one stays. If the index has the text, none stays and
    keep_id names the indexed row. Of very long texts only digests move. An empty table gives no rows and leaves the index as it is.

    ``batch`` names the batch in the index. A job that may be run again passes the same name each
    time: what an earlier run has appended under it counts as new again, so the result is the same
    and nothing is appended twice. By default each call is a batch of its own.
    """
    tag = batch or uuid.uuid4().hex
    rows = scratch.materialize(digests(docs, id_col, text_col), "digests")
    order = F.struct(
        (-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("__row").alias("r")
    )
    groups = (
        rows.groupBy("digest")
        .agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select(
            "digest", "group_size", F.col("best.d").alias("best_id"), F.col("best.r").alias("best_row"), (-F.col("best.c")).alias("best_chars")
        )
    )
    groups = scratch.materialize(groups, "groups").repartition(index.buckets, "digest")
    fresh = groups.hint("merge").join(index.entries().select("digest").hint("merge"), "digest", "left_anti")
    index.append(
        fresh.select("digest", F.col("best_id").cast("long").alias("keep_id"), F.col("best_chars").alias("keep_chars"), F.lit(tag).alias("batch"))
    )
    known = index.entries().select("digest", "keep_id", (F.col("batch") == tag).alias("is_new"))
    decided = scratch.materialize(groups.join(known.hint("merge"), "digest"), "decided")
    # both sides are dealt anew here, so that adaptive execution can split the rows of a hot text
    return rows.join(decided.drop("best_id", "best_chars"), "digest").select(
        "__row",
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("is_new") & (F.col("__row") == F.col("best_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def buckets_for(docs: DataFrame, rows: int = 250_000) -> int:
    """A number of buckets for an index that starts with ``docs``: one for each ``rows`` rows, 64 at least."""
    return max(64, -(-docs.count() // rows))


def new_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An empty index in the shared folder. The number of buckets stays, so take it from what the index is to hold (``buckets_for``)."""
    return DigestIndex(spark, scratch.new_path(spark, "digest_index"), buckets)


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is new, one for each text, with all their columns and no others; nulls, ties and repeats as in ``ingest``."""
    docs = scratch.as_files(docs)
    if index is None:
        index = new_index(docs.sparkSession, buckets_for(docs))
        out = ingest(docs, index, id_col, text_col)
        index.close()  # the result reads what was written of it
    else:
        out = ingest(docs, index, id_col, text_col, batch)
    rows, _ = join_back(docs, out.filter("kept").select("__row"), "left_semi")
    return rows.select(*[col(c) for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = new_index(spark, buckets_for(docs))
    out = ingest(docs, index).drop("__row")
    index.close()
    return out


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS r,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM w
"""
