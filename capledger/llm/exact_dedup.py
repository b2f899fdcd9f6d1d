"""Exact deduplication by two passes of a Bloom filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Slots for each row, and hash functions.
BITS_PER_KEY, HASHES = 16, 4


def _flagged(keyed: DataFrame) -> tuple[DataFrame, int]:
    """keyed (with a 64-bit hash h) with a column maybe: whether the hash may occur twice or more; and its rows.

    Pass one makes a filter whose slots remember whether two rows or more set them; pass two finds the rows whose slots
    were all set twice.  Any other row is surely alone.  The hash space is cut into as many ranges as give each row
    BITS_PER_KEY slots in a filter of bounded size.  Ranges come one after the other; keyed is sorted by h in each
    of its files, so a range reads its own pages.
    """
    spark = keyed.sparkSession
    n = keyed.count()
    ranges = C.n_ranges(n, BITS_PER_KEY)
    log2 = C.filter_log2(-(-n // ranges), BITS_PER_KEY)
    path = C.new_path(spark)
    for i in range(ranges):
        some = keyed.where(C.in_range(F.col("h"), i, ranges))
        bits = spark.sparkContext.broadcast(C.build_filter(some.select("h"), HASHES, log2, twice=True, seed=i))
        some.withColumn("maybe", C.held_by(bits, HASHES, log2, seed=i)("h")).write.mode("append").parquet(path)
        bits.unpersist()
    return spark.read.schema(keyed.schema.add("maybe", "boolean")).parquet(path), n


def _decided(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are surely alone (doc_id, sha), and each other (doc_id, sha) with times, keep_id and group_size."""
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keyed = docs.select(F.col(id_col).alias("doc_id"), sha.alias("sha")).withColumn("h", F.xxhash64("sha")).sortWithinPartitions("h")
    flagged, n = _flagged(C.materialize(keyed, scan=True))
    rows = C.materialize(flagged.where("maybe").groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("times")))
    groups = C.materialize(rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")))
    return flagged.where(~F.col("maybe")).select("doc_id", "sha"), C.join_skewed(rows, groups, "sha", F.col("group_size"), n)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, keep_id, group_size, kept, text_sha256 for each row.

    Texts are equal when they are identical; null counts as empty.  The row with the largest id stays; a
    null id is below every other.  Rows repeated with the same id and text each give a row, of which one at most is
    kept.  An empty table gives an empty result; other columns are not read.

    Only rows whose hash may be repeated shuffle (id and hash, no text); the others pass straight through.
    Groups are pre-aggregated before the shuffle, and groups of many rows, of which there are few whatever the
    input, meet their rows by broadcast, so no task gets a whole large group.
    """
    C.prepare(docs.sparkSession)
    alone, many = _decided(docs, id_col, text_col)
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    each = many.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return alone.unionByName(each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without exact copies: of equal texts the row with the largest id, all its columns.

    Null texts count as empty, a null id is below every other.  Of rows repeated with the same id and text one stays
    (which one is open if their other columns differ).  An empty table stays empty.  Texts shuffle only where a
    filter says that their id may be one to drop.
    """
    C.prepare(docs.sparkSession)
    _, many = _decided(docs, id_col, text_col)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    met = many.where(~stays | (F.col("times") > 1)).select(F.col("doc_id").alias("_met_id"), F.col("sha").alias("_met_digest"), stays.alias("_stays"), F.col("times").alias("_rows"))
    return C.without(docs, id_col, lambda d: F.sha2(F.coalesce(d[text_col], F.lit("")), 256), met)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup over documents: nulls, ties, repeated rows and empty tables as there."""
    return exact_dedup(C.table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
