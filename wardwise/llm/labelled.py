"""Labels for the classifiers: all of them or a bounded sample, and the rows they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """Remainder of the CRC-32 of the id as text; rows of remainder 0 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def taught(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label, fold): every labelled row that is not held out.

    NULL ids and labels are left out; of repeated labels the smallest counts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
    own = own.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    return own.withColumn("fold", fold(F.col("doc_id")).cast("int")).where("fold <> 0")


def sample(labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class of ``taught``, those of the smallest hash."""
    own = taught(labels, column)
    take = lambda c: own.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return take(0).union(take(1))


def marks(own: DataFrame) -> DataFrame:
    """(word, m0, m1): the rows of ``taught`` as bits, one row for 64 consecutive ids: bit k of ``m0`` or ``m1`` says that id 64 * word + k has that label.

    Two bits an id where ids are dense, so that the table is small beside the texts that meet it.
    """
    bit = F.expr("shiftleft(1L, CAST(doc_id & 63 AS INT))")
    some = lambda label: F.bit_or(F.when(F.col("label") == label, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{label}")
    return own.groupBy(F.shiftright("doc_id", 6).alias("word")).agg(some(0), some(1))


def taught_rows(docs: DataFrame, marked: DataFrame, folds: list[int]) -> DataFrame:
    """doc_id, text and label of all labelled rows of some folds, by the ``marks`` of ``taught``.

    No hint: the planner sends the marks to the texts while they are small, and shuffles both beyond the session's broadcast limit.
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = columns.where(fold(F.col("doc_id")).isin(folds)).withColumn("word", F.shiftright("doc_id", 6)).join(marked, "word")
    has = lambda marks: F.expr(f"(shiftrightunsigned({marks}, CAST(doc_id & 63 AS INT)) & 1) = 1")
    return met.select("doc_id", "text", F.when(has("m0"), 0).when(has("m1"), 1).alias("label")).where(F.col("label").isNotNull())


def labelled_rows(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """doc_id, text, label and fold of the picked rows. The picked ids are few by construction, so they go to every task."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.join(F.broadcast(picked), "doc_id")
