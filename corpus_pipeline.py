"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise.llm import decontaminate, ngram_join, packing, pii, quality
from wardwise.llm.common import Steps, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: the one of smallest id.

    Rows of equal id and text are one document, of which one row stays; rows without id, or without text, are documents of their own and all stay.
    """
    marks = Steps(spark, "marks").write(ngram_join.join_near_copies(docs).select("doc_id", "digest", "kept"), "marks")
    named = marks.where("doc_id is not null and digest is not null")
    gone = named.where("not kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    left = docs.join(gone, (F.col("doc_id") == F.col("_id")) & (F.md5("text") == F.col("_digest")), "left_anti")
    # Without a repeated row there is nothing to merge, and no need to shuffle the texts for it.
    if named.where("kept").groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        return left
    whole = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    return left.where(whole).dropDuplicates(["doc_id", "text"]).unionByName(left.where(~whole))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.contaminated(decontaminate.n_hit("spans"), F.col("n_words"))
    return found.where(~hit).select(*docs.columns)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets."""
    found = pii.find_pii(docs).withColumn("text", pii.redact(F.col("text"), F.col("pii_spans")))
    length = F.when(F.size("pii_spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length.cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the documents that are left."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("pii", pii_redaction),
    ("packing", best_fit_packing),
]
#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; the tables between them are written, and dropped when the next one has been."""
    steps = Steps(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = steps.write(stage(spark, docs, sf_dir), name)
        if before:
            steps.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
