"""Which labelled rows teach a classifier."""

import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardwise.llm import labelled, tokens, toxicity
from wardwise.llm.common import Steps
from wardwise.llm.labelled import fold


def test_every_labelled_row_teaches_toxicity(spark, monkeypatch):
    """20,000 labelled rows, one in 20 toxic: all that are not held out are in the models or in the fit; some words occur in one row only."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("plain words "), F.when(F.col("id") % 20 == 0, "vile ").otherwise(""), F.lit("own"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 20 == 0).cast("int").alias("toxic"))
    sizes, train, fit = [], toxicity.train_models, toxicity._fit

    def counting_train(docs, lessons):
        sizes.append(lessons.count())
        return train(docs, lessons)

    def counting_fit(rows, *more):
        sizes.append(len(rows) if more else rows.count())
        return fit(rows, *more)

    monkeypatch.setattr(toxicity, "train_models", counting_train)
    monkeypatch.setattr(toxicity, "_fit", counting_fit)
    rows = toxicity.score_toxicity(docs, labels).where("held_out").collect()
    of = {r.f: r.n for r in docs.groupBy(fold(F.col("doc_id")).alias("f")).agg(F.count("*").alias("n")).collect()}
    assert sizes == [of[1] + of[2] + of[3], of[4]]
    assert min(r.score for r in rows if r.doc_id % 20 == 0) > max(r.score for r in rows if r.doc_id % 20)


def test_rare_words_share_buckets(spark, monkeypatch):
    """With few words kept one by one, the frequent word keeps its ratio, and a rare word of toxic texts still counts for them."""
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("u"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, F.lit(" vile")).otherwise(F.lit(" kind"))).alias("text"))
    lessons = docs.withColumn("label", (F.col("doc_id") % 2 == 0).cast("int"))
    ratio = lambda models, text: models.features(next(tokens.runs(pa.array([text]))))[0, 0]
    whole = toxicity.train_models(docs, lessons)
    monkeypatch.setattr(toxicity, "WORDS", 10)
    few = toxicity.train_models(docs, lessons)
    assert len(whole.words) == 402 and len(few.words) == 2 and len(few.tail) == 1 << toxicity.BITS
    for word in ("vile", "kind"):
        assert abs(ratio(few, word) - ratio(whole, word)) < 1e-9
    assert np.mean([ratio(few, f"u{i}") for i in range(0, 400, 2)]) > 0 > np.mean([ratio(few, f"u{i}") for i in range(1, 400, 2)])


def test_labels_meet_texts_without_a_shuffle_of_texts(spark):
    """Labels go to the texts as bits of 64 ids; ids below 0 and beyond 32 bits, repeated rows, NULLs and unlabelled ids give the rows of a plain join."""
    ids = [*range(-200, 300), 2**40 + 63, 2**40 + 64, -(2**63), 2**63 - 1, 7, None]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None if i % 7 == 0 else i % 2) for i in ids if i is not None and i % 3] + [(None, 1)], "doc_id long, toxic int")
    own = labelled.taught(labels, "toxic")
    steps = Steps(spark, "test")
    marked = steps.write(labelled.marks(own), "marks")
    for folds in ([1, 2, 3], [4]):
        rows = labelled.taught_rows(docs, marked, folds)
        plain = docs.join(own.where(F.col("fold").isin(folds)).select("doc_id", "label"), "doc_id")
        assert sorted(map(tuple, rows.select("doc_id", "text", "label").collect())) == sorted(map(tuple, plain.select("doc_id", "text", "label").collect()))
    many = spark.range(200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    many = steps.write(labelled.marks(labelled.taught(many, "toxic")), "many")
    assert many.count() == 3125 and sum(os.path.getsize(f) for f in glob.glob(f"{steps.folder}/many/*.parquet")) < 200_000
