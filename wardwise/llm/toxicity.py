"""Toxicity: two class-conditional Kneser-Ney models over shared backoff counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.llm import tokens
from wardwise.llm.common import Steps, without
from wardwise.llm.labelled import held_out, marks, taught, taught_rows

#: The models know at most so many words one by one, those of the most contexts; the others are counted by so many bits of their hash.
WORDS, BITS = 2**18, 18
DISCOUNT = 0.75
#: Lengths of the windows whose most toxic one counts.
WINDOWS = (1, 4, 12)
SHAPE = len(WINDOWS) + 2
THRESHOLD = 0.5
#: Contexts of a word are counted in maps of 64 bits, one for each level: level k takes a 2^-(k+1) of them by hash, so some
#: level is neither empty nor full however many there are. Maps of more than FULL bits are passed over.
LEVELS = 24
FULL = 44
#: The context of a text's first word.
START = np.uint64(0x9E3779B97F4A7C15)


def _words(run: tokens.Run) -> tuple[np.ndarray, np.ndarray]:
    begin, end, of = run.words(tokens.byte_table("alnum"))
    return run.word_hashes(begin, end, fold=tokens.LOWER), of


def bucket(h: np.ndarray) -> np.ndarray:
    """The part of a word's hash by which the models know it when it is not one of the WORDS."""
    return tokens.mix(h) >> np.uint64(64 - BITS)


def _before(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The word before each word, 0 at the start of a text."""
    v = np.zeros_like(h)
    v[1:] = np.where(of[1:] == of[:-1], h[:-1], np.uint64(0))
    return v


def _contexts(batches):
    """Different (word before, word) pairs of labelled texts, for each class and run; 32 bits tell a word's contexts apart."""
    with np.errstate(over="ignore"):
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False) == 1
            for run in tokens.runs(batch.column(1)):
                h, of = _words(run)
                v, mine = _before(h, of), toxic[run.first + of]
                pair = tokens.mix(v * np.uint64(0x9E3779B97F4A7C15) + h) ^ mine
                _, at = np.unique(pair, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((v[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(h[at].view(np.int64)), pa.array(mine[at])], names=["v", "h", "toxic"]
                )


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def _continuations(shared=None):
    """For each word, maps of the words before it by level, over the texts of a run; ``i`` is the word's hash, or its place among the words of ``shared``."""

    def rows(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for run in tokens.runs(batch.column(0)):
                    h, of = _words(run)
                    before = _before(h, of)
                    before = np.where(before == 0, START, before)
                    word = h.view(np.int64)
                    if shared is not None:
                        word = _find(shared.value, h)
                        word, before = word[word >= 0], before[word >= 0]
                    # The lowest bit set gives the level, the six highest bits the place.
                    lowest = before & (~before + np.uint64(1)) | np.uint64(1 << (LEVELS - 1))
                    level = np.log2((lowest & (~lowest + np.uint64(1))).astype(np.float64)).astype(np.int32)
                    order = np.lexsort((level, word))
                    word, level, bit = word[order], level[order], np.uint64(1) << (before[order] >> np.uint64(58))
                    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (level[1:] != level[:-1])])[: len(word)])
                    maps = np.bitwise_or.reduceat(bit, first) if len(first) else bit
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(word[first]), pa.array(level[first]), pa.array(maps.view(np.int64))], names=["i", "level", "map"])

    return rows


def context_counts(maps: DataFrame) -> DataFrame:
    """(i, n): how many different contexts a word has, from its maps (i, level, map) of all tasks.

    The levels from the first one on that has none of more than FULL bits above it are each counted by their free bits; together
    they hold a known share of all contexts. The error is about a tenth at any number of contexts.
    """
    bits = maps.groupBy("i", "level").agg(F.bit_count(F.bit_or("map")).alias("bits"))
    words = bits.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("level", "bits"))).alias("levels"))  # LEVELS at most
    base = F.array_max(F.transform("levels", lambda x: F.when(x["bits"] > FULL, x["level"] + 1).otherwise(0)))
    words = words.withColumn("base", F.least(base, F.lit(LEVELS - 1)))
    free = lambda x: -64 * F.log(F.greatest(64 - x["bits"], F.lit(0.5)) / 64)
    total = F.aggregate("levels", F.lit(0.0), lambda t, x: t + F.when(x["level"] >= F.col("base"), free(x)).otherwise(0.0))
    return words.select("i", (F.pow(F.lit(2.0), F.col("base")) * total).alias("n"))


class Models:
    """The words' log ratio: continuation probability in toxic texts against that in ordinary ones.

    A class's probability of a word is the discounted share of its different contexts, and what the discount frees goes to
    the backoff that both classes share. ``shared`` holds the words' contexts in all documents, ``of_all`` the sum and the number of
    those of every word there. A word of neither class has one ratio whatever its backoff, so only words of the classes are kept.
    Words not among ``words`` have the ratio of their ``bucket``, that of the mean of its words (``buckets``, with sums of contexts by class, numbers of
    words of each class, and of words in ``tail``).
    """

    def __init__(self, words: np.ndarray, contexts: np.ndarray, totals: np.ndarray, shared: np.ndarray, of_all: tuple[float, int],
                 buckets: np.ndarray, tail: np.ndarray, tail_shared: np.ndarray):
        self.words = words
        totals = np.maximum(totals.astype(float), 1)
        # What the discount frees: DISCOUNT for every word of a class, in a bucket as many times as it has such words.
        head, rare_words = np.maximum(contexts - DISCOUNT, 0), np.maximum(tail[:, :2] - DISCOUNT * tail[:, 2:4], 0)
        free = np.maximum(1 - (head.sum(0) + rare_words.sum(0)) / totals, 1e-6)
        rare = lambda n: ((n + 1) / (of_all[0] + of_all[1] + 1))[:, None]
        ratio = lambda p: np.log(p[:, 1]) - np.log(p[:, 0])
        self.ratio = ratio(head / totals + free * rare(shared))
        self.tail = np.full(1 << BITS if len(buckets) else 0, np.log(free[1]) - np.log(free[0]))
        self.tail[buckets] = ratio(rare_words / totals / tail[:, 4:] + free * rare(tail_shared))
        self.other = np.log(free[1]) - np.log(free[0])  # of a word of neither class

    def of(self, h: np.ndarray) -> np.ndarray:
        """The ratios of words."""
        at = _find(self.words, h)
        others = self.tail[bucket(h).view(np.int64)] if len(self.tail) else self.other
        return np.where(at >= 0, self.ratio[at], others) if len(self.ratio) else np.zeros(len(h)) + others

    def features(self, run: tokens.Run) -> np.ndarray:
        """Per text: length-normalised log-likelihood ratio of the whole and of its most toxic windows, and log length."""
        n_texts = run.last - run.first
        h, of = _words(run)
        n = np.bincount(of, minlength=n_texts)
        out = np.zeros((n_texts, SHAPE))
        if len(h):
            total = np.concatenate([[0], np.cumsum(self.of(h))])
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            last = np.append(first[1:], len(h))
            out[of[first], 0] = (total[last] - total[first]) / (last - first)
            i = np.arange(len(h))
            for k, size in enumerate(WINDOWS):
                end = np.minimum(i + size, np.repeat(last, last - first))
                out[of[first], k + 1] = np.maximum.reduceat((total[end] - total[i]) / size, first)
        out[:, -1] = np.log1p(n)
        return out


def train_models(docs: DataFrame, lessons: DataFrame) -> Models:
    """Contexts of every word of all labelled texts by class, joined to the backoff table, which counts every word of all documents."""
    spark = docs.sparkSession
    steps = Steps(spark, "toxicity")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    backoff = steps.write(context_counts(texts.mapInArrow(_continuations(), "i long, level int, map long")), "backoff")
    of_all = backoff.agg(F.sum("n"), F.count("*")).first()
    pairs = lessons.select("label", "text").mapInArrow(_contexts, "v int, h long, toxic boolean").distinct()
    count = lambda flag: F.count_if(F.col("toxic") == flag)
    counts = pairs.groupBy("h").agg(count(False).alias("n0"), count(True).alias("n1"))
    joined = counts.join(backoff.withColumnRenamed("i", "h"), "h", "left").select("h", "n0", "n1", F.coalesce("n", F.lit(0.0)).alias("n"))
    every = steps.write(joined, "words")
    # The least number of contexts at which no more than WORDS words remain.
    least, kept = 1, 0
    sizes = every.groupBy(F.least(F.col("n0") + F.col("n1"), F.lit(WORDS)).alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c"))
    for r in sizes.collect():  # different numbers of contexts
        if kept + r.k > WORDS:
            least = r.c + 1
            break
        kept += r.k
    totals = every.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    words = every.where(F.col("n0") + F.col("n1") >= least).toPandas()  # WORDS rows at most
    rare = every.where(F.col("n0") + F.col("n1") < least).mapInArrow(_buckets, "b int, n0 long, n1 long, n double")
    some = lambda c: F.count_if(F.col(c) > 0).alias(f"w_{c}")
    tail = rare.groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), some("n0"), some("n1"), F.count("*").alias("k"), F.avg("n").alias("n")).toPandas()  # 2^BITS rows at most
    steps.drop("backoff", "words")
    keys = words["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    contexts = words[["n0", "n1"]].to_numpy(dtype=np.int64)[order]
    counts = tail[["n0", "n1", "w_n0", "w_n1", "k"]].to_numpy(dtype=float)
    return Models(keys[order], contexts, np.array(totals, dtype=np.int64), words["n"].to_numpy(dtype=float)[order], (of_all[0] or 0.0, of_all[1]),
                  tail["b"].to_numpy(dtype=np.int64), counts, tail["n"].to_numpy(dtype=float))


def _buckets(batches):
    for batch in batches:
        b = bucket(batch.column(0).to_numpy().view(np.uint64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(b), *batch.columns[1:]], names=["b", "n0", "n1", "n"])


def _newton_sums(b: np.ndarray):
    """Gradient and curvature of the logistic loss at ``b``, one row of sums a batch."""

    def sums(batches):
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            x = np.asarray(batch.column(1).flatten()).reshape(len(y), SHAPE)
            z = np.hstack([x, np.ones((len(y), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            row = np.concatenate([z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], names=["k", "s"])

    return sums


def _fit(rows: DataFrame) -> np.ndarray:
    """Logistic weights by Newton's method with a small ridge, both classes weighted as they come: one sum over the rows (label, x) a round."""
    b = np.zeros(SHAPE + 1)
    for _ in range(30):
        sums = {r.k: r.s for r in rows.mapInArrow(_newton_sums(b), "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
        flat = np.array([sums[k] for k in range(len(b) * (len(b) + 1))])
        step = np.linalg.solve(flat[len(b):].reshape(len(b), len(b)) + 1e-3 * np.eye(len(b)), flat[: len(b)] + 1e-3 * b)
        b = b - step
        if np.abs(step).max() < 1e-10:
            break
    return b


def _feature_rows(shared):
    def rows(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                parts = [shared.value.features(run) for run in tokens.runs(batch.column(1))]
                x = np.concatenate(parts) if parts else np.zeros((0, SHAPE))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["row", "x"])

    return rows


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` but text, with held_out, score (0 to 1, higher: more toxic), predicted and ratio.

    The toxic and the ordinary model are Kneser-Ney continuation models: a word counts by its different contexts in the class's
    labelled texts, and what the discount frees goes to one backoff that both share, the words' contexts in all documents. ``ratio`` is the
    difference of the two log-likelihoods per word; the score is a logistic function of it, of the ratios of the most toxic
    windows of WINDOWS words, and of the log length. All labelled rows that are not held out teach: three folds
    the models, the fourth the logistic function. A pair order above the continuation model is left out: pairs are
    so sparse that it lowered the held-out area under the curve (README).
    NULL and empty texts have ratio 0; repeated rows get equal scores; without labels of both classes the score is their smoothed share.
    """
    docs = without(docs, "held_out", "score", "predicted", "ratio")
    spark = docs.sparkSession
    steps = Steps(spark, "toxicity-fit")
    own = steps.write(marks(taught(labels, "toxic")), "marks")
    models = spark.sparkContext.broadcast(train_models(docs, taught_rows(docs, own, [1, 2, 3])))
    check = taught_rows(docs, own, [4]).select(F.struct("doc_id", "label").alias("row"), "text")
    rows = check.mapInArrow(_feature_rows(models), "row struct<doc_id:long,label:int>, x array<double>").select("row.*", "x")
    rows = steps.write(rows.dropDuplicates(["doc_id"]).select("label", "x"), "rows")
    n, n_yes = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    shares = {r["label"]: r["n"] for r in labels.where(~held_out(F.col("doc_id"))).groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("n")).collect()}
    yes, no = shares.get(1, 0), shares.get(0, 0)
    if 0 < n_yes < n:
        weights = _fit(rows)
        weights[-1] += np.log(yes / no) - np.log(n_yes / (n - n_yes))  # from the fold's shares to the labels'
    else:
        weights = np.zeros(SHAPE + 1)
        weights[-1] = np.log((yes + 1) / (no + 1))
    steps.drop("rows", "marks")
    names = [c for c in docs.columns if c != "text"]
    columns = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    out = columns.mapInArrow(_feature_rows(models), columns.select("row", F.array(F.lit(0.0)).alias("x")).schema)
    logit = sum((F.get("x", F.lit(i)) * float(w) for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    scored = out.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-40.0)), F.lit(40.0)))))
    return scored.select(
        *[F.col("row").getField(c).alias(c) for c in names], held_out(F.col("row").getField("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), F.get("x", F.lit(0)).alias("ratio"),
    )
