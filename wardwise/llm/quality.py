"""Quality classifier: random-indexing word vectors pooled per document, and a small calibrated network."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.llm import tokens
from wardwise.llm.common import without
from wardwise.llm.labelled import held_out, labelled_rows, sample

#: Word buckets and dimensions of the vectors: the table has WORDS x DIMS numbers whatever the corpus.
WORDS = 1 << 13
DIMS = 32
NONZEROS = 4
REACH = 2
#: Labelled rows of each class that teach the network.
PER_CLASS = 8_000
HIDDEN = 24
EPOCHS = 40
THRESHOLD = 0.3

_CLASS = np.full(256, 3, dtype=np.uint8)  # punctuation
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1


def _tokens(run: tokens.Run) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every token: runs of letters, of digits (told apart by length) and of other marks."""
    kind = _CLASS[run.data]
    change = np.ones(len(kind), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    inner = run.starts[1:-1]
    change[inner[inner < len(kind)]] = True
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(kind))
    word = kind[begin] > 0
    begin, end = begin[word], end[word]
    h = run.word_hashes(begin, end)
    number = kind[begin] == 2
    h[number] = tokens.mix((end - begin)[number].astype(np.uint64))
    return (h % np.uint64(WORDS)).astype(np.int64), np.searchsorted(run.starts, begin, side="right") - 1


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of every bucket's random index vector."""
    with np.errstate(over="ignore"):
        r = tokens.constants(7, WORDS * NONZEROS).reshape(WORDS, NONZEROS)
        return (r % np.uint64(DIMS)).astype(np.int64), np.where((r >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)


def _gather(batches):
    """Sums of the index vectors around each word bucket, over all texts of a task."""
    place, sign = _index_vectors()
    total, count = np.zeros(WORDS * DIMS), np.zeros(WORDS)
    with np.errstate(over="ignore"):
        for batch in batches:
            for run in tokens.runs(batch.column(0)):
                word, of = _tokens(run)
                count += np.bincount(word, minlength=WORDS)
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(of[step:] == of[:-step])
                    a, b = word[near], word[near + step]
                    for k in range(NONZEROS):
                        total += np.bincount(a * DIMS + place[b, k], sign[b, k], WORDS * DIMS)
                        total += np.bincount(b * DIMS + place[a, k], sign[a, k], WORDS * DIMS)
    seen = np.flatnonzero(count)
    columns = [pa.array(seen), pa.array(count[seen]), *[pa.array(c.astype(np.float32)) for c in total.reshape(WORDS, DIMS)[seen].T]]
    yield pa.RecordBatch.from_arrays(columns, names=["word", "n", *[f"d{i}" for i in range(DIMS)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vector of every word bucket, from all documents: unit length, frequent words weighted down.

    Each task sends one bounded table of sums; they are added up by bucket, and WORDS rows go to the driver.
    """
    names = [f"d{i}" for i in range(DIMS)]
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_gather, "word long, n double, " + ", ".join(f"{d} float" for d in names))
    rows = parts.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(d).alias(d) for d in names]).orderBy("word").toPandas()
    out, n = np.zeros((WORDS, DIMS)), np.zeros(WORDS)
    at = rows["word"].to_numpy(dtype=np.int64)
    out[at], n[at] = rows[names].to_numpy(dtype=float), rows["n"].to_numpy(dtype=float)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    share = n / max(n.sum(), 1)
    return (out * (1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def pool(run: tokens.Run, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the logarithm of its length."""
    n_texts = run.last - run.first
    word, of = _tokens(run)
    n = np.bincount(of, minlength=n_texts)
    mean, square = np.zeros((n_texts, DIMS)), np.zeros((n_texts, DIMS))
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        v = vectors[word]
        mean[of[first]] = np.add.reduceat(v, first, axis=0, dtype=np.float64)
        square[of[first]] = np.add.reduceat(v * v, first, axis=0, dtype=np.float64)
    size = np.maximum(n, 1)[:, None]
    mean /= size
    return np.hstack([mean, np.sqrt(np.maximum(square / size - mean * mean, 0)), np.log1p(n)[:, None]])


class Network:
    """Two layers, trained with Adam; probabilities are calibrated by one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 1):
        """``check`` marks the rows that only set the temperature. One class alone gives its share as constant."""
        self.constant = None
        teach = ~check
        if not len(y) or y.min() == y.max() or not teach.any() or y[teach].min() == y[teach].max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x[teach].mean(0), np.maximum(x[teach].std(0), 1e-6)
        z, t = (x[teach] - self.mean) / self.scale, y[teach].astype(float)
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(t)), max(1, len(t) // 128)):
                h = np.tanh(z[part] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[part]) / len(part)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[part].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                step += 1
                for a, g, mm, vv in zip(p, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= 0.004 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        held = check if check.any() else teach
        logit, truth = self.logit(x[held]), y[held]
        loss = lambda t: np.logaddexp(0, np.where(truth == 1, -logit, logit) / t).mean()
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def _pooled(shared):
    def rows(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                parts = [pool(run, shared.value) for run in tokens.runs(batch.column(1))]
                x = np.concatenate(parts) if parts else np.zeros((0, 2 * DIMS + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["row", "x"])

    return rows


def _scored(shared):
    def rows(batches):
        vectors, network = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                parts = [network.score(pool(run, vectors)) for run in tokens.runs(batch.column(1))]
                s = np.concatenate(parts) if parts else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["row", "text", "score"])

    return rows


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, and the network from at most ``per_class`` labelled rows of each class.

    Labels of held-out rows are never read; the last fold of the others sets the temperature.
    """
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    own = labelled_rows(docs, sample(labels, "quality", per_class))
    lessons = own.select(F.struct("doc_id", "label", "fold").alias("row"), "text").mapInArrow(
        _pooled(shared), "row struct<doc_id:long,label:int,fold:int>, x array<double>"
    )
    rows = lessons.select("row.*", "x").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), 2 * DIMS + 1)
    return vectors, Network(x, rows["label"].to_numpy(), rows["fold"].to_numpy() == 4)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` with held_out, score (0 to 1, higher: better) and predicted (1 from ``threshold`` on).

    Scores depend on the text alone. NULL and empty texts are scored as texts without words; repeated rows get
    equal scores; without labels of both classes the score is their smoothed share. No text is shuffled.
    """
    docs = without(docs, "held_out", "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    columns = docs.select(row, F.col("text").cast("string").alias("text"))
    out = columns.mapInArrow(_scored(shared), columns.withColumn("score", F.lit(0.0)).schema)
    names = [F.col("row").getField(c).alias(c) if c != "text" else F.col("text") for c in docs.columns]
    return out.select(
        *names, held_out(F.col("row").getField("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
