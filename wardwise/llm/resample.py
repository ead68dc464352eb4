"""Resampling towards a target: bucket counts as bit planes, weighed by AND and popcount against planes of the buckets' gains."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.llm import tokens
from wardwise.llm.common import Steps, without
from wardwise.operators.ordered import running

BUCKETS = 10_000
#: 64-bit words of a plane.
PLANE = -(-BUCKETS // 64)
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Documents whose planes are held at once.
GROUP = 512
#: Up to this many bytes, a CRC is carried on by table; longer words are read again.
CARRY = 48

_CARRY: list[np.ndarray] = []


def _byte_steps() -> np.ndarray:
    """What CRC-32 makes of each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _carry_tables() -> np.ndarray:
    """(length, byte place, byte): the register after ``length`` zero bytes, which is linear in its four bytes."""
    if not _CARRY:
        step = _byte_steps()
        out = np.zeros((CARRY + 1, 4, 256), dtype=np.uint32)
        for k in range(4):
            out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for n in range(CARRY):
            out[n + 1] = step[out[n] & 255] ^ (out[n] >> np.uint32(8))
        _CARRY.append(out)
    return _CARRY[0]


def _carried(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    t = _carry_tables()
    out = t[length, 0, crc & 255]
    for k in (1, 2, 3):
        out = out ^ t[length, k, (crc >> np.uint32(8 * k)) & 255]
    return out


def _word_crcs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lead: bytes) -> np.ndarray:
    """CRC-32 of ``lead`` and each word: byte by byte over all words at once, long words one by one."""
    step, length = _byte_steps(), end - begin
    crc = np.full(len(begin), zlib.crc32(lead) ^ 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(-np.minimum(length, CARRY + 1), kind="stable")
    ends = np.searchsorted(-np.minimum(length, CARRY + 1)[order], -np.arange(CARRY + 1), side="left")  # words of more than k bytes
    first, state = begin[order], crc[order]
    for k in range(CARRY):
        n = ends[k]
        if not n:
            break
        s = state[:n]
        state[:n] = step[(s ^ data[first[:n] + k]) & 255] ^ (s >> np.uint32(8))
    crc[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > CARRY):
        crc[i] = zlib.crc32(data[begin[i] : end[i]].tobytes(), zlib.crc32(lead))
    return crc


def features(run: tokens.Run, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every run of 1 to ``longest`` words, and the number of words of each text."""
    begin, end, of = run.words(tokens.byte_table("alnum"))
    data, length = tokens.LOWER[run.data], end - begin
    crc = _word_crcs(data, begin, end, b"")
    spaced = _word_crcs(data, begin, end, b" ")
    texts, buckets = [of], [crc % np.uint32(BUCKETS)]
    for k in range(1, longest):
        n = max(len(begin) - k, 0)
        crc = _joined(crc[:n], spaced[k:], length[k:] + 1, data, begin[k:], end[k:])
        same = of[:n] == of[k:]
        texts.append(of[:n][same])
        buckets.append(crc[same] % np.uint32(BUCKETS))
    return np.concatenate(texts), np.concatenate(buckets).astype(np.int64), np.bincount(of, minlength=run.last - run.first)


def _joined(crc, spaced, length, data, begin, end) -> np.ndarray:
    """CRC-32 of what ``crc`` has seen, a space, and the next word."""
    out = _carried(crc, np.minimum(length, CARRY)) ^ spaced
    for i in np.flatnonzero(length > CARRY):
        out[i] = zlib.crc32(data[begin[i] : end[i]].tobytes(), zlib.crc32(b" ", int(crc[i])))
    return out


def _bucket_sums(batches):
    """(bucket, n) of a task's texts."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for run in tokens.runs(batch.column(0)):
            total += np.bincount(features(run)[1], minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): features of all texts, summed in each task before they are shuffled."""
    own = texts.select(F.col("text").cast("string").alias("text")).where("text is not null")
    return own.mapInArrow(_bucket_sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all BUCKETS: thousandths of the log ratio of the bucket's smoothed shares in the target and in the documents."""
    spark = documents.sparkSession
    both = documents.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(
        target.select("bucket", F.lit(0).cast("long"), F.col("n")))
    every = spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = both.union(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + BUCKETS) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    return counts.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # totals: one row


def _planes(bits: np.ndarray) -> np.ndarray:
    """Rows of BUCKETS flags as rows of PLANE words."""
    wide = np.zeros((len(bits), PLANE * 64), dtype=bool)
    wide[:, :BUCKETS] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class GainPlanes:
    """Whole numbers as planes in two's complement: the sum of 2^j times plane j, the last one negative."""

    def __init__(self, gains: np.ndarray):
        width = int(np.abs(gains).max(initial=0)).bit_length() + 1
        rows = np.stack([(gains >> j) & 1 for j in range(width)]).astype(bool)
        self.planes = _planes(rows)
        self.powers = [(1 << j) if j < width - 1 else -(1 << j) for j in range(width)]

    def weights(self, texts: np.ndarray, buckets: np.ndarray, n_texts: int) -> np.ndarray:
        """For each text, the sum of its features' gains."""
        out = np.zeros(n_texts, dtype=np.int64)
        key, count = np.unique(texts * BUCKETS + buckets, return_counts=True)
        cuts = np.searchsorted(key, np.arange(0, n_texts + GROUP, GROUP) * BUCKETS)
        for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            first, n = g * GROUP, min(GROUP, n_texts - g * GROUP)
            if n <= 0 or a == b:
                continue
            own, times = key[a:b] - first * BUCKETS, count[a:b]
            for i in range(int(times.max()).bit_length()):
                flags = np.zeros(n * BUCKETS, dtype=bool)
                flags[own[(times >> i) & 1 == 1]] = True
                plane = _planes(flags.reshape(n, BUCKETS))
                for power, gain in zip(self.powers, self.planes, strict=True):
                    out[first : first + n] += (power << i) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
        return out


def _weigh(shared):
    def rows(batches):
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for run in tokens.runs(batch.column(1)):
                texts, buckets, own = features(run)
                n = run.last - run.first
                n_words.append(own)
                n_features.append(np.bincount(texts, minlength=n))
                weights.append(shared.value.weights(texts, buckets, n))
            flat = lambda parts: pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), flat(n_words), flat(n_features), flat(weights)], names=["row", "n_words", "n_features", "weight"])

    return rows


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """The columns of ``docs`` but text, with n_words, n_features, weight, score and rank: a draw of documents that read like the target.

    Words are lower-cased (A-Z) runs of letters and digits; features are all runs of one to three words, and a feature's bucket is
    its CRC-32 modulo BUCKETS. Each task sums its texts' buckets before they are shuffled. The BUCKETS gains, a table of fixed size, go to every task as
    bit planes in two's complement; a document's counts become planes too, and its weight is the sum of the powers of two times the common bits
    of each two planes, which is exact. The score adds Gumbel noise from a hash of ``seed`` and the id. Of the
    documents with ``least_words`` words or more, the ``percent`` percent (rounded down) of the highest scores are ranked from 1, ties to the smaller
    id; they are ranked by range, so no task sorts them all.

    NULL and empty texts have no features and weight 0. A row without an id has no score and is never drawn, nor counted among those drawn from; repeated rows
    are drawn each by themselves. Without documents the result is empty; with an empty target all gains come from the documents alone.
    """
    docs = without(docs, "n_words", "n_features", "weight", "score", "rank")
    spark = docs.sparkSession
    steps = Steps(spark, "resample")
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target)).orderBy("bucket").collect()  # BUCKETS rows
    shared = spark.sparkContext.broadcast(GainPlanes(np.array([r.gain for r in gains], dtype=np.int64)))
    names = [c for c in docs.columns if c != "text"]
    columns = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = columns.schema["row"].dataType.simpleString()
    weighed = columns.mapInArrow(_weigh(shared), f"row {kind}, n_words long, n_features long, weight long")
    id_of = F.col("row").getField("doc_id")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_of.cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = steps.write(weighed.withColumn("score", F.col("weight") + noise), "scored")
    drawn_from = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    n = scored.where(drawn_from).count() * percent // 100
    candidates = scored.where(drawn_from).withColumns({"_id": id_of, "_tie": F.xxhash64("row", "weight")})
    ranked = running(candidates, [F.desc("score"), "_id", "_tie"], row_number="_rank")
    ranked = ranked.select(*scored.columns, F.when(F.col("_rank") <= n, F.col("_rank")).alias("rank"))
    others = scored.where(~drawn_from).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select(
        *[F.col("row").getField(c).alias(c) for c in names], "n_words", "n_features", "weight", "score", "rank")
