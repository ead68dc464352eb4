"""Removal of word passages that an earlier document already holds, by level-wise doubling."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.llm import tokens
from wardwise.llm.common import Steps

SIZE = 13
OCCURRENCE = "h long, doc long"


def _anchors(hashes: np.ndarray, text_of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the ``size``-word windows, the word where each one's anchor starts, and the anchors' hashes by word.

    A window's anchor is its half-length window of the smallest hash, so equal windows have equal anchors.
    """
    half = size // 2
    at, _ = tokens.windows(hashes, text_of, size)
    by_word = np.full(len(hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
    short, h = tokens.windows(hashes, text_of, half, seed=3)
    by_word[short] = h
    if not len(at):
        return at, at, by_word
    span = np.lib.stride_tricks.sliding_window_view(by_word, size - half + 1)
    return at, at + span[at].argmin(axis=1), by_word


def _member(values: np.ndarray, of: np.ndarray, lists: pa.Array, run: tokens.Run) -> np.ndarray:
    """Whether each value, belonging to text ``of`` of the run, is in that text's list."""
    part = lists.slice(run.first, run.last - run.first)
    have = np.asarray(part.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
    lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(part)), lengths)
    own = lambda v, o: v ^ tokens.mix(o.astype(np.uint64) + np.uint64(1))
    return np.isin(own(values, of), own(have, owner))


def _words(run: tokens.Run):
    begin, end, of = run.words(tokens.byte_table("space"))
    return begin, end, of, run.word_hashes(begin, end)


def _pairs(h: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Distinct (hash, document) pairs."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(doc[keep])], names=["h", "doc"])


def _half_level(size: int):
    def rows(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for run in tokens.runs(batch.column(1)):
                    _, _, of, hashes = _words(run)
                    _, anchor, by_word = _anchors(hashes, of, size)
                    anchor = np.unique(anchor)
                    yield _pairs(by_word[anchor], ids[run.first + of[anchor]])

    return rows


def _extended(size: int):
    """Windows of the whole length whose half-length anchor is repeated."""

    def rows(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for run in tokens.runs(batch.column(1)):
                    _, _, of, hashes = _words(run)
                    at, anchor, by_word = _anchors(hashes, of, size)
                    alive = _member(by_word[anchor], of[at], batch.column(2), run)
                    _, full = tokens.windows(hashes, of, size)
                    yield _pairs(full[alive], ids[run.first + of[at[alive]]])

    return rows


def _doubled(size: int):
    """Windows of twice the length whose both halves are repeated."""

    def rows(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for run in tokens.runs(batch.column(1)):
                    _, _, of, hashes = _words(run)
                    at, h = tokens.windows(hashes, of, size // 2)
                    alive = np.zeros(len(hashes) + size, dtype=bool)
                    alive[at] = _member(h, of[at], batch.column(2), run)
                    long, full = tokens.windows(hashes, of, size)
                    keep = alive[long] & alive[long + size // 2]
                    yield _pairs(full[keep], ids[run.first + of[long[keep]]])

    return rows


def _cut(size: int):
    """Covers the words of the listed windows and returns counts and what is left."""

    def rows(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                n_words, n_removed, kept, digest = [], [], [], []
                for run in tokens.runs(batch.column(1)):
                    begin, end, of, hashes = _words(run)
                    at, h = tokens.windows(hashes, of, size)
                    hit = at[_member(h, of[at], batch.column(2), run)]
                    cover = np.zeros(len(begin) + 1, dtype=np.int64)
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + size, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    n = run.last - run.first
                    n_words.append(np.bincount(of, minlength=n))
                    n_removed.append(np.bincount(of[gone], minlength=n))
                    b, e, o = begin[~gone], end[~gone], of[~gone]
                    step = np.zeros(len(run.data) + 1, dtype=np.int8)
                    step[b] += 1
                    step[e] -= 1
                    keep = np.cumsum(step[:-1], dtype=np.int8) > 0
                    gap = b[1:][o[1:] == o[:-1]] - 1  # one blank before each kept word but the first
                    keep[gap] = True
                    data = run.data.copy()
                    data[gap] = 0x20
                    left = data[keep].tobytes()
                    ends = np.concatenate([[0], np.cumsum(keep)])[run.starts]
                    for i in range(n):
                        text = left[ends[i] : ends[i + 1]]
                        kept.append(text.decode("utf-8", "replace"))
                        digest.append(hashlib.sha256(text).hexdigest())
                flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), flat(n_words), flat(n_removed), pa.array(kept, pa.string()), pa.array(digest, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    return rows


def _repeated(found: DataFrame, later_only: bool) -> DataFrame:
    """(doc, hs): per document those of its windows that more than one document holds, or that an earlier one holds."""
    span = found.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h", "lo")
    hits = found.join(span, "h")
    if later_only:
        hits = hits.where("doc > lo")
    return hits.groupBy("doc").agg(F.collect_list("h").alias("hs"))


def repeated_windows(docs: DataFrame, steps: Steps, size: int = SIZE) -> DataFrame:
    """(doc, hs): hashes of each document's ``size``-word windows that start in a document of smaller id.

    Level one takes windows of half the length, one anchor for each whole window (the anchor of the
    smallest hash, about a quarter of all positions). Only windows whose anchor more than one document
    holds are extended to twice that length, the whole window, and compared again.
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")
    half = steps.write(_repeated(columns.mapInArrow(_half_level(size), OCCURRENCE), later_only=False), "half")
    alive = columns.join(half, "doc").select("doc", "text", "hs")
    whole = steps.write(alive.mapInArrow(_extended(size), OCCURRENCE), "whole")
    steps.drop("half")
    out = steps.write(_repeated(whole, later_only=True), "later")
    steps.drop("whole")
    return out


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Removes every word that lies in a ``size``-word window which also starts in a document of smaller doc_id.

    Words are runs of anything but ASCII blanks, unchanged. Windows are judged on the input, not on what
    is left. Returns one row per input row: doc_id, n_words, n_removed, kept_text (the words left, joined
    by one blank) and kept_sha256. A NULL or empty text has no words; shorter texts lose nothing. Rows that
    share a doc_id are not earlier than each other, and each gets its own row. A row without doc_id loses
    nothing and takes nothing from others. An empty table gives an empty result, other columns are ignored.
    Windows are told apart by 64-bit hashes.
    """
    steps = Steps(docs.sparkSession, "substring")
    later = repeated_windows(docs, steps, size)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    marked = columns.join(later, "doc", "left").select("doc", "text", "hs")
    return marked.mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def longest_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, longest): for each document with a repeated window, the longest length that the doubling reached.

    Continues from ``size``: windows whose both halves are repeated are extended to twice the length, until none survive.
    """
    steps = Steps(docs.sparkSession, "doubling")
    columns = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")
    half = steps.write(_repeated(columns.mapInArrow(_half_level(size), OCCURRENCE), later_only=False), "half")
    whole = columns.join(half, "doc").select("doc", "text", "hs").mapInArrow(_extended(size), OCCURRENCE)
    alive = steps.write(_repeated(whole, later_only=False), f"level{size}")
    steps.drop("half")
    reached = alive.select("doc", F.lit(size).alias("length"))
    while not alive.isEmpty():
        size *= 2
        longer = columns.join(alive, "doc").select("doc", "text", "hs").mapInArrow(_doubled(size), OCCURRENCE)
        alive = steps.write(_repeated(longer, later_only=False), f"level{size}")
        reached = reached.union(alive.select("doc", F.lit(size).alias("length")))
    return reached.groupBy(F.col("doc").alias("doc_id")).agg(F.max("length").cast("long").alias("longest"))
