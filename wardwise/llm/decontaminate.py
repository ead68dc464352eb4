"""Benchmark decontamination: a prefix-filtered join of documents with item-sized windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.llm import tokens
from wardwise.llm.common import Steps, without

SIZE = 13
SHINGLE = 4
#: Windows of the benchmark that one pass over the documents compares; more are taken in further passes.
BLOCK_WINDOWS = 200_000


def _words(run: tokens.Run):
    begin, end, of = run.words(tokens.byte_table("alnum"))
    return begin, of, run.word_hashes(begin, end, fold=tokens.LOWER)


def _item_windows(size: int, shingle: int):
    """Every window of every item: its words' hashes, and the hashes of the shingles in it."""

    def rows(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for run in tokens.runs(batch.column(1)):
                    _, of, hashes = _words(run)
                    items, words, grams = [], [], []
                    for i in range(run.last - run.first):
                        own = hashes[np.searchsorted(of, i) : np.searchsorted(of, i, side="right")]
                        n = min(size, len(own))
                        k = min(shingle, n)
                        if not n:
                            continue
                        _, g = tokens.windows(own, np.zeros(len(own)), k, seed=4)
                        for p in range(len(own) - n + 1):
                            items.append(ids[run.first + i])
                            words.append(own[p : p + n].view(np.int64).tolist())
                            grams.append(g[p : p + n - k + 1].view(np.int64).tolist())
                    longs = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(items, pa.int64()), pa.array(words, longs), pa.array(grams, longs)], names=["item_id", "words", "grams"]
                    )

    return rows


def _gram_counts(grams, lengths):
    """How often each of the benchmark's shingles occurs, summed for each batch of documents."""

    def rows(batches):
        known = grams.value
        with np.errstate(over="ignore"):
            for batch in batches:
                total = np.zeros(len(known), dtype=np.int64)
                for run in tokens.runs(batch.column(0)):
                    _, of, hashes = _words(run)
                    for k in lengths:
                        _, h = tokens.windows(hashes, of, k, seed=4)
                        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        total += np.bincount(place[known[place] == h], minlength=len(known))
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(known[seen].view(np.int64)), pa.array(total[seen])], names=["h", "n"])

    return rows


class _Block:
    """Windows of one block, ordered by the hash of their prefix token."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r.h)
        self.prefix = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64)
        order = np.argsort(self.prefix, kind="stable")
        rows = [rows[i] for i in order]
        self.prefix = self.prefix[order]
        self.item = np.array([r.item_id for r in rows], dtype=np.int64)
        self.offset = np.array([r.offset for r in rows], dtype=np.int64)
        self.length = np.array([len(r.words) for r in rows], dtype=np.int64)
        self.words = np.zeros((len(rows), max((len(r.words) for r in rows), default=0)), dtype=np.uint64)
        for i, r in enumerate(rows):
            self.words[i, : len(r.words)] = np.array(r.words, dtype=np.int64).view(np.uint64)


def _find(block: _Block, of: np.ndarray, hashes: np.ndarray, lengths, n_texts: int):
    """(first word, window) of every occurrence of a block's windows."""
    first_word = np.searchsorted(of, np.arange(n_texts))
    last_word = np.searchsorted(of, np.arange(n_texts), side="right")
    starts, wins = [], []
    for k in lengths:
        at, h = tokens.windows(hashes, of, k, seed=4)
        lo, hi = np.searchsorted(block.prefix, h), np.searchsorted(block.prefix, h, side="right")
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        win = np.repeat(lo[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(at[found], count) - block.offset[win]
        text = np.repeat(of[at[found]], count)
        # The token lies in the text at the window's own place: that bounds where the window starts and ends.
        fits = (start >= first_word[text]) & (start + block.length[win] <= last_word[text])
        start, win = start[fits], win[fits]
        for j in range(block.words.shape[1]):
            same = (block.length[win] <= j) | (hashes[np.minimum(start + j, len(hashes) - 1)] == block.words[win, j])
            start, win = start[same], win[same]
        starts.append(start)
        wins.append(win)
    pairs = np.unique(np.stack([np.concatenate(starts), np.concatenate(wins)], axis=1), axis=0) if starts else np.zeros((0, 2), dtype=np.int64)
    return pairs[:, 0], pairs[:, 1]


def _probe(shared, lengths):
    """Adds a block's occurrences to what earlier blocks have found: word spans that are hit, and items."""

    def rows(batches):
        block = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                n_words, spans, items = [], [], []
                spans_before, items_before = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for run in tokens.runs(batch.column(1)):
                    _, of, hashes = _words(run)
                    n = run.last - run.first
                    start, win = _find(block, of, hashes, lengths, n)
                    first_word = np.searchsorted(of, np.arange(n))
                    text = of[start] if len(start) else np.zeros(0, dtype=np.int64)
                    cut = np.searchsorted(text, np.arange(n + 1))
                    n_words.extend(np.bincount(of, minlength=n).tolist())
                    for i in range(n):
                        s, w = start[cut[i] : cut[i + 1]], win[cut[i] : cut[i + 1]]
                        flat = np.stack([s - first_word[i], s - first_word[i] + block.length[w]], axis=1)
                        spans.append(_merge(np.concatenate([np.array(spans_before[run.first + i] or [], dtype=np.int64).reshape(-1, 2), flat])))
                        items.append(sorted(set(items_before[run.first + i] or []) | set(block.item[w].tolist())))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, longs), pa.array(items, longs)],
                    names=["row", "text", "n_words", "spans", "items"],
                )

    return rows


def _merge(spans: np.ndarray) -> list[int]:
    """Disjoint spans with the same words, as a flat list."""
    if not len(spans):
        return []
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], reach[last]], axis=1).ravel().tolist()


def benchmark_windows(benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, grams): word hashes and shingle hashes of every window of every item."""
    columns = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return columns.where("item_id is not null").mapInArrow(
        _item_windows(size, shingle), "item_id long, words array<long>, grams array<long>"
    ).distinct()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """The columns of ``docs`` with n_words, spans and items: which words lie in windows of which benchmark items.

    Words are lower-cased (A-Z) runs of letters and digits; an item's windows are its ``size`` consecutive
    words, or all of a shorter item. Each window's shingles are ordered by how rare they are in all
    documents. A window can only occur where all its shingles do, so its prefix is the rarest one alone, and a
    window with a shingle that no document holds is dropped. Documents are joined on the prefix; the token's
    place gives the window's start, which must lie inside the text, and all words are compared.

    ``spans`` holds first and past-the-last words of hit stretches, flat; ``items`` the sorted item ids.
    The windows are compared in blocks of at most ``block_windows``: that bounds what is sent to every task, and
    a larger benchmark takes more passes. NULL or empty texts have no words and no hits, NULL item ids are ignored,
    repeated rows are judged each by themselves, an empty benchmark hits nothing.
    """
    docs = without(docs, "n_words", "spans", "items")
    spark = docs.sparkSession
    steps = Steps(spark, "decontaminate")
    row_of = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    longs = "array<long>"
    state = docs.select(
        row_of, F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast(longs).alias("spans"), F.lit(None).cast(longs).alias("items"),
    )
    wins = steps.write(benchmark_windows(benchmark, size, shingle), "windows")
    lengths = [r[0] for r in wins.select(F.least(F.size("words"), F.lit(shingle)).alias("k")).distinct().collect()]
    blocks = max(1, -(-wins.count() // block_windows))
    schema = spark.createDataFrame([], state.schema).schema
    for b in range(blocks):
        own = wins.where(F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)) == b)
        grams = np.unique(np.array([r[0] for r in own.select(F.explode("grams")).distinct().collect()], dtype=np.int64).view(np.uint64))
        if not len(grams):
            grams = np.zeros(1, dtype=np.uint64)
        known = spark.sparkContext.broadcast(grams)
        texts = docs.select(F.col("text").cast("string").alias("text"))
        rarity = texts.mapInArrow(_gram_counts(known, lengths), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        places = own.select("item_id", "words", F.size("grams").alias("size"), F.posexplode("grams").alias("offset", "h"))
        ranked = (
            places.join(rarity, "h").groupBy("item_id", "words", "size")
            .agg(F.count("*").alias("seen"), F.min(F.struct("n", "offset", "h")).alias("rarest"))
            .where("seen = size").select("item_id", "words", "rarest.offset", "rarest.h")
        )
        block = spark.sparkContext.broadcast(_Block(ranked.collect()))
        state = state.mapInArrow(_probe(block, lengths), schema)
        if b + 1 < blocks:
            state = steps.write(state, f"state{b}")
            steps.drop(f"state{b - 1}")
    names = [c for c in docs.columns if c != "text"]
    return state.select(
        *[F.col("row").getField(c).alias(c) for c in names], "text", "n_words",
        F.coalesce("spans", F.array().cast(longs)).alias("spans"), F.coalesce("items", F.array().cast(longs)).alias("items"),
    )


def n_hit(spans: str = "spans"):
    """Number of words in flat spans."""
    size = F.size(spans)
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0).cast("long"),
        lambda total, i: total + F.when(i > size, 0).when(i % 2 == 0, F.get(spans, i - 1)).otherwise(-F.get(spans, i - 1)),
    )


def contaminated(hit, words):
    """The rule of contamination: at least a twentieth of the words is hit."""
    return (hit > 0) & (20 * hit >= words)


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()
