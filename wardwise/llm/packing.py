"""Best-fit packing of documents into training sequences, with conflicts between documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.llm import ngram_join, tokens
from wardwise.llm.common import Steps

#: Words of a sequence.
CAPACITY = 2048
#: Pieces that one task packs together; the number of such shards grows with the input.
SHARD_PIECES = 4096
PACKED = "doc_id long, piece long, first_word long, n_words long, bin_id long, bin_words long, bin_pieces long"


def _count(batches):
    for batch in batches:
        n = [np.bincount(run.words(tokens.byte_table("space"))[2], minlength=run.last - run.first) for run in tokens.runs(batch.column(3))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(np.concatenate(n) if n else np.zeros(0, dtype=np.int64), pa.int64())],
            names=["doc_id", "source", "cluster", "n"],
        )


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def near_copy_clusters(docs: DataFrame, steps: Steps) -> DataFrame:
    """(cluster, component) of every text that has a document with id: ``cluster`` is its MD5, ``component`` the smallest id among its near copies, linked over others."""
    marks = ngram_join.join_near_copies(docs.select("doc_id", _text().alias("text")))
    own = marks.groupBy(F.col("digest").alias("cluster")).agg(F.min("component_id").cast("string").alias("component"))
    return steps.write(own.where("component is not null"), "clusters")


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, source, cluster, piece, first_word and n_words: whole documents, or consecutive pieces of at most ``capacity`` words.

    ``cluster`` is a column of ``docs`` if it has one, else a hash of the text, equal for copies.
    """
    text = _text()
    cluster = F.col("cluster").cast("string") if "cluster" in docs.columns else F.xxhash64(text).cast("string")
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"), text.alias("text"))
    counted = columns.mapInArrow(_count, "doc_id long, source string, cluster string, n long")
    last = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)) - 1
    each = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("piece") * capacity
    return each.select("doc_id", "source", "cluster", "piece", first.alias("first_word"), F.least(F.col("n") - first, F.lit(capacity)).alias("n_words"))


def _bitmaps(codes: np.ndarray, once_matters: bool) -> np.ndarray:
    """A bitmap row for each piece with the bit of its value; values that cannot repeat need none (and code -1 means no value)."""
    values, inverse, often = np.unique(codes, return_inverse=True, return_counts=True)
    needed = (values >= 0) & ((often > 1) | once_matters)
    bit = np.where(needed, np.cumsum(needed) - 1, -1)[inverse]
    out = np.zeros((len(codes), max(1, -(-int(needed.sum()) // 64))), dtype=np.uint64)
    rows = np.flatnonzero(bit >= 0)
    out[rows, bit[rows] // 64] = np.uint64(1) << (bit[rows] % 64).astype(np.uint64)
    return out


def best_fit(sizes: np.ndarray, bits: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, taken in the given order.

    Open bins are kept in the order of their room, then of their number. The search starts at the first bin with enough room and goes on to
    its successors until one carries none of the piece's bits: that is the tightest compatible bin. Otherwise a bin is opened.
    """
    n = len(sizes)
    out = np.zeros(n, dtype=np.int64)
    room, number = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    carried = np.zeros((0, bits.shape[1]), dtype=np.uint64)
    opened = 0
    for k in range(n):
        at, found = int(np.searchsorted(room, sizes[k])), -1
        step = 64
        while at < len(room) and found < 0:
            free = ~(carried[at : at + step] & bits[k]).any(axis=1)
            hit = int(free.argmax())
            found = at + hit if free[hit] else -1
            at, step = at + step, step * 2
        if found < 0:
            left, own, mark = capacity - sizes[k], opened, bits[k].copy()
            opened += 1
        else:
            left, own, mark = room[found] - sizes[k], number[found], carried[found] | bits[k]
            room, number, carried = np.delete(room, found), np.delete(number, found), np.delete(carried, found, axis=0)
        out[k] = own
        lo, hi = np.searchsorted(room, left), np.searchsorted(room, left, side="right")
        to = lo + int(np.searchsorted(number[lo:hi], own))
        room, number, carried = np.insert(room, to, left), np.insert(number, to, own), np.insert(carried, to, mark, axis=0)
    return out


def _pack(capacity: int):
    def pack(shard: pa.Table) -> pa.Table:
        t = shard.to_pandas().sort_values(["n_words", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
        code = lambda c: t[c].astype("category").cat.codes.to_numpy(dtype=np.int64)
        # Pieces of one document conflict as well, whatever its cluster column says.
        bits = np.hstack([_bitmaps(code("source"), False), _bitmaps(code("cluster"), False), _bitmaps(code("doc_id"), False)])
        sizes = t["n_words"].to_numpy(dtype=np.int64)
        bins = best_fit(sizes, bits, capacity)
        words, count = np.bincount(bins, sizes).astype(np.int64), np.bincount(bins)
        number = t["shard"].to_numpy(dtype=np.int64) * (1 << 32) + bins
        order = pa.array(t.index.to_numpy())
        column = lambda c: shard.column(c).take(order)
        return pa.table({
            "doc_id": column("doc_id"), "piece": column("piece"), "first_word": column("first_word"), "n_words": column("n_words"),
            "bin_id": pa.array(number), "bin_words": pa.array(words[bins]), "bin_pieces": pa.array(count[bins]),
        })

    return pack


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, near_copies: bool = False) -> DataFrame:
    """doc_id, piece, first_word, n_words, bin_id, bin_words and bin_pieces: every piece of every document in one bin.

    A bin holds at most ``capacity`` words, and no two pieces of one source, of one duplicate cluster or of one document. Documents longer than a
    bin are cut, their full pieces fill bins alone. Pieces are dealt by hash into shards of about ``shard_pieces``, so that any source or
    cluster spreads evenly, and each shard is packed in one task, largest pieces first, into its tightest compatible bin.
    Bins carry bitmaps of the shard's sources, clusters and documents.
    A NULL source conflicts with nothing; NULL and empty texts have one piece without words, which conflicts as any other; repeated rows are
    documents of one cluster; an empty table gives an empty result. Other columns are ignored.
    With ``near_copies`` a cluster is a component of near copies (``ngram_join``) instead of one text; of the texts, only those of its candidates are shuffled.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "packing")
    if near_copies:
        clusters = near_copy_clusters(docs, steps)
        docs = docs.withColumn("cluster", F.md5(_text()))
    own = pieces(docs, capacity)
    if near_copies:
        own = own.join(clusters, "cluster", "left").withColumn("cluster", F.coalesce("component", "cluster")).select(*own.columns)
    own = steps.write(own, "pieces")
    shards = max(1, -(-own.count() // shard_pieces))
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(capacity), PACKED)
