"""Comparison of all rows that share a bucket, in blocks of bounded size, without emitting pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket that one block takes from each side.
CHUNK = 512


def bucket_blocks(rows: DataFrame, same_members_once: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Rows (bucket, id, ...) of every bucket with two rows or more, with block columns i, j and part.

    A bucket of over ``chunk`` rows is cut into parts by the id's hash, and every pair of parts (i, j) is a block of its own,
    so no task gets more than two parts at once and every pair of rows meets in exactly one block of the bucket.
    ``same_members_once`` keeps one of all buckets with the same members.
    """
    many = rows.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("members")
    ).where("size > 1")
    if same_members_once:
        many = many.groupBy("size", "least", "members").agg(F.min("bucket").alias("bucket"))
    parts = F.ceil(F.col("size") / chunk).cast("int")
    own = rows.join(many.select("bucket", parts.alias("parts")), "bucket")
    own = own.withColumn("part", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.col("parts")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.select(*rows.columns, "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def compare_blocks(rows: DataFrame, compare, schema: str) -> DataFrame:
    """Calls ``compare`` with the rows of each block (bucket, i, j) as one Arrow table. Blocks are brought together by sorting, so
    a task holds one block at a time."""
    keys = ["bucket", "i", "j"]

    def stream(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(c[a] for c in cols)
                if key != last and held:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from compare(pa.Table.from_batches(held))

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


LINKS = "id long, root long, n long"


def link_rows(ids: np.ndarray, weights: np.ndarray, p: np.ndarray, q: np.ndarray):
    """For linked rows ``p`` and ``q`` of a block: each row's number of links, and the smallest id that it reaches here."""
    if not len(p):
        return
    n = np.bincount(p, weights[q], len(ids)) + np.bincount(q, weights[p], len(ids))
    root = ids.copy()
    while True:
        low = np.minimum(root[p], root[q])
        before = root.copy()
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        if (before == root).all():
            break
    hit = n > 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[hit]), pa.array(root[hit]), pa.array(n[hit].astype(np.int64))], names=["id", "root", "n"]
    )


def linked(rows: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (id, rep, copies, ...) with n_links, component_id and kept: copies link each other and what their representative links."""
    total = links.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("_n"))
    out = rows.join(total, "rep", "left").join(roots.select(F.col("node").alias("rep"), F.col("root").alias("_root")), "rep", "left")
    component = F.coalesce("_root", "rep")
    return out.select(
        *rows.columns, (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("_n", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
