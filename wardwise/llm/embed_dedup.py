"""Near-duplicate embeddings: randomly rotated binary codes estimate inner products, doubtful pairs are computed exactly."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.llm.blocks import LINKS, bucket_blocks, compare_blocks, link_rows, linked
from wardwise.llm.common import Steps, components

THRESHOLD = 0.98
#: A band is BITS bits of the codes; vectors are compared if they agree in one of BANDS bands.
BITS, BANDS = 16, 20
#: Standard errors of the estimate within which a pair is computed exactly.
CONFIDENCE = 4.0


def rotations(dims: int) -> np.ndarray:
    """As many random rotations as the bands need bits, side by side: dims x (rotations * dims)."""
    rng = np.random.default_rng(dims)
    n = -(-BITS * BANDS // dims)
    return np.hstack([np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(n)])


def _encode(batches):
    """Whether each row can link at all, a digest of its vector, and its bands' bits."""
    turned: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, labels, vectors = (batch.column(i) for i in range(3))
        n = batch.num_rows
        good, digests, keys, dims = np.zeros(n, dtype=bool), [None] * n, [None] * n, np.zeros(n, dtype=np.int32)
        by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i in range(n):
            if not (ids[i].is_valid and labels[i].is_valid and vectors[i].is_valid) or vectors[i].values.null_count:
                continue
            v = vectors[i].values.to_numpy(zero_copy_only=False)
            if len(v) and np.isfinite(v).all() and v.any():
                by_dim.setdefault(len(v), []).append((i, v.astype(np.float64)))
        for d, rows in by_dim.items():
            if d not in turned:
                turned[d] = rotations(d)
            bits = (np.stack([v / np.abs(v).max() for _, v in rows]) @ turned[d])[:, : BITS * BANDS] >= 0
            values = bits.reshape(len(rows), BANDS, BITS) @ (1 << np.arange(BITS))
            for (i, v), key in zip(rows, values, strict=True):
                good[i], digests[i], keys[i], dims[i] = True, hashlib.md5(v.tobytes()).digest(), key.tolist(), d
        yield pa.RecordBatch.from_arrays(
            [ids, labels, pa.array(good), pa.array(dims), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int32())), vectors],
            names=["id", "label", "good", "dims", "digest", "keys", "embedding"],
        )


def candidate_pairs(x: np.ndarray, cosine: float, cross: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors that may reach the threshold by their codes' estimates.

    A code is the signs of the rotated vector; the factor stored with it, the code's own inner product with its vector,
    makes the estimate of another vector's inner product unbiased and gives its standard error.
    """
    d = x.shape[1]
    turned = x @ rotations(d)
    n = turned.shape[1] // d
    codes = np.where(turned >= 0, 1.0, -1.0) / np.sqrt(d)
    factor = (codes * turned).reshape(len(x), n, d).sum(2)
    scaled = (codes.reshape(len(x), n, d) / factor[:, :, None]).reshape(len(x), n * d)
    estimate = turned @ scaled.T / n
    error = np.sqrt(((1 - factor**2).clip(0) / factor**2).sum(1)) / n / np.sqrt(max(d - 1, 1))
    maybe = np.triu(estimate + CONFIDENCE * error[None, :] >= cosine, 1) | np.triu((estimate + CONFIDENCE * error[None, :] >= cosine).T, 1)
    if cross is not None:
        maybe &= cross[:, None] != cross[None, :]
    return np.nonzero(maybe)


def _compare(cosine: float):
    def compare(block: pa.Table):
        column = lambda name: block.column(name).combine_chunks()
        whole = lambda name: column(name).to_numpy(zero_copy_only=False)
        ids, weights, label, dims, band = (whole(c) for c in ("id", "copies", "label", "dims", "band"))
        if len(ids) < 2:
            return
        part = whole("part") if block.column("i")[0].as_py() != block.column("j")[0].as_py() else None
        keys = np.stack(list(whole("keys")))
        vectors = list(whole("embedding"))
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            x = np.stack([vectors[i] for i in own]).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            p, q = candidate_pairs(x / norm[:, None], cosine, part[own] if part is not None else None)
            b = band[own]
            same = (label[own][p] == label[own][q]) & (b[p] == b[q]) & (keys[own][p, b[p]] == keys[own][q, b[p]])
            p, q = p[same], q[same]
            close = np.zeros(len(p), dtype=bool)
            for a in range(0, len(p), 1 << 16):
                s = slice(a, a + (1 << 16))
                close[s] = np.einsum("ij,ij->i", x[p[s]], x[q[s]]) / (norm[p[s]] * norm[q[s]]) >= cosine
            p, q = p[close], q[close]
            # A pair counts in the first band that it shares.
            first = (keys[own][p] == keys[own][q]).argmax(axis=1) == b[p]
            yield from link_rows(ids[own], weights[own], p[first], q[first])

    return compare


def link_embeddings(vectors: DataFrame, cosine: float = THRESHOLD) -> DataFrame:
    """The rows' vec_id with n_links, component_id and kept: vectors of one label that link by cosine.

    Equal vectors of a label are represented by the one of smallest id. Representatives that share a band of their codes are compared
    in blocks: estimates and their confidence bounds drop pairs, the others are computed in double precision. Every link is counted once and no
    pair is emitted: blocks return each row's number of links and a spanning forest. A pair at the threshold shares a band with
    probability 0.9998, closer pairs more surely (tests measure the recall).
    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without label or id, link with nothing; vectors
    of different lengths never link. Rows that share a vec_id count as vectors of their own but as one node of a component. Other columns are ignored.
    """
    spark = vectors.sparkSession
    steps = Steps(spark, "embeddings")
    columns = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding")
    kind = columns.schema["embedding"].dataType.simpleString()
    coded = steps.write(
        columns.mapInArrow(_encode, f"id long, label long, good boolean, dims int, digest binary, keys array<int>, embedding {kind}"), "codes")
    group = ["label", "dims", "digest"]
    classes = steps.write(coded.where("good").groupBy(*group).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("embedding").alias("embedding")), "classes")
    bands = classes.select(F.col("rep").alias("id"), *group, "copies", "keys", F.posexplode("keys").alias("band", "bits"))
    rows = bands.select(F.xxhash64("label", "dims", "band", "bits").alias("bucket"), F.col("id"), "digest", "band")
    blocks = bucket_blocks(rows)
    alive = blocks.join(classes.withColumnRenamed("rep", "id"), ["id", "digest"])
    links = steps.write(compare_blocks(alive, _compare(cosine), LINKS), "links")
    roots = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), steps)
    members = coded.join(classes.select(*group, "rep", "copies"), group, "left")
    rows = members.select("id", F.when(F.col("good"), F.col("rep")).otherwise(F.col("id")).alias("rep"),
                          F.when(F.col("good"), F.col("copies")).otherwise(1).alias("copies"))
    return linked(rows, links, roots).select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")
