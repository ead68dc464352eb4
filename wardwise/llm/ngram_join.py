"""N-gram Jaccard join: MinHash candidates, dropped as the posterior falls, the rest verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.llm import tokens
from wardwise.llm.blocks import LINKS, bucket_blocks, compare_blocks, link_rows, linked
from wardwise.llm.common import Steps, components

SHINGLE = 5
SIMILARITY = 0.8
#: Documents are compared if all ROWS hashes of one of BANDS bands agree.
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: A pair is dropped when the posterior probability of reaching the similarity falls below this.
TOLERANCE = 1e-5


def shingles(run: tokens.Run, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of all ``size``-word shingles; a shorter text with words is one shingle."""
    begin, end, of = run.words(tokens.byte_table("space"))
    h = run.word_hashes(begin, end)
    at, full = tokens.windows(h, of, size, seed=5)
    n = np.bincount(of, minlength=run.last - run.first)
    owner = [of[at]]
    parts = [full]
    first = np.searchsorted(of, np.arange(run.last - run.first))
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            at_k, h_k = tokens.windows(h, of, k, seed=5)
            place = np.searchsorted(at_k, first[short])
            parts.append(h_k[place])
            owner.append(short)
    values, owners = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return values[order], owners[order]


def _signatures(batches):
    """Per document the low bytes of its MinHash values, and one hash for each band; texts without words have none."""
    a, b = tokens.constants(11, HASHES) | np.uint64(1), tokens.constants(12, HASHES)
    with np.errstate(over="ignore"):
        for batch in batches:
            sigs, keys = [], []
            for run in tokens.runs(batch.column(1)):
                n = run.last - run.first
                h, of = shingles(run)
                low = np.zeros((n, HASHES), dtype=np.uint32)
                some = np.bincount(of, minlength=n) > 0
                if len(h):
                    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    for k in range(HASHES):
                        low[of[first], k] = np.minimum.reduceat((h * a[k] + b[k]) >> np.uint64(32), first)
                band = np.zeros((n, BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    band = tokens.mix(band * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS])
                band = tokens.mix(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                tiny = (low & 0xFF).astype(np.uint8)
                for i in range(n):
                    sigs.append(tiny[i].tobytes() if some[i] else None)
                    keys.append(band[i] if some[i] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "digest", "sig", "keys"],
            )


def least_matches(similarity: float, tolerance: float) -> dict[int, int]:
    """After so many compared hashes, the fewest matches with which a pair may still reach the similarity.

    Posterior of the Jaccard similarity under a uniform prior; one byte of a hash also agrees by chance.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    agree = grid + (1 - grid) / 256
    out = {}
    for m in range(BANDS, HASHES + 1, BANDS):
        for c in range(m + 1):
            logs = c * np.log(agree) + (m - c) * np.log1p(-agree)
            p = np.exp(logs - logs.max())
            if p[grid >= similarity].sum() / p.sum() >= tolerance:
                out[m] = c
                break
    return out


def _candidates(similarity: float, tolerance: float):
    need = least_matches(similarity, tolerance)

    def compare(block: pa.Table):
        column = lambda name: block.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        ids = column("id")
        sig = np.frombuffer(b"".join(column("sig")), dtype=np.uint8).reshape(len(ids), HASHES)
        if block.column("i")[0].as_py() != block.column("j")[0].as_py():
            part = column("part")
            left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
            if part.min() == part.max():
                return
            p, q = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        else:
            p, q = np.triu_indices(len(ids), 1)
        matches, done = np.zeros(len(p), dtype=np.int16), 0
        for m, least in need.items():
            for a in range(0, len(p), 1 << 16):
                s = slice(a, a + (1 << 16))
                matches[s] += (sig[p[s], done:m] == sig[q[s], done:m]).sum(axis=1, dtype=np.int16)
            alive = matches >= least
            p, q, matches, done = p[alive], q[alive], matches[alive], m
        yield from link_rows(ids, np.ones(len(ids)), p, q)

    return compare


def _verify(similarity: float):
    """Exact Jaccard of all pairs of a block, from counts of common shingles."""

    def compare(block: pa.Table):
        column = lambda name: block.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        ids, weights = column("id"), column("copies")
        if len(ids) < 2:
            return
        cross = column("part") if block.column("i")[0].as_py() != block.column("j")[0].as_py() else None
        with np.errstate(over="ignore"):
            values, owners = [], []
            for run in tokens.runs(block.column("text")):
                h, of = shingles(run)
                values.append(h)
                owners.append(of + run.first)
        values, owners = np.concatenate(values), np.concatenate(owners)
        order = np.lexsort((values, owners))
        values, owners = values[order], owners[order]
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])])[: len(values)]
        values, owners = values[new], owners[new]
        size = np.bincount(owners, minlength=len(ids))
        _, code, often = np.unique(values, return_inverse=True, return_counts=True)
        shared = often[code] > 1
        _, code = np.unique(code[shared], return_inverse=True)
        owners = owners[shared]
        common = np.zeros((len(ids), len(ids)), dtype=np.float32)
        order = np.argsort(code, kind="stable")
        code, owners = code[order], owners[order]
        for a in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            lo, hi = np.searchsorted(code, [a, a + 4096])
            part = np.zeros((len(ids), 4096), dtype=np.float32)
            part[owners[lo:hi], code[lo:hi] - a] = 1
            common += part @ part.T
        union = size[:, None] + size[None, :] - common
        link = np.triu((common > 0) & (common >= similarity * union - 1e-9 * union), 1)
        if cross is not None:
            link &= cross[:, None] != cross[None, :]
        yield from link_rows(ids, weights, *np.nonzero(link))

    return compare


def join_near_copies(docs: DataFrame, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, n_links, component_id, kept and digest (MD5 of the text) for every row: documents linked by the Jaccard similarity of their word shingles.

    Words are runs of anything but ASCII blanks, unchanged; shingles are SHINGLE consecutive words, a shorter text is one.
    Equal texts are represented by their smallest id, so copies are never expanded into pairs. Representatives that share a
    MinHash band are compared byte by byte of their signatures, and a pair is dropped as soon as the posterior probability of reaching
    ``similarity`` falls below ``tolerance``. The survivors' components are then verified: exact Jaccard of all pairs in them, in blocks.
    A pair at 0.8 shares a band with probability 0.99995. ``n_links`` counts other documents linked directly, copies included;
    ``component_id`` is the smallest id that is reachable, ``kept`` marks the row that stays (its own component_id).
    NULL, empty and blank texts have no shingles and link with nothing; so do rows without doc_id (never kept). Rows that share a
    doc_id are documents of their own, but one node of a component. Other columns are ignored.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "ngrams")
    columns = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.md5("text").alias("digest"))
    signed = columns.mapInArrow(_signatures, "id long, digest string, sig binary, keys array<long>")
    signed = steps.write(signed, "signatures")
    some = signed.where("sig is not null and id is not null")
    classes = steps.write(some.groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "classes")
    rows = classes.select(F.explode("keys").alias("bucket"), F.col("rep").alias("id"))
    blocks = bucket_blocks(rows, same_members_once=True).join(classes.select(F.col("rep").alias("id"), "sig").dropDuplicates(["id"]), "id")
    maybe = steps.write(compare_blocks(blocks, _candidates(similarity, tolerance), LINKS), "maybe")
    groups = steps.write(components(maybe.select(F.col("id").alias("a"), F.col("root").alias("b")), steps, "maybe"), "groups")
    active = groups.select(F.col("root").alias("bucket"), F.col("node").alias("id"))
    wanted = active.select("id").join(classes.select(F.col("rep").alias("id"), "digest", "copies"), "id")
    texts = columns.join(wanted, ["id", "digest"]).dropDuplicates(["id", "digest"])
    pairs = bucket_blocks(active).join(texts.select("id", "text", "copies"), "id")
    links = steps.write(compare_blocks(pairs, _verify(similarity), LINKS), "links")
    roots = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), steps, "links")
    members = signed.join(classes.select("digest", "rep", "copies"), "digest", "left")
    own = F.col("sig").isNotNull() & F.col("id").isNotNull()
    rows = members.select("id", F.when(own, F.col("rep")).otherwise(F.col("id")).alias("rep"), F.when(own, F.col("copies")).otherwise(1).alias("copies"), "digest")
    return linked(rows, links, roots).select(F.col("id").alias("doc_id"), "n_links", "component_id", "kept", "digest")
