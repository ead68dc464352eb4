"""Spelling variant grouping: PartEnum signatures of letter multisets, joined on equal keys and verified by edit distance."""

from __future__ import annotations

import re
import zlib
from functools import cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.llm.common import Steps

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: One in so many occurrences of the contract's corpus is misspelt on purpose.
TYPO = 31
#: Parts of the letter vector: of words of one length, two parts may differ; of words whose length differs by one, one part.
PARTS_SAME = 5
PARTS_NEXT = 3
#: Words that a task counts before it hands the counts on.
HELD = 200_000

MASK = (1 << 64) - 1
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def typo(word: str, crc: int) -> str:
    """The word without one letter, if TYPO divides the hash of its occurrence."""
    if crc % TYPO:
        return word
    at = crc % len(word)
    return word[:at] + word[at + 1 :]


def _counts(batches):
    """(word, n) of a task's texts; the counts are handed on whenever HELD words are held."""
    find = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}").findall
    held: dict[str, int] = {}

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            lead = zlib.crc32(f"{doc.as_py() or ''}:".encode())
            seen: dict[str, int] = {}
            for word in find((text.as_py() or "").encode().translate(LOWER).decode()):
                seen[word] = seen.get(word, 0) + 1
            for word, n in seen.items():
                out = typo(word, zlib.crc32(word.encode(), lead))
                if len(out) >= LEAST_LETTERS:
                    held[out] = held.get(out, 0) + n
            if len(held) >= HELD:
                yield rows()
                held.clear()
    yield rows()


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): words of LEAST_LETTERS letters or more that occur LEAST_COUNT times or more in all texts.

    A word is a maximal run of A-Z, a-z and the letters U+00C0 to U+00FF of which only A-Z are lower-cased. The occurrences of a word in one document share
    one hash, the CRC-32 of ``<doc_id>:<word>``; where TYPO divides it, they lose one letter.
    """
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    counted = texts.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


@cache
def _dimension(letter: str, k: int) -> int:
    """A fixed random value for the k-th occurrence of a letter."""
    x = (ord(letter) << 20 | k) * 0x9E3779B97F4A7C15 & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def _part_values(word: str, parts: int) -> list[int]:
    """The letter multiset as a binary vector, one dimension for each occurrence of a letter, cut into parts: the dimensions set in each part."""
    values, seen = [0] * parts, {}
    for c in word:
        k = seen[c] = seen.get(c, -1) + 1
        values[(ord(c) + 2 * k) % parts] ^= _dimension(c, k)
    return values


def _keys(word: str, short: int, parts: int, gone: int) -> list[int]:
    """Signatures of a word among words of which the shorter has ``short`` letters: the parts left when ``gone`` are taken away, with either half of the word.

    One letter replaced changes two dimensions, one put in or out a single one; so some choice of parts to take away leaves the rest equal. One
    edit leaves the first or the second half of the word as it is, too.
    """
    values = _part_values(word, parts)
    total = 0
    for v in values:
        total ^= v
    half = short // 2
    sides = (zlib.crc32(word[:half].encode()) * 2, zlib.crc32(word[len(word) - (short - half) :].encode()) * 2 + 1)
    keys = []
    for number, taken in enumerate(combinations(range(parts), gone)):
        rest = total
        for i in taken:
            rest ^= values[i]
        for side in sides:
            x = (rest + (side * 64 + short) * 64 + number) * 0x9E3779B97F4A7C15 & MASK
            x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & MASK
            keys.append((x ^ x >> 32) - (1 << 63))
    return keys


def _signatures(batches):
    for batch in batches:
        words = batch.column(0).to_pylist()
        longs = pa.list_(pa.int64())
        same = pa.array([_keys(w, len(w), PARTS_SAME, 2) for w in words], longs)
        following = pa.array([_keys(w, len(w), PARTS_NEXT, 1) + _keys(w, len(w) - 1, PARTS_NEXT, 1) for w in words], longs)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), same, following], names=["word", "n", "same", "next"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): all pairs of words one edit apart, each once."""
    signed = words.mapInArrow(_signatures, "word string, n long, same array<long>, next array<long>")
    keyed = lambda c, longer: F.transform(c, lambda k: F.struct(k.alias("key"), F.lit(longer).alias("longer")))
    rows = signed.select("word", "n", F.explode(F.concat(keyed("same", 0), keyed("next", 1))).alias("s")).select("s.key", "s.longer", "word", "n")
    a, b = rows.alias("a"), rows.alias("b")
    order = F.when(F.col("a.longer") == 1, F.length("b.word") - F.length("a.word") == 1).otherwise(F.col("a.word") < F.col("b.word"))
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.longer") == F.col("b.longer")) & order & (F.levenshtein("a.word", "b.word", 1) == 1))
    return found.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")).distinct()


def follow(forms: DataFrame, steps: Steps) -> DataFrame:
    """(word, root): where each word of (word, form) ends. The pointers double in each round, so rounds grow with the logarithm of the longest chain."""
    ptr, k = steps.write(forms.select("word", F.col("form").alias("root")), "root0"), 0
    while True:
        further = ptr.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = ptr.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        k += 1
        new = steps.write(moved, f"root{k}")
        steps.drop(f"root{k - 1}")
        ptr = new.select("word", "root")
        if new.where("moved").isEmpty():
            return ptr


def group_variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word that ``corpus_words`` finds in ``docs`` (doc_id, text).

    Words are near if they differ by one code point put in, left out or replaced. Their letter multisets, read as binary vectors, then differ in two
    places at most. ``near_pairs`` cuts the vectors into parts and enumerates the parts that may differ; what is left, with one half of
    the word, is a key. Words that share a key are joined by Spark and verified in the join, so pairs that fail are never emitted, and a key with
    many words is split over tasks as any skewed join is. A word's form is the near word of largest n (ties: the smallest by code points),
    if that is ``ratio`` times its own or more; root follows the forms to the last one.

    NULL and empty texts have no words; a NULL id is read as an empty one; every repeated row counts; other columns are ignored; without texts the result is empty.
    """
    steps = Steps(docs.sparkSession, "spelling")
    words = steps.write(corpus_words(docs), "words")
    pairs = steps.write(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    form = (-F.col("best.less")) >= ratio * F.col("n")
    formed = steps.write(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"),
        F.when(form, -F.col("best.less")).alias("form_n")), "formed")
    roots = follow(formed.where("form is not null"), steps)
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
