"""License scans: hashes of rolling word grams joined to template positions, voting for the diagonals on which a template lies."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardwise.llm import tokens
from wardwise.llm.common import Steps, without

GRAM = 3
#: Diagonals at most so many words apart are one place: words were put in or left out between their votes.
SLACK = 4
#: Share of a template's words, and of the place's words, that must be covered.
LEAST = 0.6
DENSE = 0.5


class Template(NamedTuple):
    name: str
    label: str
    base: bool
    text: str


# Base phrases with their labels, and the notices of common licenses.
TEMPLATES = (
    Template("mit_phrase", "mit", True, "mit license"),
    Template("apache_phrase", "apache", True, "apache license"),
    Template("gpl_phrase", "gpl", True, "general public license"),
    Template("cc_phrase", "cc", False, "licensed under cc by"),
    Template("mit", "mit", False, (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    )),
    Template("isc", "isc", False, (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    )),
    Template("bsd", "bsd", False, (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    )),
    Template("apache", "apache", False, (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
        "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
        "License."
    )),
    Template("gpl", "gpl", False, (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    )),
    Template("mpl", "mpl", False, (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    )),
    Template("unlicense", "unlicense", False, (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."
    )),
)


def _grams(run: tokens.Run, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First word, size and hash of every gram, the text of every word, and the words' places."""
    begin, end, of = run.words(tokens.byte_table("alnum"))
    hashes = run.word_hashes(begin, end, fold=tokens.LOWER)
    at, size, h = [], [], []
    for k in sizes:
        first, own = tokens.windows(hashes, of, k, seed=6)
        at.append(first)
        size.append(np.full(len(first), k))
        h.append(own)
    return np.concatenate(at), np.concatenate(size), np.concatenate(h), of, (tokens.LOWER[run.data], begin, end)


def _gram_text(words, first: int, size: int) -> str:
    data, begin, end = words
    return b" ".join(data[begin[j] : end[j]].tobytes() for j in range(first, first + size)).decode("utf-8", "replace")


class TemplateGrams:
    """Positions of all templates' grams, and a sparse map of the bits that their hashes set.

    The map has 64 to 128 bits a gram, so a hash of other words passes it once in some 64 times at most, whatever the number of templates.
    """

    def __init__(self, templates, gram: int = GRAM):
        self.rows = []
        hashes = [np.zeros(0, dtype=np.uint64)]
        with np.errstate(over="ignore"):
            for number, t in enumerate(templates):
                for run in tokens.runs(pa.array([t.text])):
                    n = len(run.words(tokens.byte_table("alnum"))[0])
                    if not n:
                        continue
                    k = n if t.base else min(gram, n)
                    at, _, h, _, words = _grams(run, [k])
                    hashes.append(h)
                    self.rows += [
                        (int(x), _gram_text(words, int(p), k), number, t.label, t.base, int(p), k, n)
                        for x, p in zip(h.view(np.int64), at, strict=True)
                    ]
        self.sizes = sorted({r[6] for r in self.rows})
        every = np.concatenate(hashes)
        self.shift = np.uint64(64 - max(6, (64 * len(every)).bit_length()))
        self.map = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.map[every >> self.shift] = True

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "h long, gram string, template int, label string, base boolean, place int, size int, words int")


def _passing(shared):
    """Number of words of each text, and its grams that pass the templates' map."""

    def rows(batches):
        known = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                n_words, counts, pos, hashes, texts = [], [], [], [], []
                for run in tokens.runs(batch.column(1)):
                    n = run.last - run.first
                    at, size, h, of, words = _grams(run, known.sizes) if known.sizes else _grams(run, [1])
                    keep = np.flatnonzero(known.map[h >> known.shift])
                    keep = keep[np.lexsort((size[keep], at[keep]))]
                    first = np.searchsorted(of, np.arange(n))
                    n_words.append(np.bincount(of, minlength=n))
                    counts.append(np.bincount(of[at[keep]], minlength=n))
                    pos.append(at[keep] - first[of[at[keep]]])
                    hashes.append(h[keep].view(np.int64))
                    texts += [_gram_text(words, int(a), int(k)) for a, k in zip(at[keep], size[keep], strict=True)]
                flat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(flat(counts))])
                gram = pa.StructArray.from_arrays(
                    [pa.array(flat(pos)), pa.array(flat(hashes)), pa.array(texts, pa.string())], names=["pos", "h", "gram"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(flat(n_words)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), gram)],
                    names=["row", "n_words", "grams"])

    return rows


def diagonals(hits: DataFrame) -> DataFrame:
    """(id, template, label, base, diagonal, votes, places, start, last, end, size, words) of each diagonal with votes."""
    return hits.groupBy("id", "template", "label", "base", "size", "words", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.collect_list("place").alias("places"),  # as many as the template has grams at most
        F.min("pos").alias("start"), F.max("pos").alias("last"))


def merge_neighbours(votes: DataFrame, slack: int = SLACK) -> DataFrame:
    """One row per place: neighbouring diagonals of one text and template together, with the share of the template's words that they cover."""
    own = Window.partitionBy("id", "template").orderBy("diagonal")  # the diagonals of one text
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > slack, F.lit(True))
    numbered = votes.withColumn("far", far.cast("int")).withColumn("place", F.sum("far").over(own))
    whole = numbered.groupBy("id", "template", "label", "base", "size", "words", "place").agg(
        F.sum("votes").alias("votes"), F.flatten(F.collect_list("places")).alias("places"), F.min("start").alias("start"), F.max("last").alias("last"))
    words_at = lambda p: F.sequence(p, p + F.col("size") - 1)
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct("places"), words_at))))
    end = (F.col("last") + F.col("size")).alias("end")
    return whole.select("id", "label", "base", "votes", "start", "last", end, "words", covered.alias("covered"), (covered / F.col("words")).alias("coverage"))


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, gram: int = GRAM, slack: int = SLACK, least: float = LEAST, dense: float = DENSE
) -> DataFrame:
    """The columns of ``docs`` but text, with n_words, license_spans, licenses and license_score.

    Words are lower-cased (A-Z) runs of letters and digits. The grams of ``gram`` words of every text (and of the lengths of base phrases and shorter templates) are hashed as they
    roll; those whose hash passes a sparse map of the templates' hashes are stored with their words and joined to the templates' positions, on the hash
    and on the words, so no two different grams ever match. Each match votes for a diagonal, the text's place less the template's. Neighbouring
    diagonals of one template, at most ``slack`` apart, are one place; it is verified if its grams cover ``least`` of the template's words and
    make up ``dense`` of the words between its first and its last. A base phrase is one gram, so each of its places
    is a vote, and all votes count.

    ``license_spans`` holds the verified places with label, base, votes, start, last (the start of the last vote), end (words, exclusive) and coverage,
    by start; ``licenses`` their labels, sorted; ``license_score`` the best coverage of any place, verified or not, and 0 without one.
    The template table is read from storage, so Spark sends it to all tasks if it is small, and shuffles the stored grams if not.
    NULL and empty texts have no words and no places; repeated rows and rows without id are scanned each by themselves; without templates nothing is found.
    """
    docs = without(docs, "n_words", "license_spans", "licenses", "license_score")
    spark = docs.sparkSession
    steps = Steps(spark, "licenses")
    known = TemplateGrams(templates, gram)
    names = [c for c in docs.columns if c != "text"]
    columns = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = columns.schema["row"].dataType.simpleString()
    passing = columns.mapInArrow(
        _passing(spark.sparkContext.broadcast(known)), f"row {kind}, n_words long, grams array<struct<pos:long,h:long,gram:string>>")
    # The row number is written with the row: whoever reads it later sees the same one.
    seen = steps.write(passing.withColumn("id", F.monotonically_increasing_id()), "seen")
    places = steps.write(known.frame(spark), "templates")
    hits = seen.select("id", F.explode("grams").alias("g")).select("id", "g.*").join(places, ["h", "gram"])
    found = merge_neighbours(diagonals(hits), slack)
    verified = F.col("base") | (F.col("coverage") >= least) & (F.col("covered") >= dense * (F.col("end") - F.col("start")))
    span = F.struct("start", "end", "label", F.col("base"), "votes", "last", "coverage")
    by_row = found.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(verified, span))).alias("license_spans"), F.max("coverage").alias("license_score"))
    out = seen.drop("grams").join(by_row, "id", "left")
    empty = F.array().cast(by_row.schema["license_spans"].dataType)
    spans = F.coalesce("license_spans", empty)
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in names], "n_words", spans.alias("license_spans"),
        F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))).alias("licenses"),
        F.coalesce("license_score", F.lit(0.0)).alias("license_score"),
    )
