"""Spelling variants, license scans and resampling: small and odd cases against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardwise.llm import licenses, queries, resample, spelling, tokens

DOCS = "doc_id long, text string, lang string"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """The rows, with columns that results use as names."""
    clash = {c: F.lit("mine") for c in ("row", "n_words", "grams", "id", "score", "rank", "weight", "word", "n", "licenses")}
    return spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).withColumns(clash)


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


# ---------------------------------------------------------------- licenses
MIT = licenses.TEMPLATES[4].text
LICENSED = [
    (1, None), (2, ""), (3, " \t"), (4, "MIT License, mit-license; Mit  LICENSE mit licensed"), (4, "MIT License, mit-license; Mit  LICENSE mit licensed"),
    (None, "the apache license"), (5, "intro words here " + MIT + " and more"), (6, MIT.replace("merge, ", "").replace("publish", "print it out")),
    (7, " ".join(MIT.split()[:20])), (8, "GNU general public\nlicense general public license"), (9, "mit " * 50_000 + "license"), (10, "apache licensé general public"),
    (11, "Licensed under CC BY-NC 4.0."), (12, " ".join(sorted(MIT.split()))),
]


def test_licenses(spark):
    found = licenses.scan_licenses(docs_of(spark, LICENSED))
    rows = {}
    for r in found.collect():
        base = [s for s in r.license_spans if s.base]
        rows.setdefault(r.doc_id, []).append((sum(s.votes for s in base), min((s.start for s in base), default=None), max((s["last"] for s in base), default=None), ",".join(r.licenses), r))
    for i, text in LICENSED:
        w = plain_words(text)
        at = [k for k in range(len(w)) for p in (["mit", "license"], ["apache", "license"], ["general", "public", "license"]) if w[k : k + len(p)] == p]
        for r in rows[i]:
            assert r[0] == len(at) and r[1] == (min(at) if at else None) and r[2] == (max(at) if at else None) and r[4].n_words == len(w)
            assert 0 <= r[4].license_score <= 1
    labels = {i: own[0][3] for i, own in rows.items()}
    assert len(rows[4]) == 2 and labels[4] == "mit" and labels[None] == "apache" and labels[8] == "gpl" and labels[11] == "cc"
    # The whole text and one with words left out and put in are found; its first words, and its words in another order, are not.
    assert labels[5] == labels[6] == "mit" and labels[7] == labels[12] == "" and 0 < rows[7][0][4].license_score < licenses.LEAST
    (span,) = rows[5][0][4].license_spans
    assert (span.start, span.end, span.coverage) == (3, 3 + len(plain_words(MIT)), 1.0)
    assert licenses.scan_licenses(docs_of(spark, LICENSED).limit(0)).collect() == []
    assert all(r.license_spans == [] and r.license_score == 0 for r in licenses.scan_licenses(docs_of(spark, LICENSED), templates=()).collect())


def test_only_equal_words_vote(spark, monkeypatch):
    """With hashes that all collide, the words of the gram still decide."""
    real = licenses._grams
    monkeypatch.setattr(licenses, "_grams", lambda run, sizes: (lambda at, size, h, of, words: (at, size, h * 0, of, words))(*real(run, sizes)))
    known = licenses.TemplateGrams(licenses.TEMPLATES)
    rows = known.frame(spark).select("h", "gram")
    assert rows.select("h").distinct().count() == 1 and rows.where("gram = 'mit license'").count() == 1


# ---------------------------------------------------------------- spelling
def plain_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w, k in n.items():
        close = sorted((-n[v], v) for v in n if near(w, v))
        form = close[0][1] if close and -close[0][0] >= 10 * k else None
        out[w] = (k, len(close), form)

    def root(w):
        return root(out[w][2]) if out[w][2] else w

    return {w: (k, c, f, n[f] if f else None, root(w)) for w, (k, c, f) in out.items()}


def test_variants_against_all_pairs(spark):
    """Chains of forms, ties, letters beyond ASCII, one-letter changes of all kinds, long words."""
    r = random.Random(11)
    base = ["".join(r.choice("abcdeéàß×mnop") for _ in range(r.randrange(7, 12))) for _ in range(25)] + ["x" * 3000, "y" * 7, "abcdefg"]
    words = []
    for w in base:
        words += [w] * r.choice([2, 3, 40, 400])
        for _ in range(6):
            k = r.randrange(len(w))
            words += [r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcé") + w[k + 1 :], w[:k] + r.choice("abcé") + w[k:]])] * r.choice([1, 2, 3, 30])
    words += ["quixotry"] * 500 + ["quixotrys"] * 40 + ["quixotryst"] * 3  # a chain of two forms
    r.shuffle(words)
    rows = [(i, " ".join(words[i::40]).upper() if i % 2 else ", ".join(words[i::40])) for i in range(40)]
    rows += [(None, "abcdefg ABCDEFG"), (41, None), (42, ""), (43, "123 中"), (3, rows[3][1])]
    got = {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in spelling.group_variants(docs_of(spark, rows)).collect()}
    want = plain_variants(rows)
    assert got == want and any(v[2] and want[v[2]][2] for v in want.values())
    assert spelling.group_variants(docs_of(spark, rows).limit(0)).collect() == []


def test_signatures_meet_for_every_edit():
    """Any two words one edit apart share a key, whatever the letters."""
    r = random.Random(2)
    for _ in range(400):
        w = "".join(r.choice("abzé") for _ in range(r.randrange(7, 15)))
        k = r.randrange(len(w) + 1)
        longer = w[:k] + r.choice("abc") + w[k:]
        same = w[: k - 1] + "q" + w[k:] if k else "q" + w[1:]
        keys = lambda v, short, parts, gone: set(spelling._keys(v, short, parts, gone))
        assert keys(w, len(w), spelling.PARTS_SAME, 2) & keys(same, len(w), spelling.PARTS_SAME, 2)
        assert keys(w, len(w), spelling.PARTS_NEXT, 1) & keys(longer, len(w), spelling.PARTS_NEXT, 1)


# -------------------------------------------------------------- resampling
def plain_features(text):
    w = plain_words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_feature_buckets():
    import numpy as np
    import pyarrow as pa

    texts = ["", "one", "Ärger über ß-words 12 x", "a " * 30, "w" * 200 + " " + "v" * 47 + " " + "u" * 48 + " " + "t" * 49 + " a", "中文 x \U0001f600y"]
    for run in tokens.runs(pa.array([*texts, None])):
        of, buckets, n = resample.features(run)
        for i, t in enumerate(texts):
            want = Counter(zlib.crc32(f.encode()) % resample.BUCKETS for f in plain_features(t))
            assert Counter(buckets[of == i].tolist()) == want and n[i] == len(plain_words(t))
        assert n[-1] == 0 and np.all(of < len(texts))


def test_planes_weigh_exactly():
    import numpy as np

    rng = np.random.default_rng(0)
    gains = rng.integers(-30_000, 30_000, resample.BUCKETS)
    gains[:3] = 0, -(2**15), 2**15
    texts = np.sort(rng.integers(0, 1300, 60_000))
    buckets = rng.integers(0, 40, 60_000) * 7 % resample.BUCKETS
    want = np.bincount(texts, gains[buckets], 1301).astype(int)
    assert (resample.GainPlanes(gains).weights(texts, buckets, 1301) == want).all()
    assert (resample.GainPlanes(np.zeros(resample.BUCKETS, dtype=int)).weights(texts, buckets, 1301) == 0).all()


def test_resampling(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(r.choice([5, 25, 60])))) for i in range(200)]
    rows += [(None, "word " * 30), (7, rows[7][1]), (500, None), (501, ""), (502, "zz " * 30_000)]
    target = spark.createDataFrame([(1, "aa bb aa bb zz"), (2, None)], "item_id long, text string")
    got = resample.resample(docs_of(spark, rows), target, percent=10).collect()
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(zlib.crc32(f.encode()) % 10_000 for f in plain_features(text))
    t.update(zlib.crc32(f.encode()) % 10_000 for f in plain_features("aa bb aa bb zz"))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = Counter((i, len(plain_features(x)), sum(gain(zlib.crc32(f.encode()) % 10_000) for f in plain_features(x))) for i, x in rows)
    assert Counter((x.doc_id, x.n_features, x.weight) for x in got) == want
    drawn = sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])
    able = [x for x in got if x.doc_id is not None and x.n_words >= 20]
    assert [x["rank"] for x in drawn] == list(range(1, len(able) // 10 + 1))
    assert [(x.score, x.doc_id) for x in drawn] == [(x.score, x.doc_id) for x in sorted(able, key=lambda x: (-x.score, x.doc_id))[: len(drawn)]]
    assert all(x.score is None and x["rank"] is None for x in got if x.doc_id is None)
    assert resample.resample(docs_of(spark, rows).limit(0), target).collect() == []
    assert len(resample.resample(docs_of(spark, rows), target.limit(0)).collect()) == len(rows)


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_spelling_variants", "op13_resample"])
def test_columns(name, spark, sf_dir):
    want = {"op11_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score", "op12_spelling_variants": "word form root n n_near form_n",
            "op13_resample": "doc_id n_features weight score rank"}[name]
    assert set(want.split()) <= set(queries.QUERIES[name](spark, sf_dir).columns)
