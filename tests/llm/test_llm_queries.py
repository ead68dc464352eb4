"""The registered queries on the generic tables: against SQL, plain versions, or held-out labels."""

import brute
import checks
import pytest

from wardwise.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(name, spark, sf_dir):
    assert checks.compare(queries.QUERIES[name](spark, sf_dir), checks.connect(sf_dir), queries.SQL[name]) is None


@pytest.mark.parametrize(("name", "plain"), [("op2_pii", brute.pii), ("op4_secret_scan", brute.secrets)])
def test_base_spans(name, plain, spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == brute.digest(want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


@pytest.mark.parametrize(("name", "label", "least"), [("op6_quality_classifier", "quality", 0.85), ("op8_toxicity", "toxic", 0.85)])
def test_held_out_ranking(name, label, least, spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in queries.QUERIES[name](spark, sf_dir).where("held_out").collect() if r.doc_id in labels]
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) >= least


def test_packing_rules(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_best_fit_packing"](spark, sf_dir).collect()
    bins, words = {}, dict.fromkeys(docs, 0)
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        words[r.doc_id] += r.n_words
    assert all(words[i] == len((d.text or "").split()) for i, d in docs.items())
    for own in bins.values():
        assert sum(r.n_words for r in own) == own[0].bin_words <= 2048 and len(own) == own[0].bin_pieces
        assert len({docs[r.doc_id].source for r in own}) == len(own) == len({docs[r.doc_id].text for r in own})


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns
        sizes.append(out.count())
        docs = out
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
    assert all(not brute.pii(r.text) for r in docs.collect())
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert packed == {r.doc_id for r in docs.collect()}
