"""The registered queries of this subpackage, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from wardwise.llm import decontaminate, embed_dedup, licenses, ngram_join, packing, pii, quality, resample, secrets, spelling, substring, toxicity, warc
from wardwise.llm.common import Steps, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return wrap


@query(
    "op9_substring_dedup",
    """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 1) + 1)) AS i FROM t),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS h FROM p WHERE i + 12 <= len(w)),
lo AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, i FROM win JOIN lo USING (h) WHERE doc_id > lo),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range(0, 13)) AS k) s)
SELECT p.doc_id, CAST(max(len(w)) AS BIGINT) AS n_words, CAST(count(gone.i) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN gone.i IS NULL THEN w[p.i] END, ' ' ORDER BY p.i), '')) AS kept_sha256
FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY p.doc_id
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query(
    "op10_decontaminate",
    """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS h FROM bi),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS h
  FROM dp, (SELECT DISTINCT n FROM bw) s WHERE i + n - 1 <= len(w)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, h)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, (SELECT unnest(range(0, 13)) AS k) s WHERE k < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = found.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(ids, 256).alias("items_sha256"))
    return hit.withColumn("contaminated", decontaminate.contaminated(F.col("n_hit"), F.col("n_words")))


def digest(spans):
    """SHA-256 of kind:start:end, comma-joined."""
    return F.sha2(written(spans), 256)


def written(spans):
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def kind_counts(spans, kinds):
    def own(kind: str):
        return lambda s: s["kind"] == kind

    return [F.size(F.filter(spans, own(kind))).cast("long").alias(f"n_{kind}") for kind in kinds]


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["base"])
    return found.select("doc_id", *kind_counts(base, secrets.KINDS), digest(base).alias("base_sha256"), written("secrets").alias("spans"), "layers")


@query(
    "op5_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT i, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', i + 1, 1) AS letter FROM (SELECT unnest(range(0, 32)) AS i) s),
n AS (SELECT page_id, g, """
    + " + ".join(f"(strpos('0123456789abcdef', substr(hex, 5 * g + {k}, 1)) - 1) * {16 ** (5 - k)}" for k in range(1, 6))
    + """ AS bits FROM p, (SELECT unnest(range(0, 8)) AS g) s),
d AS (SELECT page_id, string_agg(letter, '' ORDER BY g, k) AS payload_digest
  FROM n, (SELECT unnest(range(0, 4)) AS k) s, b WHERE b.i = (bits // CAST(pow(32, 3 - k) AS BIGINT)) % 32 GROUP BY page_id),
f AS (SELECT p.page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
    min(p.page_id) OVER (PARTITION BY html) AS first FROM p JOIN d ON d.page_id = p.page_id)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Steps(spark, "warc")
    archive = f"{steps.folder}/archive"
    warc.write_warc(warc.plan_records(table(spark, sf_dir, "pages")), archive)
    full = warc.read_warc(spark, archive).where("record_type = 'response'")
    short = warc.read_warc(spark, archive, payload=False).where("record_type = 'revisit'")
    columns = lambda size, digest: (
        warc.page_of("record_id").alias("page_id"), size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type",
        warc.page_of("refers_to").alias("refers_to"))
    read = full.select(*columns(F.octet_length("payload"), warc.base32_sha1(F.col("payload"))))
    return read.union(short.select(*columns(F.col("payload_bytes"), F.col("payload_digest"))))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *kind_counts(F.col("base_spans"), pii.KINDS), digest("base_spans").alias("base_sha256"), written("pii_spans").alias("spans"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.score_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted", "ratio")


def components_sql(links: str, nodes: str) -> str:
    """Views ``walk`` and ``root``: the smallest node that each node of ``nodes`` reaches by the pairs (a, b) of ``links``, both ways."""
    return f"""
walk(a, b) AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT walk.a, {links}.b FROM walk JOIN {links} ON walk.b = {links}.a),
root AS (SELECT a AS id, min(b) AS root FROM walk GROUP BY a)"""


@query(
    "op1_ngram_join",
    """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS hits FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * hits >= 8 * (x.n + y.n - hits)),
node AS (SELECT doc_id AS id FROM documents),"""
    + components_sql("link", "node")
    + """,
k AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, root AS component_id, id = root AS kept FROM root LEFT JOIN k ON k.a = id
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_near_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("digest")


@query(
    "op7_embedding_dedup",
    """
WITH RECURSIVE c AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings),
l AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS norm FROM c GROUP BY vec_id),
d AS (SELECT x.vec_id AS a, y.vec_id AS b, sum(CAST(x.x AS DOUBLE) * CAST(y.x AS DOUBLE)) AS dot FROM c x JOIN c y
  ON x.label = y.label AND x.i = y.i AND x.vec_id <> y.vec_id GROUP BY x.vec_id, y.vec_id),
link AS (SELECT a, b FROM d JOIN l x ON x.vec_id = a JOIN l y ON y.vec_id = b WHERE dot / (x.norm * y.norm) >= 0.98),
node AS (SELECT vec_id AS id FROM embeddings),"""
    + components_sql("link", "node")
    + """,
k AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, root AS component_id, id = root AS kept FROM root LEFT JOIN k ON k.a = id
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), near_copies=True)


def license_templates() -> str:
    """The templates as rows of a VALUES list."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ",\n".join(f"({i}, {quoted(t.label)}, {t.base}, {quoted(t.text)})" for i, t in enumerate(licenses.TEMPLATES))


ALNUM_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    "op11_license_scan",
    f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
t(template, label, base, text) AS (VALUES {license_templates()}),
tw AS (SELECT template, label, base, {ALNUM_WORDS} AS w FROM t),
tk AS (SELECT *, CASE WHEN base THEN len(w) ELSE least(len(w), {licenses.GRAM}) END AS k FROM tw),
tg AS (SELECT template, label, base, k, len(w) AS words, i - 1 AS place, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM tk) q),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dg AS (SELECT doc_id, i - 1 AS pos, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM dp, (SELECT DISTINCT k FROM tg) s WHERE i + k - 1 <= len(w)),
hit AS (SELECT doc_id, template, label, base, k, words, place, pos, pos - place AS diagonal FROM dg JOIN tg USING (k, gram)),
far AS (SELECT doc_id, template, diagonal,
    CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {licenses.SLACK} THEN 0 ELSE 1 END AS far
  FROM (SELECT DISTINCT doc_id, template, diagonal FROM hit) q),
own AS (SELECT doc_id, template, diagonal, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS spot FROM far),
placed AS (SELECT hit.*, spot FROM hit JOIN own USING (doc_id, template, diagonal)),
found AS (SELECT doc_id, template, label, base, words, spot, count(*) AS votes, min(pos) AS start, max(pos) AS last, max(pos) + k AS stop
  FROM placed GROUP BY doc_id, template, label, base, words, k, spot),
cover AS (SELECT doc_id, template, spot, count(DISTINCT place + j) AS covered FROM placed, (SELECT unnest(range(0, 16)) AS j) s WHERE j < k
  GROUP BY doc_id, template, spot),
f AS (SELECT *, CAST(covered AS DOUBLE) / words AS coverage,
    base OR (CAST(covered AS DOUBLE) / words >= {licenses.LEAST} AND covered >= {licenses.DENSE} * (stop - start)) AS verified
  FROM found JOIN cover USING (doc_id, template, spot)),
r AS (SELECT doc_id, sum(votes) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(last) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(coverage) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("license_spans", lambda s: s["base"])
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.aggregate(base, F.lit(0).cast("long"), lambda n, s: n + s["votes"]).alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"), F.array_max(F.transform(base, lambda s: s["last"])).alias("last_word"),
        labels.alias("base_labels"), F.array_join("licenses", ",").alias("labels"), F.col("license_score").alias("score"))


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``, whose letters are below U+0800 or so read; ``crc`` is the view of ``CRC_TABLE``."""
    return (
        f"xor(list_reduce(list_concat([4294967295], CAST(flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] "
        "WHEN ord(c) < 2048 THEN [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] WHEN ord(c) < 65536 THEN [224 + (ord(c) >> 12), 128 + ((ord(c) >> 6) & 63), "
        "128 + (ord(c) & 63)] ELSE [240 + (ord(c) >> 18), 128 + ((ord(c) >> 12) & 63), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)] END)) AS BIGINT[])), "
        "lambda x, y: xor(x >> 8, steps[(xor(x, y) & 255) + 1])), 4294967295)"
    )


CRC_TABLE = """crc AS (SELECT list(x ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_concat([i], range(8)),
  lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM (SELECT unnest(range(256)) AS i) q) r)"""


@query(
    "op12_spelling_variants",
    f"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents),
p AS (SELECT doc_id, run, count(*) AS n FROM o WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, n, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM p, crc),
t AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
g AS (SELECT word, n, concat(substr(word, 1, i - 1), '_', substr(word, i + 1)) AS one, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS less FROM i),
e AS (SELECT x.word AS a, y.word AS b, y.n FROM g x JOIN g y ON x.one = y.one AND x.word <> y.word
  UNION SELECT x.word, v.word, v.n FROM g x JOIN v ON x.less = v.word UNION SELECT v.word, x.word, x.n FROM g x JOIN v ON x.less = v.word),
k AS (SELECT a, count(*) AS n_near, min([lpad(CAST(1000000000 - n AS VARCHAR), 12, '0'), b]) AS best, max(n) AS near_n FROM e GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN best[2] END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM v LEFT JOIN k ON k.a = v.word),
walk(word, root) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, f.form_n, walk.root FROM f JOIN walk ON walk.word = f.word
JOIN f last ON last.word = walk.root AND last.form IS NULL
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op13_resample",
    f"""
WITH {CRC_TABLE},
t AS (SELECT doc_id, 0 AS target, {ALNUM_WORDS} AS w FROM documents UNION ALL SELECT item_id, 1, {ALNUM_WORDS} FROM benchmark),
p AS (SELECT doc_id, target, w, unnest(range(1, len(w) + 1)) AS i FROM t),
f AS (SELECT doc_id, target, array_to_string(list_slice(w, i, i + k - 1), ' ') AS feature FROM p, (SELECT unnest(range(1, 4)) AS k) s WHERE i + k - 1 <= len(w)),
b AS (SELECT feature, CAST({crc32_sql("feature")} % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT feature FROM f) q, crc),
c AS (SELECT doc_id, target, bucket, count(*) AS n FROM f JOIN b USING (feature) GROUP BY doc_id, target, bucket),
s AS (SELECT bucket, CAST(sum(n) FILTER (target = 0) AS DOUBLE) AS s, CAST(sum(n) FILTER (target = 1) AS DOUBLE) AS t FROM c GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM s),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (all_t + 10000)))) AS gain FROM s, a),
w AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM c JOIN g USING (bucket) WHERE target = 0 GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS n_words, CAST(concat('0x', substr(sha256(concat('42:', doc_id)), 1, 8)) AS BIGINT) AS h FROM t WHERE target = 0),
r AS (SELECT h.doc_id, n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM h LEFT JOIN w ON w.doc_id = h.doc_id),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN o.rank <= 5 * o.n // 100 THEN CAST(o.rank AS BIGINT) END AS rank FROM r LEFT JOIN o ON o.doc_id = r.doc_id
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark")).drop("n_words")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
