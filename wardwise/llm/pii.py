"""Personal data: high-recall candidate spans, boosted trees on format and context, calibrated selection.

All of it is DataFrame and SQL functions, so that the texts never leave the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwise.llm.common import without

#: Kinds in their listed order.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats and the look-behind only spare retries that cannot match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",  # runs of fewer digits fail the check and touch no other run
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns of the same kinds: written-out or broken-up forms.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[\x20-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: A match of a pattern holds one of these; texts without any are passed over.
NEEDS = {
    BASE["email"]: ("@",), BASE["phone"]: ("+",),
    WIDE["email"]: ("(at)", "[at]"), WIDE["ip"]: ("[.]", "(.)", " . "),
}
CONTEXT = r"(?i)\b(?:e-?mail|mail|contact|write|reach|call|phone|tel|mobile|fax|card|visa|credit|payment|ip|host|address|server)\b"
#: Characters of context before a candidate.
BEFORE = 24
#: Share of true candidates that a selected score must reach among the held-out ones.
PRECISION = 0.9
FEATURES = ("kind", "digits", "separators", "context", "left", "right", "length")
_SIZES = (4, 6, 4, 2, 4, 4, 6)
#: At most this many different feature vectors exist; model and selection are sized by it.
MAX_KEYS = 4 * 6 * 4 * 2 * 4 * 4 * 6


def _spans(text: Column, pattern: str) -> Column:
    """Array of (value, start, end) of a pattern's matches: the pieces between matches give the places."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["piece"])
        b = a + F.length(pair["value"])
        one = F.struct(pair["value"].alias("value"), a.alias("start"), b.alias("end"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # The last piece follows the last match.
    pairs = F.slice(F.arrays_zip(found.alias("value"), pieces.alias("piece")), F.lit(1), F.size(found))
    none = F.array().cast("array<struct<value:string,start:int,end:int>>")
    hint = F.lit(True)
    for i, needed in enumerate(NEEDS.get(pattern, ())):
        hint = text.contains(needed) | hint if i else text.contains(needed)
    return F.when(hint & text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def _small(part: Column) -> Column:
    """At most 255, whatever the number of leading zeros."""
    return part.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")


def valid(kind: str, value: Column) -> Column:
    """The kind's check of a matched value."""
    digits = _digits(value)
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), _small)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _bucket(x: Column, *edges: int) -> Column:
    """How many of the edges ``x`` reaches."""
    return sum(((x >= e).cast("int") for e in edges), F.lit(0))


def _side(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def _features(text: Column, span: Column, kind: int) -> list[Column]:
    value = span["value"]
    left = F.substring(text, F.greatest(span["start"] - BEFORE + 1, F.lit(1)), F.least(span["start"], F.lit(BEFORE)))
    before = F.when(span["start"] == 0, "").otherwise(F.substring(text, span["start"], F.lit(1)))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    return [
        F.lit(kind), _bucket(F.length(_digits(value)), 1, 8, 12, 16, 20),
        F.least(F.length(F.regexp_replace(value, r"[^\x20().-]", "")), F.lit(3)), left.rlike(CONTEXT).cast("int"),
        _side(before), _side(after), _bucket(F.length(value), 8, 12, 16, 20, 28),
    ]


def _key(features: list[Column]) -> Column:
    """A feature vector as one whole number."""
    out = F.lit(0)
    for f, size in zip(features, _SIZES, strict=True):
        out = out * size + f
    return out.cast("int")


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, base, valid, key): the matches of all patterns, which may overlap."""

    def of(kind: str, base: bool):
        return lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"),
            valid(kind, s["value"]).alias("valid"), _key(_features(text, s, KINDS.index(kind))).alias("key"),
        )

    forms = [(kind, pattern, base) for kind in KINDS for pattern, base in ((BASE[kind], True), (WIDE[kind], False))]
    return F.concat(*[F.transform(_spans(text, pattern), of(kind, base)) for kind, pattern, base in forms])


def _unkey(key: Column) -> list[Column]:
    out, rest = [], key
    for size in reversed(_SIZES):
        out.append(rest % size)
        rest = F.floor(rest / size).cast("int")
    return [c.cast("double").alias(name) for c, name in zip(reversed(out), FEATURES, strict=True)]


def learn_selection(docs: DataFrame, rounds: int = 10, depth: int = 3, precision: float = PRECISION) -> list[int]:
    """Feature vectors whose candidates are selected.

    Base matches teach: those that pass their kind's check count as true, those that fail as false. All documents
    are counted, by feature vector, of which there are at most MAX_KEYS; a fifth of the documents is held out. Boosted
    trees score every vector, and the threshold is the lowest score from which on the held-out candidates
    reach ``precision``. Without both true and false ones, or where no score reaches it, none is selected.
    """
    one = docs.select(
        (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held_out"), F.explode(candidates(F.col("text"))).alias("c")
    )
    counted = (
        one.groupBy(F.col("c.key").alias("key")).agg(
            *[F.sum(F.when(F.col("c.base") & (F.col("held_out") == held) & (F.col("c.valid") == good), 1).otherwise(0)).alias(name)
              for name, held, good in (("t1", False, True), ("t0", False, False), ("h1", True, True), ("h0", True, False))],
        ).collect()
    )
    if not sum(r.t1 for r in counted) or not sum(r.t0 for r in counted):
        return []
    spark = docs.sparkSession
    rows = spark.createDataFrame([(r.key, r.t1, r.t0, r.h1, r.h0) for r in counted], "key int, t1 long, t0 long, h1 long, h0 long").coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.select("*", *_unkey(F.col("key"))))
    lessons = vectors.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("t1").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), F.col("t0").cast("double").alias("weight")))).alias("l"))
    lessons = lessons.select("features", "l.label", "l.weight").where("weight > 0")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, weightCol="weight", minInstancesPerNode=1, seed=1).fit(lessons)
    scored = model.transform(vectors).select("key", "h1", "h0", F.round(vector_to_array("probability")[1], 6).alias("score"))
    levels = scored.groupBy("score").agg(F.sum("h1").alias("h1"), F.sum("h0").alias("h0"))
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # MAX_KEYS rows at most
    good = levels.select("score", F.sum("h1").over(upto).alias("a"), F.sum(F.col("h1") + F.col("h0")).over(upto).alias("n"))
    lowest = good.where((F.col("n") > 0) & (F.col("a") >= precision * F.col("n"))).agg(F.min("score")).first()[0]
    return [] if lowest is None else sorted(r.key for r in scored.where(F.col("score") >= lowest).select("key").collect())


def find_pii(docs: DataFrame, selected: list[int] | None = None) -> DataFrame:
    """The columns of ``docs`` with base_spans and pii_spans: arrays of (kind, start, end), by kind as listed, then start.

    Base spans are the leftmost, not overlapping matches of the base patterns that pass their kind's check. Further candidates
    (wide patterns) are added where the boosted trees select their feature vector, their kind's check holds and they
    overlap no base span. Places are code points, end exclusive. NULL and empty texts have no spans; every row gets its own result.
    ``selected`` is learnt from ``docs`` if not given.
    """
    docs = without(docs, "base_spans", "pii_spans")
    taken = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if selected is None:
        selected = learn_selection(docs.select(text.alias("text")))
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    all_found, base, extra = "_candidates", "base_spans", "pii_spans"
    while all_found in taken:
        all_found = "_" + all_found
    found = docs.withColumn(all_found, candidates(text))
    kept_base = F.filter(all_found, lambda c: c["base"] & c["valid"])
    found = found.withColumn(base, F.transform(kept_base, plain))
    keys = F.array(*[F.lit(k) for k in selected]).cast("array<int>")
    added = F.filter(all_found, lambda c: ~c["base"] & c["valid"] & F.array_contains(keys, c["key"])
                     & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    both = F.concat(F.col(base), F.transform(added, plain))

    def own(kind: str):
        return lambda s: s["kind"] == kind

    sorted_spans = F.concat(*[F.sort_array(F.filter(both, own(kind))) for kind in KINDS])
    return found.withColumn(extra, sorted_spans).drop(all_found)


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one's kind stands for their union."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(by_start, begin, step)
    rest = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
