"""Null, tie and bin rules of the column builders."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wardwise import functions as fn
from wardwise import schemas
from wardwise.operators import rpv, waste


def one(spark, *cols, **values):
    schema = ", ".join(f"{k} double" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(*cols).first()


def test_division_by_zero_is_null(spark):
    assert one(spark, fn.try_div("a", "b"), a=1.0, b=0.0)[0] is None
    assert one(spark, fn.try_div("a", "b"), a=0.0, b=0.0)[0] is None


def test_strict_aggregates(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0), (2, 5.0)], "g int, x double")
    rows = {r.g: r for r in df.groupBy("g").agg(
        fn.strict_avg("x").alias("a"), fn.strict_sum("x").alias("s"), F.avg("x").alias("skip")).collect()}
    assert rows[1].a is None and rows[1].s is None and rows[1].skip == 1.0
    assert rows[2].a == 4.0 and rows[2].s == 8.0


def test_ifelse_unknown_condition(spark):
    got = one(spark, fn.ifelse(F.col("a") > 0.5, 1, 0), F.when(F.col("a") > 0.5, 1).otherwise(0), a=None)
    assert got[0] is None and got[1] == 0


def test_pmax_and_clamp_keep_null(spark):
    got = one(spark, fn.pmax(F.lit(0.0), "a"), fn.pmin("a", "b"), fn.clamp("a", 0, 1), fn.clamp("b", 0, 1), a=None, b=7.0)
    assert tuple(got) == (None, None, None, 1.0)


@pytest.mark.parametrize(("x", "right", "left", "lowest"), [
    (0.0, None, 1, 1), (0.05, 1, 2, 1), (0.5, 10, 11, 10), (1.0, 20, None, 20), (None, None, None, None),
    (0.15, 3, 3, 3),  # 3 * 0.05 lies just above 0.15 in binary
])
def test_cut_edges(spark, x, right, left, lowest):
    breaks = [i * 0.05 for i in range(21)]
    got = one(spark, fn.cut_index("x", breaks), fn.cut_index("x", breaks, right=False),
              fn.cut_index("x", breaks, include_lowest=True), x=x)
    assert tuple(got) == (right, left, lowest)


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5, 10), (0.25, 10)], "per_minority double, population bigint").withColumn("dem_voteshare", F.lit(0.45))
    rows = schemas.fill_counts(df).orderBy("per_minority").collect()
    assert [r.n_minority for r in rows] == [2, 5] and [r.dem_votes for r in rows] == [4, 4]


def test_rpv_flag_ties_and_nulls(spark):
    df = spark.createDataFrame([(0.5, 0.3), (0.7, 0.3), (0.3, 0.7), (None, 0.3), (0.7, 0.6)], "a double, b double")
    assert [r[0] for r in df.select(rpv.rpv_flag("a", "b")).collect()] == [0, 1, 1, None, 0]
    assert [r[0] for r in df.select(rpv.rpv_type("a", "b")).collect()] == ["None", "Type 1", "Type 2", "None", "None"]


def test_two_notions_of_correctness(spark):
    df = spark.createDataFrame([(0.6, 0.6, 0.6, 0.6, 0, 0), (0.7, 0.3, 0.3, 0.7, 1, 1), (0.7, 0.3, 0.8, 0.2, 1, 1)],
                               "t1 double, t0 double, e1 double, e0 double, tr int, er int")
    got = df.select(rpv.rpv_correct_strict("t1", "t0", "e1", "e0"), rpv.rpv_agreement("er", "tr")).collect()
    # Strict: a correctly predicted non-polarized district and a wrong direction score 0.
    assert [r[0] for r in got] == [0, 0, 1] and [r[1] for r in got] == [1, 1, 1]


def test_stars(spark):
    df = spark.createDataFrame([(0.001,), (0.02,), (0.07,), (0.5,), (None,)], "p double")
    assert [r[0] for r in df.select(fn.stars("p")).collect()] == ["***", "**", "*", "", ""]


def test_margin_classes(spark):
    df = spark.createDataFrame([(0.2,), (0.1,), (0.05,), (0.0,), (-0.05,), (-0.1,), (None,)], "m double")
    got = [r[0] for r in df.select(waste.margin_category("m")).collect()]
    assert got == ["Safe Dem (>10%)", "Likely Dem (5-10%)", "Lean Dem (0-5%)", "Lean Rep (0-5%)",
                   "Likely Rep (5-10%)", "Safe Rep (>10%)", "Safe Rep (>10%)"]


def test_required_columns(spark):
    df = spark.createDataFrame([Row(pop=1)])
    with pytest.raises(ValueError, match="pct_id, dem_vsh"):
        schemas.require_columns(df, ["pct_id", "pop", "dem_vsh"])


def test_short_names_round_trip(spark):
    df = spark.createDataFrame([(1, 10, None)], "precinct_id bigint, population bigint, dem_voteshare_minority double")
    short = schemas.to_short_names(df)
    assert short.columns == ["pct_id", "pop", "dem_vsh_1"] and short.first().dem_vsh_1 == 0.0
    assert schemas.to_long_names(short).columns == df.columns


def test_hash_noise_is_repeatable_and_uniform(spark):
    df = spark.range(10000).select(fn.hash_noise(1, "id").alias("u"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.02
    assert df.exceptAll(spark.range(10000).select(fn.hash_noise(1, "id").alias("u"))).isEmpty()
