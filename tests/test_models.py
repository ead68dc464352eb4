"""Model fits against dense numpy solutions on a small table."""

import numpy as np
import pytest

from wardwise.operators import models


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2))
    p = 1 / (1 + np.exp(-(0.3 + 0.8 * x[:, 0] - 0.5 * x[:, 1])))
    y, z = (rng.random(400) < p).astype(float), 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=400)
    rows = [(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, z, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, y double, z double"), np.column_stack([np.ones(400), x]), y, z


def test_ols(table):
    df, x, _, z = table
    tidy, fit = models.ols(df, "z", ["a", "b"])
    beta = np.linalg.solve(x.T @ x, x.T @ z)
    rss = float(((z - x @ beta) ** 2).sum())
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss / 397)
    got = {r.term: r for r in tidy.collect()}
    for i, t in enumerate(["(Intercept)", "a", "b"]):
        assert got[t].estimate == pytest.approx(beta[i], abs=1e-8) and got[t].std_error == pytest.approx(se[i], rel=1e-6)
    assert fit["n"] == 400 and fit["r2"] == pytest.approx(1 - rss / ((z - z.mean()) ** 2).sum())


@pytest.mark.parametrize(("dof", "t"), [(1, 12.706205), (2, 4.302653), (10, 2.228139), (1e6, 1.959966)])
def test_t_quantile(dof, t):
    assert models.t_quantile(0.975, dof) == pytest.approx(t, abs=1e-5)
    assert models.t_quantile(0.025, dof) == pytest.approx(-t, abs=1e-5)


def test_regression_table_has_fit_rows(table):
    tidy, fit = models.ols(table[0], "z", ["a", "b"])
    got = {r.term: r.one for r in models.regression_table({"one": tidy}, {"one": fit}).collect()}
    assert set(got) == {"(Intercept)", "a", "b", "N", "R2", "Adjusted R2"}
    assert got["N"] == "400" and got["R2"] == f"{fit['r2']:.3f}" and got["Adjusted R2"] == f"{fit['adj_r2']:.3f}"


def test_logit_by_scenario_takes_any_key(table):
    from pyspark.sql import functions as F

    df = table[0].withColumns({"k": F.when(F.col("a") > 0, F.lit("o'k")), "l": F.lit("x")})
    got = models.logit_by_scenario(df, "y", "b", ["k", "l"]).collect()
    assert {r.k for r in got} == {"o'k", None} and len(got) == 4


def test_logit_and_marginal_effects(table):
    df, x, y, _ = table
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        info = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(info, x.T @ (y - p))
    cov = np.linalg.inv(info)
    tidy, _ = models.logit(df, "y", ["a", "b"])
    got = {r.term: r for r in tidy.collect()}
    for i, t in enumerate(["(Intercept)", "a", "b"]):
        assert got[t].estimate == pytest.approx(beta[i], abs=1e-5)
        assert got[t].std_error == pytest.approx(np.sqrt(cov[i, i]), rel=1e-4)
    ame = {r.term: r for r in models.marginal_effects(df, "y", ["a", "b"]).collect()}

    def effect(b):
        q = 1 / (1 + np.exp(-x @ b))
        return (q * (1 - q)).mean() * b

    for i, t in ((1, "a"), (2, "b")):
        slope = np.array([(effect(beta + h)[i] - effect(beta - h)[i]) / 2e-5 for h in np.eye(3) * 1e-5])
        assert ame[t].ame == pytest.approx(effect(beta)[i], abs=1e-6)
        assert ame[t].std_error == pytest.approx(np.sqrt(slope @ cov @ slope), rel=1e-3)


def test_constant_terms_are_left_out(table):
    from pyspark.sql import functions as F

    tidy, _ = models.ols(table[0].withColumn("c", F.lit(1.0)), "z", ["a", "c"])
    assert sorted(r.term for r in tidy.collect()) == ["(Intercept)", "a"]


def test_clusters_split_far_groups(spark):
    rows = [(i, float(i % 2) * 100 + i * 0.01, float(i % 2) * 50) for i in range(60)]
    df = spark.createDataFrame(rows, "precinct_id bigint, a double, b double")
    got = models.cluster(df, ["a", "b"], 2).collect()
    assert len({(r.precinct_id % 2, r.geog_id) for r in got}) == 2


def test_rows_are_taken_by_model_and_determined_terms_left_out(spark):
    """A row that lacks another model's column counts; a term that others determine does not."""
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), 2 * float(a) - float(b), float(a + b + e), None if i % 3 else float(a - e)) for i, (a, b, e) in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, z double")
    fits = models.ols_all(df, {"y": ("y", ["a", "b", "c"]), "z": ("z", ["a"])})
    assert sorted(r.term for r in fits["y"][0].collect()) == ["(Intercept)", "a", "b"]
    assert fits["y"][1]["n"] == 200 and fits["z"][1]["n"] == 67
    x = np.array([[1, r[0]] for r in rows if r[4] is not None])
    beta = np.linalg.lstsq(x, np.array([r[4] for r in rows if r[4] is not None]), rcond=None)[0]
    got = {r.term: r.estimate for r in fits["z"][0].collect()}
    assert got["a"] == pytest.approx(beta[1], abs=1e-9) and got["(Intercept)"] == pytest.approx(beta[0], abs=1e-9)


def test_groups_are_fitted_together_and_profiles_are_roots(table, spark):
    """Group fits equal single ones; at a profile end the best likelihood without the term is lower by half of chi-squared's 95 % point."""
    from pyspark.sql import functions as F

    from wardwise.operators import fits

    df, x, y, _ = table
    both = df.withColumn("k", F.lit("first")).union(df.select("a", "b", 1 - F.col("y"), "z", F.lit(None)))
    both = both.union(df.select("a", "b", F.lit(1.0), "z", F.lit("one outcome"))).union(df.select("a", "b", (F.col("a") > 0).cast("double"), "z", F.lit("apart")))
    got = {}
    for r in fits.fit_logits(both, "y", ["a", "b"], ["k"], profile=True).collect():
        got.setdefault(r.k, {})[r.term] = r
    alone = {r.term: r for r in models.logit(df, "y", ["a", "b"], profile=True)[0].collect()}
    assert set(got) == {"first", None}

    def best(j, value):
        """Largest log-likelihood with coefficient j fixed."""
        free = [i for i in range(3) if i != j]
        beta = np.zeros(3)
        beta[j] = value
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            beta[free] += np.linalg.solve((x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free], x[:, free].T @ (y - p))
        eta = x @ beta
        return float((y * eta - np.logaddexp(0, eta)).sum())

    for j, t in enumerate(["(Intercept)", "a", "b"]):
        own, other = got["first"][t], got[None][t]
        assert own.estimate == pytest.approx(alone[t].estimate, abs=1e-8) and other.estimate == pytest.approx(-own.estimate, abs=1e-8)
        assert own.conf_low < own.estimate < own.conf_high and alone[t].conf_low == pytest.approx(own.conf_low, abs=1e-7)
        for end in (own.conf_low, own.conf_high):
            assert best(j, end) == pytest.approx(own.loglik - fits.CHI2 / 2, abs=1e-6)


def test_best_of_many_starts(spark):
    """One start is caught in a poor optimum; with many the six groups are found, whatever the order of the rows."""
    rng = np.random.default_rng(0)
    rows = [(i, float(10 * (i % 6) + rng.normal() / 10), float((i % 6) ** 2)) for i in range(240)] + [(999, None, 1.0)]
    df = spark.createDataFrame(rows, "precinct_id bigint, a double, b double")
    got = models.cluster(df, ["a", "b"], 6).collect()
    assert len(got) == 240 and len({(r.precinct_id % 6, r.geog_id) for r in got}) == 6
    assert all(r.geog_id == r.precinct_id % 6 + 1 for r in got)
    assert {(r.precinct_id, r.geog_id) for r in models.cluster(df.repartition(7), ["a", "b"], 6).collect()} == {(r.precinct_id, r.geog_id) for r in got}
    few = models.cluster(df.where("precinct_id < 3"), ["a", "b"], 6).collect()
    assert len({r.geog_id for r in few}) == 3
    assert models.cluster(df.where("false"), ["a", "b"], 6).collect() == []


def test_upper_tail(spark):
    import math

    from wardwise.operators.space import upper_tail

    zs = [-9.0, -3.999, -1.0, 0.0, 1e-9, 0.5, 1.96, 3.999, 4.0, 6.0, 20.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(upper_tail("z").alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-9)
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS z").select(upper_tail("z").alias("p")).first().p is None
