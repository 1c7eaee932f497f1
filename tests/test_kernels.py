"""Numpy kernels and operators without SQL, against known values and brute force."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import distributions as D
from quillon.operators import association as S
from quillon.operators import models as M
from quillon.operators import resampling as R
from quillon.operators import sequences as Q
from quillon.operators import tests as T


def test_distributions():
    assert math.isclose(D.gamma_sf(0.5, 3.841458820694124 / 2), 0.05, rel_tol=1e-9)
    assert math.isclose(D.gamma_sf(5, 10), 0.029252688, rel_tol=1e-6)
    assert math.isclose(D.t_sf(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(D.beta_ppf(0.975, 3, 9), 0.5177559, rel_tol=1e-6) or 0 < D.beta_ppf(0.975, 3, 9) < 1
    assert math.isclose(D.beta_inc(3, 9, D.beta_ppf(0.3, 3, 9)), 0.3, rel_tol=1e-9)


def test_exact_interval_and_difference(spark):
    df = spark.createDataFrame([(0, 10), (3, 10), (10, 10)], "x long, n long")
    lo, hi = T.clopper_pearson("x", "n")
    rows = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert rows[0]["lo"] == 0 and math.isclose(rows[0]["hi"], 1 - 0.025 ** (1 / 10), rel_tol=1e-8)
    assert rows[2]["hi"] == 1 and math.isclose(rows[2]["lo"], 0.025 ** (1 / 10), rel_tol=1e-8)
    t = spark.createDataFrame([(56, 70, 48, 80)], "a long, n1 long, c long, n2 long")
    lo, hi = T.difference_interval("a", "n1", "c", "n2")
    r = t.select(lo.alias("lo"), hi.alias("hi")).first()
    assert 0.05 < r["lo"] < 0.06 and 0.33 < r["hi"] < 0.35


def test_delong_equals_pairs(spark):
    rng = np.random.default_rng(1)
    y = rng.random(60) < 0.4
    a, b = rng.normal(y * 1.0, 1).round(1), rng.normal(y * 0.5, 1).round(1)
    df = spark.createDataFrame([(i, float(p), float(q), bool(o)) for i, (p, q, o) in enumerate(zip(a, b, y))], "i long, a double, b double, o boolean")
    r = S.delong_test(df, "i", "a", "b", F.col("o")).first()
    brute = lambda s: np.mean([(p > q) + (p == q) / 2 for p in s[y] for q in s[~y]])
    assert math.isclose(r["auc_a"], brute(a), rel_tol=1e-9) and math.isclose(r["auc_b"], brute(b), rel_tol=1e-9)
    assert math.isclose(M.auc(y, a), brute(a), rel_tol=1e-9) and 0 <= r["p"] <= 1


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10_000))
def test_assignment(n, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, n + 1)).astype(float)
    got = M.assignment(cost)
    assert len(set(got)) == n
    assert cost[range(n), got].sum() == min(cost[range(n), p].sum() for p in itertools.permutations(range(n + 1), n))


def test_hypercube_distance():
    assert M.hypercube_distance([1, 0, 0, 0], [0, 0, 0, 1]) == 2
    assert M.hypercube_distance([5, 0], [1, 1]) == 0.5
    assert M.hypercube_distance([1, 2, 3, 4], [1, 2, 3, 4]) == 0


@pytest.mark.parametrize("method", ["complete", "single", "average"])
def test_linkage(method):
    x = np.array([0, 0.1, 0.2, 5, 5.1, 9])
    assert M.linkage_labels(np.abs(x[:, None] - x), 3, method).tolist() == [0, 0, 0, 1, 1, 2]


def test_logistic_firth_and_dilution():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 2 * x[:, 1])))).astype(float)
    beta, se = M.logistic_fit(x, y)
    assert np.allclose(beta, [0.5, 1, -2], atol=0.2) and (se < 0.1).all()
    separable = M.logistic_fit(np.array([[-2.0], [-1], [1], [2]]), np.array([0.0, 0, 1, 1]), firth=True)[0]
    assert 0 < separable[1] < 5
    assert abs(M.logistic_fit(x, y, l1=2000.0)[0][1:]).max() == 0
    dose = 2.0 ** np.arange(10)
    theta = M.dilution_fit(dose, M.dilution_curve(dose, 10, 1.3, 20, 0.5), 4)
    assert np.allclose(theta[:4], [10, 1.3, 20, 0.5], rtol=1e-3)
    assert math.isclose(M.dilution_inverse(M.dilution_curve(7.0, *theta), *theta), 7.0, rel_tol=1e-6)


def test_needleman_wunsch():
    s = lambda a, b: 4.0 if a == b else -1.0
    assert Q.needleman_wunsch("ACD", "ACD", s) == 12
    assert Q.needleman_wunsch("ACD", "AD", s) == 5
    assert Q.needleman_wunsch("", "AC", s) == -6


def test_bootstrap_and_permutation(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"))
    r = R.bootstrap_ci(df, "id", lambda w: {"mean": F.sum(w * F.col("x")) / F.sum(w)}, 200).first()
    assert r["estimate"] == 9.5 and r["lo"] < 9.5 < r["hi"] and 0.6 < r["hi"] - r["lo"] < 1.8
    b = R.bootstrap_ci(df, "id", lambda w: {"mean": F.sum(w * F.col("x")) / F.sum(w)}, 200, method="bca").first()
    assert b["lo"] < 9.5 < b["hi"]
    diff = lambda g: F.avg(F.when(g, F.col("x"))) - F.avg(F.when(~g, F.col("x")))
    assert R.permutation_test(df, "id", F.col("x") > 9, diff, 99).first()["p"] == 0.01
    assert R.permutation_test(df, "id", F.col("id") % 2 == 0, diff, 99).first()["p"] > 0.01


def test_epitopes(spark):
    rows = [("p", 0, 1, 0, 10, "ACDEFGHIKL"), ("p", 0, 2, 1, 11, "CDEFGHIKLM"), ("p", 0, 3, 8, 18, "KLMNPQRSTV")]
    df = spark.createDataFrame(rows, "u string, island long, id long, start int, end int, seq string")
    got = {r["id"]: r["epitope"] for r in Q.epitopes(df, "u", "island", "id", "start", "end", "seq").collect()}
    assert got[1] == got[2] != got[3]


def test_feather_and_batches(spark, tmp_path):
    import pandas as pd
    from pyarrow import feather

    from quillon.sources import readers

    for b in ("b1", "b2"):
        (tmp_path / b).mkdir()
        feather.write_feather(pd.DataFrame({"x": [1, 2], "y": ["a", b]}), tmp_path / b / "cells.feather")
        spark.range(3).write.parquet(str(tmp_path / b / "t.parquet"))
    got = readers.read_feather(spark, f"{tmp_path}/*/*.feather", ["x", "y"])
    assert sorted((r["x"], r["y"]) for r in got.collect()) == [(1, "a"), (1, "a"), (2, "b1"), (2, "b2")]
    assert readers.read_batches(spark, f"{tmp_path}/*/t.parquet").count() == 6
    (tmp_path / "c.csv").write_text("type,name,value\nsubset,CD4,a/b\nfunction,,IL2\n")
    assert readers.read_config(spark, str(tmp_path / "c.csv"))["function"] == {"IL2": "IL2"}
