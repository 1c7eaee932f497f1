"""Likelihood fits against numpy: brute-force likelihoods, loops over the same weights, and data without a peak."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import comparisons, models, prefix, regression, resampling


def frame(spark, **columns):
    names = list(columns)
    rows = list(zip(*(np.asarray(v).tolist() for v in columns.values())))
    return spark.createDataFrame(rows, names).repartition(3)


def newton(f, b, steps=100):
    """A peak by numerical derivatives of a log-likelihood."""
    p, h = len(b), 1e-4
    for _ in range(steps):
        e = np.eye(p) * h
        g = np.array([(f(b + e[i]) - f(b - e[i])) / (2 * h) for i in range(p)])
        hess = np.array([[(f(b + e[i] + e[j]) - f(b + e[i] - e[j]) - f(b - e[i] + e[j]) + f(b - e[i] - e[j])) / (4 * h * h) for j in range(p)] for i in range(p)])
        move = np.linalg.solve(-hess, g)
        b = b + move / max(1, np.abs(move).max())
        if np.abs(move).max() < 1e-9:
            break
    return b, np.linalg.inv(-hess)


def cox_ll(b, time, event, x, w, stratum):
    eta, out = x @ b, 0.0
    for i in np.flatnonzero(event):
        at = (time >= time[i]) & (stratum == stratum[i])
        out += w[i] * (eta[i] - math.log((w[at] * np.exp(eta[at])).sum()))
    return out


def survival(n=160, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n)])
    time = np.ceil(rng.exponential(np.exp(-0.7 * x[:, 0] + 0.4 * x[:, 1])) * 12)
    return time, rng.random(n) < 0.7, x, rng.integers(1, 4, n).astype(float), rng.integers(0, 2, n)


def test_special_functions(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 2.5, 7.9, 30.0, 1e4, 1e7]
    rows = frame(spark, x=xs).select("x", regression.log_gamma(F.col("x")).alias("l"), regression.digamma(F.col("x")).alias("d"), regression.trigamma(F.col("x")).alias("t")).collect()
    for r in rows:
        assert r["l"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-12)
        shift = sum(1 / (r["x"] + k) for k in range(60))
        y = r["x"] + 60
        assert r["d"] == pytest.approx(math.log(y) - 0.5 / y - 1 / (12 * y * y) + 1 / (120 * y**4) - shift, rel=1e-11)
        assert r["t"] == pytest.approx(1 / y + 0.5 / y**2 + 1 / (6 * y**3) - 1 / (30 * y**5) + sum(1 / (r["x"] + k) ** 2 for k in range(60)), rel=1e-11)


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(0)
    v, g, a = rng.integers(0, 50, 400), rng.integers(0, 3, 400), rng.integers(0, 9, 400)
    df = frame(spark, v=v, g=g, a=a).groupBy("g", "v").agg(F.sum("a").alias("a"))
    parts = prefix.range_parts(df, "v", parts=7)
    assert parts.select("_part").distinct().count() > 3
    for down in (False, True):
        for r in prefix.running(parts, ["g"], ["v"], ["a"], descending=down).collect():
            inside = (g == r["g"]) & ((v >= r["v"]) if down else (v <= r["v"]))
            assert r["run_a"] == a[inside].sum()
    got = sorted((r["_at_"], r["v"]) for r in prefix.numbered(df.select("v").distinct(), ["v"], "_at_").collect())
    assert got == list(enumerate(sorted(set(v.tolist()))))


def test_cox_against_brute_force(spark):
    time, event, x, w, stratum = survival()
    df = frame(spark, t=time, e=event, a=x[:, 0], b=x[:, 1], w=w, s=stratum)
    got = {r["term"]: r for r in regression.cox_regression(df, "t", F.col("e"), ["a", "b"], F.col("w"), "s").collect()}
    want, cov = newton(lambda b: cox_ll(b, time, event, x, w, stratum), np.zeros(2))
    assert [got[k]["log_ratio"] for k in "ab"] == pytest.approx(want, abs=1e-6)
    assert [got[k]["se"] for k in "ab"] == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-3)
    assert got["a"]["ratio"] == pytest.approx(math.exp(want[0]), rel=1e-6) and 0 < got["a"]["p"] < 1e-3


def score_residuals(b, time, event, x, w, stratum):
    eta, u = np.exp(x @ b), np.zeros_like(x)
    for i in np.flatnonzero(event):
        at = (time >= time[i]) & (stratum == stratum[i])
        s0 = (w[at] * eta[at]).sum()
        mean = (w[at] * eta[at]) @ x[at] / s0
        u[i] += x[i] - mean
        u[at] -= (w[i] * eta[at] / s0)[:, None] * (x[at] - mean)
    return u


def test_cox_sandwich(spark):
    time, event, x, w, stratum = survival(seed=2)
    cluster = np.arange(len(time)) // 4
    df = frame(spark, t=time, e=event, a=x[:, 0], b=x[:, 1], w=w, s=stratum, c=cluster)
    got = regression.cox_regression(df, "t", F.col("e"), ["a", "b"], F.col("w"), "s", "c", robust=True).collect()
    b, cov = newton(lambda b: cox_ll(b, time, event, x, w, stratum), np.zeros(2))
    u = w[:, None] * score_residuals(b, time, event, x, w, stratum)
    u = np.array([u[cluster == k].sum(0) for k in np.unique(cluster)])
    assert [r["se"] for r in got] == pytest.approx(np.sqrt(np.diag(cov @ (u.T @ u) @ cov)), rel=2e-3)


def test_case_cohort(spark):
    time, event, x, _, stratum = survival(n=600, seed=3)
    rng = np.random.default_rng(9)
    kept = event | (rng.random(600) < np.where(stratum == 1, 0.5, 0.25))
    big = {s: int((~event & (stratum == s)).sum()) for s in (0, 1)}
    small = {s: int((kept & ~event & (stratum == s)).sum()) for s in (0, 1)}
    w = np.where(event, 1.0, [big[s] / small[s] for s in stratum])
    df = frame(spark, t=time[kept], e=event[kept], a=x[kept, 0], b=x[kept, 1], s=stratum[kept])
    got = regression.case_cohort(df, "t", F.col("e"), ["a", "b"], "s", frame(spark, s=[0, 1], n=[big[0], big[1]])).collect()
    args = time[kept], event[kept], x[kept], w[kept], np.zeros(kept.sum())
    b, cov = newton(lambda b: cox_ll(b, *args), np.zeros(2))
    u, out = score_residuals(b, *args), cov.copy()
    for s in (0, 1):
        mine = u[~event[kept] & (stratum[kept] == s)]
        out += cov @ (big[s] * (big[s] - small[s]) / small[s] * np.cov(mine.T)) @ cov
    assert [r["log_ratio"] for r in got] == pytest.approx(b, abs=1e-6)
    assert [r["se"] for r in got] == pytest.approx(np.sqrt(np.diag(out)), rel=2e-3) and got[0]["se"] > got[0]["naive_se"]
    with pytest.raises(ValueError):
        regression.case_cohort(df, "t", F.col("e"), ["a"], "s", frame(spark, s=[0], n=[big[0]]))


def test_cox_of_few_treated(spark):
    """60 events among 3,000 controls and 2 among 3 treated: undamped steps run off."""
    rng = np.random.default_rng(5)
    time, arm = rng.permutation(3003) + 1.0, np.r_[np.zeros(3000), np.ones(3)]
    event = np.r_[np.arange(3000) < 60, [True, True, False]]
    df = frame(spark, t=time, e=event, arm=arm)
    got = comparisons.cox_two_arms(df, "t", F.col("e"), F.col("arm") == 1).first()
    args = time, event, arm[:, None], np.ones(3003), np.zeros(3003)
    want, cov = newton(lambda b: cox_ll(b, *args), np.zeros(1))
    assert 3 < want[0] < 6 and got["log_ratio"] == pytest.approx(want[0], abs=1e-5) and got["se"] == pytest.approx(cov[0, 0] ** 0.5, rel=1e-3)


def test_cox_without_a_peak_raises(spark):
    time = np.arange(1.0, 41)
    for arm in (time <= 20, np.ones(40, bool)):  # the treated all fail first; nobody is a control
        with pytest.raises(regression.NotConverged):
            comparisons.cox_two_arms(frame(spark, t=time, e=np.ones(40, bool), arm=arm), "t", F.col("e"), F.col("arm"))
    with pytest.raises(regression.NotConverged):
        comparisons.cox_two_arms(frame(spark, t=time, e=np.zeros(40, bool), arm=time < 9), "t", F.col("e"), F.col("arm"))


def logistic_ll(b, x, y, w):
    eta = b[0] + x @ b[1:]
    return (w * (y * eta - np.logaddexp(0, eta))).sum()


def test_logistic_groups_settle_or_say_so(spark):
    rng = np.random.default_rng(7)
    x, g = rng.normal(size=(300, 2)), np.arange(300) % 3
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    y[g == 1] = (x[g == 1, 0] > 0).astype(int)  # separable
    y[g == 2] = 1  # one outcome alone
    df = frame(spark, g=g, y=y, a=x[:, 0], b=x[:, 1])
    fits = {r["g"]: r for r in regression.logistic_fits(df, ["g"], "y", ["a", "b"]).collect()}
    want, cov = newton(lambda b: logistic_ll(b, x[g == 0], y[g == 0], np.ones(100)), np.zeros(3))
    assert fits[0]["state"] == "yes" and fits[0]["b"] == pytest.approx(want, abs=1e-6) and fits[0]["cov"][0] == pytest.approx(cov[0, 0], rel=1e-3)
    assert fits[1]["state"] != "yes" and fits[2]["state"] != "yes"
    table = regression.coefficients(regression.logistic_fits(df, ["g"], "y", ["a", "b"]), ["g"], ["one", "a", "b"]).collect()
    assert all((r["coefficient"] is None) == (r["g"] != 0) for r in table) and len(table) == 9
    with pytest.raises(regression.NotConverged):
        regression.settled(regression.logistic_fits(df, ["g"], "y", ["a", "b"]))
    assert regression.logistic_fits(df.limit(0), ["g"], "y", ["a"]).count() == 0
    flags = {(r["g"], r["settled"]) for r in models.grouped_logistic(df, ["g"], "y", ["a", "b"]).collect()}
    assert flags == {(0, True), (1, False), (2, False)}


def area(y, score, w):
    order = np.unique(score, return_inverse=True)[1]
    p, q = np.bincount(order, w * y), np.bincount(order, w * (1 - y))
    return (p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum())


def test_optimism_equals_a_loop(spark):
    rng = np.random.default_rng(11)
    n, reps = 150, 12
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    df = frame(spark, id=np.arange(n), y=y, a=x[:, 0], b=x[:, 1], c=x[:, 2])
    got = regression.optimism_bootstrap(df, "id", "y", ["a", "b", "c"], n=reps, seed=3).first()
    draws = spark.range(n).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).select("id", "r", resampling.poisson_one(resampling.uniform("id", "r", F.lit(3))).alias("w")).toPandas()
    score = lambda w: (lambda b: b[0] + x @ b[1:])(newton(lambda b: logistic_ll(b, x, y, w), np.zeros(4))[0])
    one = np.ones(n)
    apparent, gains = area(y, score(one), one), []
    for r in range(reps):
        w = draws[draws.r == r].sort_values("id").w.to_numpy(float)
        s = score(w)
        gains.append(area(y, s, w) - area(y, s, one))
    assert got["used"] == reps and got["apparent"] == pytest.approx(apparent, abs=1e-6)
    assert got["optimism"] == pytest.approx(np.mean(gains), abs=1e-4) and got["estimate"] == pytest.approx(apparent - np.mean(gains), abs=1e-4)
    assert got["median"] == pytest.approx(np.median(apparent - gains), abs=1e-3)


def beta_binomial_ll(b, x, y, m):
    mu, s = 1 / (1 + np.exp(-(b[0] + x @ b[1:-1]))), math.exp(-b[-1])
    lg = np.vectorize(math.lgamma)
    a1, a2 = mu * s, (1 - mu) * s
    return (lg(m + 1) - lg(y + 1) - lg(m - y + 1) + lg(a1 + y) + lg(a2 + m - y) - lg(s + m) - lg(a1) - lg(a2) + lg(np.full(len(y), s))).sum()


def test_beta_binomial_against_a_search(spark):
    rng = np.random.default_rng(13)
    n = 240
    g, x = np.arange(n) % 2, np.round(rng.normal(size=n), 2)
    m = rng.integers(5, 60, n)
    mu = 1 / (1 + np.exp(-(-0.5 + 0.8 * x * (g == 0))))
    s = 9.0
    y = rng.binomial(m, rng.beta(mu * s, (1 - mu) * s))
    df = frame(spark, g=g, x=x, y=y, m=m)
    fits = {r["g"]: r for r in regression.beta_binomial(df, ["g"], "y", "m", ["x"]).collect()}
    for k in (0, 1):
        own = g == k
        want, cov = newton(lambda b, own=own: beta_binomial_ll(b, x[own, None], y[own], m[own]), np.array([-0.3, 0.1, -2.0]))
        assert fits[k]["state"] == "yes" and fits[k]["b"] == pytest.approx(want, abs=1e-5)
        assert fits[k]["ll"] == pytest.approx(beta_binomial_ll(want, x[own, None], y[own], m[own]), rel=1e-9)
        assert np.array(fits[k]["cov"]).reshape(3, 3)[1, 1] == pytest.approx(cov[1, 1], rel=1e-3)
    flat = frame(spark, g=[0] * 40, x=[0.0, 1.0] * 20, y=[5] * 40, m=[10] * 40)
    assert regression.beta_binomial(flat, ["g"], "y", "m", []).first()["state"] != "yes"


def test_beta_binomial_tables_are_whole(spark):
    """Groups without dispersion have the binomial fit's means, and every coefficient its test."""
    rng = np.random.default_rng(17)
    n = 300
    x, g = np.round(rng.normal(size=n), 2), np.arange(n) % 2
    m = np.where(np.arange(n) % 5 == 0, 90, rng.integers(1, 8, n))
    mu = 1 / (1 + np.exp(-(-0.4 + 0.6 * x)))
    y = np.where(g == 1, rng.binomial(m, rng.beta(mu * 6, (1 - mu) * 6)), np.round(m * mu)).astype(int)  # of group 0 hardly any spread
    fits = regression.beta_binomial(frame(spark, g=g, x=x, y=y, m=m), ["g"], "y", "m", ["x"])
    assert {r["g"]: (r["state"], r["n"]) for r in fits.collect()} == {0: ("binomial", 150), 1: ("yes", 150)}
    own = g == 0
    ll = lambda b: (y[own] * (b[0] + b[1] * x[own]) - m[own] * np.log1p(np.exp(b[0] + b[1] * x[own]))).sum()
    want, cov = newton(ll, np.zeros(2))
    rows = {(r["g"], r["term"]): r for r in regression.wald_tests(fits, ["g"], ["one", "x", "dispersion"]).collect()}
    assert len(rows) == 6 and rows[0, "dispersion"]["coefficient"] is None
    assert [rows[0, t]["coefficient"] for t in ("one", "x")] == pytest.approx(want, abs=1e-5)
    assert rows[0, "x"]["error"] == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-3)
    for r in rows.values():
        if r["coefficient"] is not None:
            assert r["t"] == pytest.approx(r["coefficient"] / r["error"])
    from quillon.functions.distributions import t_sf

    assert rows[1, "x"]["p"] == pytest.approx(float(t_sf(np.array([rows[1, "x"]["t"]]), np.array([147.0]))[0]))


def test_two_phase_logistic(spark):
    rng = np.random.default_rng(15)
    n = 900
    s, x = rng.integers(0, 2, n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(1.5 - x - 0.5 * s))).astype(int)
    kept = (y == 1) | (rng.random(n) < 0.4)
    cells = {(a, b): (int(((s == a) & (y == b)).sum()), int(((s == a) & (y == b) & kept).sum())) for a in (0, 1) for b in (0, 1)}
    w = np.array([cells[a, b][0] / cells[a, b][1] for a, b in zip(s, y)])[kept]
    df = frame(spark, s=s[kept], y=y[kept], x=x[kept])
    sizes = frame(spark, s=[a for a, _ in cells], y=[b for _, b in cells], n=[v[0] for v in cells.values()])
    got = regression.two_phase_logistic(df, "y", ["x"], "s", sizes).collect()
    xs, ys = x[kept, None], y[kept]
    b, cov = newton(lambda b: logistic_ll(b, xs, ys, w), np.zeros(2))
    u = (ys - 1 / (1 + np.exp(-(b[0] + xs[:, 0] * b[1]))))[:, None] * np.column_stack([np.ones(len(ys)), xs])
    meat = (w[:, None] * u).T @ u
    for (c, d), (big, small) in cells.items():
        mine = u[(s[kept] == c) & (ys == d)]
        meat = meat + big * (big - small) / small * np.cov(mine.T)
    assert [r["log_ratio"] for r in got] == pytest.approx(b, abs=1e-6)
    assert [r["se"] for r in got] == pytest.approx(np.sqrt(np.diag(cov @ meat @ cov)), rel=2e-3)


def test_weighted_edges_keep_their_fractions(spark):
    rows = [(True, True, 0.4), (True, True, 0.3), (True, False, 2.5), (False, True, 1.5), (False, False, 3.5)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, w double")
    got = comparisons.edge_test(df, F.col("a"), F.col("b"), F.col("w")).first()
    assert (got["a"], got["b"], got["c"], got["d"]) == pytest.approx((0.7, 2.5, 1.5, 3.5)) and got["odds_ratio"] == pytest.approx(0.7 * 3.5 / (2.5 * 1.5)) and got["p"] is None
    whole = comparisons.edge_test(df, F.col("a"), F.col("b"), F.col("w") * 0 + 2).first()
    plain = comparisons.edge_test(df.unionByName(df), F.col("a"), F.col("b")).first()
    assert whole["p"] == plain["p"] and whole["a"] == 4


def test_rejection_draws_are_as_many_as_asked_for(spark):
    low = resampling.rejection_sample(spark, lambda x: F.lit(0.1) + 0 * x, 1.0, 0.0, 1.0, 500)
    rows = low.collect()
    assert len(rows) == 500 and len({r["id"] for r in rows}) == 500 and abs(np.mean([r["x"] for r in rows]) - 0.5) < 0.06
    with pytest.raises(ValueError):
        resampling.rejection_sample(spark, lambda x: F.lit(0.0) * x, 1.0, 0.0, 1.0, 5)
    with pytest.raises(ValueError):
        resampling.rejection_sample(spark, lambda x: F.lit(2.0) + 0 * x, 1.0, 0.0, 1.0, 5)


# --- the gap statistic


def lloyd(x, centres, steps=200):
    before = np.inf
    for _ in range(steps):
        far = ((x[:, None] - centres[None]) ** 2).sum(2)
        near = far.argmin(1)
        total = far[np.arange(len(x)), near].sum()
        if before - total <= 1e-9 * (1 + total):
            return total
        before = total
        centres = np.stack([x[near == j].mean(0) if (near == j).any() else c for j, c in enumerate(centres)])
    raise AssertionError


def test_gap_statistic_equals_numpy(spark):
    from quillon.operators import gap

    rng = np.random.default_rng(21)
    n, most, reps = 120, 5, 4
    x = np.round(np.concatenate([rng.normal(c, 0.5, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))]), 3)
    df = frame(spark, id=np.arange(n), a=x[:, 0], b=x[:, 1])
    points = gap.column_resample(df, "id", ["a", "b"], reps, seed=2)
    tables = {r: np.array(list(points.where(F.col("replicate") == r).orderBy("row").toPandas().x)) for r in range(reps + 1)}
    assert (tables[0] == x).all()
    for r in range(1, reps + 1):
        assert tables[r].shape == x.shape and all(set(tables[r][:, c]) <= set(x[:, c]) for c in range(2)) and not (tables[r] == x).all()
        assert len({tuple(v) for v in tables[r]} - {tuple(v) for v in x}) > n // 2  # columns are drawn apart
    hashes = {r["id"]: r["h"] for r in spark.range(n).select("id", F.xxhash64("id", F.lit(2)).alias("h")).collect()}
    logs = {}
    for r, t in tables.items():
        low = {}
        for k, p in enumerate(map(tuple, t)):
            low[p] = min(low.get(p, hashes[k]), hashes[k])
        start = np.array([p for p, _ in sorted(low.items(), key=lambda v: (v[1], v[0]))])
        for k in range(1, most + 1):
            logs[r, k] = math.log(lloyd(t, start[:k]))
    rows = {r["k"]: r for r in gap.gap_statistic(df, "id", ["a", "b"], most, reps, seed=2).collect()}
    for k in range(1, most + 1):
        null = [logs[r, k] for r in range(1, reps + 1)]
        assert rows[k]["log_w"] == pytest.approx(logs[0, k], abs=1e-9) and rows[k]["null_mean"] == pytest.approx(np.mean(null), abs=1e-9)
        assert rows[k]["error"] == pytest.approx(np.std(null) * math.sqrt(1 + 1 / reps), abs=1e-9)
        assert rows[k]["gap"] == pytest.approx(np.mean(null) - logs[0, k], abs=1e-9)
    want = next((k for k in range(1, most) if rows[k]["gap"] >= rows[k + 1]["gap"] - rows[k + 1]["error"]), None)
    assert [k for k in rows if rows[k]["chosen"]] == [want]
    assert gap.gap_statistic(df.limit(0), "id", ["a", "b"], most, reps).count() == 0
