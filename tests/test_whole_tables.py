"""Queries without SQL run over their whole tables."""

import numpy as np
from pyspark.sql import functions as F

from quillon.plans import registry

registry.load_all()
SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_rs4_counts_every_line(spark):
    li = table(spark, "lineitem").toPandas()
    p, o = li.l_discount > 0.05, li.l_quantity > 25
    rows = registry.QUERIES["rs4_bootstrap_table"](spark, SF).collect()
    got = {next(x for x in r if x in ("sens", "spec")): r["estimate"] for r in rows}
    assert np.isclose(got["sens"], (p & o).sum() / o.sum()) and np.isclose(got["spec"], (~p & ~o).sum() / (~o).sum())


def test_em1_uses_every_component(spark):
    e = table(spark, "embeddings").toPandas().sort_values("vec_id")
    x = np.array(e.embedding.tolist(), float)
    x -= x.mean(0)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    got = registry.QUERIES["em1_pca"](spark, SF).toPandas().sort_values("vec_id")[["pc1", "pc2"]].to_numpy()
    assert np.allclose(np.abs(got), np.abs(x @ axes), atol=1e-6)


def test_every_supplier_and_part_counts(spark):
    n = table(spark, "supplier").count()
    assert registry.QUERIES["ro15_dilution"](spark, SF).count() == n
    m = table(spark, "lineitem").select("l_suppkey").distinct().count()
    assert registry.QUERIES["poly1_hypercube"](spark, SF).count() == m * (m - 1) // 2
    ids = {r[0] for r in registry.QUERIES["ep2_epitopes"](spark, SF).select("id").collect()}
    assert ids == {r[0] for r in table(spark, "part").select("p_partkey").collect()}


def test_sq13_aligns_every_pair(spark):
    small = "/root/testdata/sf0.001"
    sizes = spark.read.parquet(f"{small}/part.parquet").groupBy("p_brand", "p_size").count().toPandas()["count"]
    assert registry.QUERIES["sq13_alignment"](spark, small).count() == (sizes * (sizes - 1) // 2).sum()


def test_ep2_finds_all_maximal_sets(spark):
    from quillon.operators import sequences

    text = "ACDEFGHIKLMNPQRSTVWYAC"
    given = [(1, 0, 20), (2, 1, 10), (3, 12, 20), (4, 1, 10)]  # 1 shares with 2 and with 3, which share nothing; 4 is placed as 2
    rows = spark.createDataFrame([(1, 0, k, a, b, text[a:b]) for k, a, b in given], "u int, island int, id int, start int, end int, seq string")
    got = sequences.epitopes(rows, "u", "island", "id", "start", "end", "seq").collect()
    sets = {}
    for r in got:
        sets.setdefault(r["epitope"], set()).add((r["id"], r["floater"]))
    assert sorted(map(sorted, sets.values())) == [[(1, 1), (2, 0), (4, 0)], [(1, 1), (3, 0)]]


def test_qt2_equals_numeric_integration(spark):
    from quillon.operators import estimators

    x = np.sort(np.random.default_rng(0).normal(size=41))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    grid = np.linspace(0, 1, 400_001)[1:-1]

    def beta_cdf(a, b, at):  # by sums over a fine grid
        w = np.exp((a - 1) * np.log(grid) + (b - 1) * np.log(1 - grid) - np.max((a - 1) * np.log(grid) + (b - 1) * np.log(1 - grid)))
        return w[grid <= at].sum() / w.sum()

    for method in ("exact", "approximate"):
        r = estimators.quantile_interval(df, "x", 0.3, 0.05, method).first()
        for value, level in ((r["lo"], 0.025), (r["hi"], 0.975)):
            share = np.interp(value, x, np.linspace(0, 1, len(x)))
            got = 1 - beta_cdf(42 * share, 42 * (1 - share), 0.3) if method == "exact" else beta_cdf(42 * 0.3, 42 * 0.7, share)
            assert abs(got - level) < 2e-3
        assert np.isclose(r["quantile"], np.quantile(x, 0.3))
    assert estimators.quantile_interval(df.limit(0), "x", 0.5).first()["lo"] is None


def test_na1_sample_does_not_depend_on_partitions(spark):
    from quillon.operators import columns

    df = spark.createDataFrame([(k, float(k) if k % 3 else None, k % 7 or None) for k in range(600)], "k int, x double, y int")
    a, b = ({r["k"]: (r["x"], r["y"]) for r in columns.impute(df.repartition(n), ["x", "y"], "sample").collect()} for n in (1, 7))
    assert a == b and len(a) == 600 and all(x is not None and y is not None for x, y in a.values())
    assert all(a[k][0] == k for k in range(600) if k % 3) and len({a[k][0] for k in range(0, 600, 3)}) > 100


def test_intervals_of_ratios(spark):
    import math
    from statistics import NormalDist

    from quillon.operators import comparisons as C

    rows = [(12, 90, 25, 110), (0, 40, 7, 35), (5, 50, 0, 45), (30, 30, 12, 40), (3, 20, 30, 30), (0, 30, 30, 30)]
    df = spark.createDataFrame(rows, "x1 int, n1 int, x2 int, n2 int")
    lo, hi, rr = C.risk_score_interval("x1", "n1", "x2", "n2")
    z = NormalDist().inv_cdf(0.975)

    def score(r, x1, n1, x2, n2):  # chi-squared at the likelihood's greatest, found by search
        p2 = np.linspace(1e-7, min(1, 1 / r) - 1e-9, 200_001)
        with np.errstate(divide="ignore", invalid="ignore"):
            like = sum(np.where(k > 0, k * np.log(v), 0) for k, v in ((x1, r * p2), (n1 - x1, 1 - r * p2), (x2, p2), (n2 - x2, 1 - p2)))
        b = p2[np.argmax(like)]
        a = r * b
        return (x1 - n1 * a) ** 2 / (n1 * a * (1 - a)) + (x2 - n2 * b) ** 2 / (n2 * b * (1 - b))

    for given, r in zip(rows, df.select(lo.alias("lo"), hi.alias("hi"), rr.alias("rr")).collect()):
        x1, n1, x2, n2 = given
        assert math.isclose(r["rr"], (x1 + 0.5) / (n1 + 1) / ((x2 + 0.5) / (n2 + 1)))
        for end, edge in ((r["lo"], x1 == 0), (r["hi"], x2 == 0)):
            assert end == (0 if end is r["lo"] else math.inf) if edge else abs(score(end, *given) - z * z) < 0.05
    got = df.limit(1).select(*(c.alias(n) for c, n in zip(C.conditional_efficacy("x1", "n1", "x2", "n2"), ("ve", "lo", "hi", "p")))).first()
    q = 90 / 200
    assert math.isclose(got["p"], sum(math.comb(37, k) * q**k * (1 - q) ** (37 - k) for k in range(13)), rel_tol=1e-9)
    got = df.limit(1).select(C.unconditional_efficacy("x1", "n1", "x2", "n2")[3].alias("p"), C.relative_risk(F.lit(12), F.lit(78), F.lit(25), F.lit(85))[3].alias("q")).first()
    ratio, se = math.log(12 / 90 / (25 / 110)), math.sqrt(78 / (12 * 90) + 85 / (25 * 110))
    assert math.isclose(got["p"], NormalDist().cdf(ratio / se), abs_tol=1e-6) and math.isclose(got["q"], 1 - NormalDist().cdf(abs(ratio) / se), abs_tol=1e-6)


def test_label_statistics(spark):
    from quillon.operators import comparisons as C

    rng = np.random.default_rng(1)
    values = [(s, f, float(rng.normal() + (s < 8) * f)) for s in range(16) for f in range(3)]
    v = spark.createDataFrame(values, "s int, f int, x double")
    labels = spark.createDataFrame([(s, s < 8, float(s)) for s in range(16)], "s int, lab boolean, num double")
    x = np.array([r[2] for r in values]).reshape(16, 3)
    a, b = x[:8], x[8:]
    t = (a.mean(0) - b.mean(0)) / np.sqrt((a.var(0, ddof=1) + b.var(0, ddof=1)) / 2 * (2 / 8))
    rank = lambda m: np.argsort(np.argsort(m, axis=0), axis=0)
    rho = [np.corrcoef(rank(x[:, k]), np.arange(16))[0, 1] for k in range(3)]
    for kind, label, want in (("t", "lab", t), ("rho", "num", rho)):
        got = {r["f"]: r for r in C.label_permutation_tests(v, "s", ["f"], "x", labels, label, 99, kind).collect()}
        assert np.allclose([got[k]["observed"] for k in range(3)], want)
        assert got[2]["p"] < 0.1 and all(0 < r["p"] <= 1 for r in got.values())
    for kind, summary, want in (("t", "sum", np.abs(t).sum()), ("dmean", "max", ((a.mean(0) - b.mean(0)) ** 2).max())):
        assert np.isclose(C.global_label_test(v, "s", ["f"], "x", labels, "lab", 19, kind, summary).first()["observed"], want)
