"""Queries of tests, intervals, correlation, ROC, survival, quantiles, diversity and composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.distributions import normal_cdf_sql
from quillon.operators import association as S
from quillon.operators import estimators as E
from quillon.operators import tests as T
from quillon.plans.registry import query
from quillon.session import load

Z = 1.959963984540054


def rounded(df: DataFrame, digits: int, *keys: str) -> DataFrame:
    """All columns but the keys rounded."""
    return df.select(*(F.col(c) if c in keys or t not in ("double", "float") else F.round(c, digits).alias(c) for c, t in df.dtypes))


_TAB_SQL = """t AS (SELECT l_suppkey AS k, count(*) FILTER (r AND q) AS a, count(*) FILTER (r AND NOT q) AS b, count(*) FILTER (NOT r AND q) AS c, count(*) FILTER (NOT r AND NOT q) AS d
    FROM (SELECT l_suppkey, l_returnflag = 'R' AS r, l_quantity > 25 AS q FROM lineitem) GROUP BY 1)"""


def _table(spark, d) -> DataFrame:
    li = load(spark, d, "lineitem")
    return T.two_by_two(li.withColumn("k", F.col("l_suppkey")), F.col("l_returnflag") == "R", F.col("l_quantity") > 25, ["k"])


def fisher_sql(alternative: str) -> str:
    """DuckDB expression of Fisher's exact p of columns a, b, c, d."""
    lc = lambda n, k: f"(lgamma(({n})::DOUBLE + 1) - lgamma(({k})::DOUBLE + 1) - lgamma((({n}) - ({k}))::DOUBLE + 1))"
    lp = lambda k: f"({lc('a + c', k)} + {lc('b + d', f'a + b - {k}')} - {lc('a + b + c + d', 'a + b')})"
    span = {"two-sided": "greatest(0, a - d), least(a + b, a + c) + 1", "greater": "a, least(a + b, a + c) + 1", "less": "greatest(0, a - d), a + 1"}[alternative]
    term = f"CASE WHEN {lp('k')} <= {lp('a')} + 1e-7 THEN exp({lp('k')}) ELSE 0 END" if alternative == "two-sided" else f"exp({lp('k')})"
    return f"least(1.0, list_sum(list_transform(range({span}), lambda k: {term})))"


for _alt in ("two-sided", "greater", "less"):

    @query(f"st1_fisher_{_alt.replace('-', '_')}", f"WITH {_TAB_SQL} SELECT k, a, b, c, d, round(a * d / nullif(b * c, 0), 6) AS odds_ratio, round({fisher_sql(_alt)}, 6) AS p FROM t")
    def st1(spark: SparkSession, d: str, alternative: str = _alt) -> DataFrame:
        return _table(spark, d).select("k", "a", "b", "c", "d", F.round(T.odds_ratio("a", "b", "c", "d"), 6).alias("odds_ratio"), F.round(T.fisher_exact("a", "b", "c", "d", alternative), 6).alias("p"))


_P_SQL = f"{_TAB_SQL}, f AS (SELECT k, k % 4 AS g, {fisher_sql('two-sided')} AS p0 FROM t), p AS (SELECT k, g, CASE WHEN k % 11 <> 0 THEN p0 END AS p FROM f)"


def _pvalues(spark, d) -> DataFrame:
    p = _table(spark, d).withColumn("p0", T.fisher_exact("a", "b", "c", "d"))
    return p.select("k", (F.col("k") % 4).alias("g"), F.when(F.col("k") % 11 != 0, F.col("p0")).alias("p"))


_ADJ = {
    "holm": "max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY g ORDER BY i ROWS UNBOUNDED PRECEDING)",
    "fdr_bh": "min(least(1.0, p * m / i)) OVER (PARTITION BY g ORDER BY i DESC ROWS UNBOUNDED PRECEDING)",
    "bonferroni": "least(1.0, p * m)",
    "sidak": "1 - pow(1 - p, m)",
    "simes-hochberg": "min(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY g ORDER BY i DESC ROWS UNBOUNDED PRECEDING)",
}
_TIES = "d AS (SELECT p_size / 51.0 AS p, count(*) AS n FROM part GROUP BY 1), r AS (SELECT p, sum(n) OVER (ORDER BY p) AS i, sum(n) OVER () AS m FROM d)"


@query("st24_ties", f"WITH {_TIES}, q AS (SELECT p, min(least(1.0, p * m / i)) OVER (ORDER BY p DESC) AS bh, min(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p DESC) AS sh FROM r) SELECT p_partkey, round(bh, 9) AS fdr_bh, round(sh, 9) AS simes_hochberg FROM part JOIN q ON p_size / 51.0 = p")
def st24_ties(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") / 51.0).alias("p"))
    return rounded(T.adjust(T.adjust(p, "p", "fdr_bh", name="fdr_bh"), "p", "simes-hochberg", name="simes_hochberg").drop("p"), 9)


for _m, _sql in _ADJ.items():

    @query(
        f"st24_adjust_{_m.replace('-', '_')}",
        f"WITH {_P_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY g) AS m, row_number() OVER (PARTITION BY g ORDER BY p) AS i FROM p WHERE p IS NOT NULL) SELECT k, g, round(p, 6) AS p, round({_sql}, 6) AS q FROM r UNION ALL SELECT k, g, NULL, NULL FROM p WHERE p IS NULL",
    )
    def st24(spark, d, method: str = _m):
        return rounded(T.adjust(_pvalues(spark, d), "p", method, ["g"]), 6)


@query(
    "piv2_holm_by_sample",
    f"WITH {_P_SQL}, r AS (SELECT g, k % 3 AS s, min(p0) AS p FROM f GROUP BY 1, 2), o AS (SELECT *, count(*) OVER (PARTITION BY g) AS m, row_number() OVER (PARTITION BY g ORDER BY p) AS i FROM r), q AS (SELECT g, s, max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY g ORDER BY i ROWS UNBOUNDED PRECEDING) AS q FROM o) SELECT g, round(max(q) FILTER (s = 0), 6) AS s0, round(max(q) FILTER (s = 1), 6) AS s1, round(max(q) FILTER (s = 2), 6) AS s2 FROM q GROUP BY 1",
)
def piv2(spark, d):
    p = _table(spark, d).withColumn("p0", T.fisher_exact("a", "b", "c", "d"))
    r = p.groupBy((F.col("k") % 4).alias("g"), (F.col("k") % 3).alias("s")).agg(F.min("p0").alias("p"))
    q = T.adjust(r, "p", "holm", ["g"]).groupBy("g").pivot("s", [0, 1, 2]).agg(F.first("q"))
    return rounded(q.toDF("g", "s0", "s1", "s2"), 6)


@query(
    "st4_relations",
    f"""WITH l AS (SELECT p_partkey AS r, 'p_brand' AS c, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part), m AS (SELECT c, v, count(*) AS m FROM l GROUP BY 1, 2),
    j AS (SELECT x.c AS c1, x.v AS v1, y.c AS c2, y.v AS v2, count(*) AS a FROM l x JOIN l y ON x.r = y.r AND x.c < y.c GROUP BY 1, 2, 3, 4 HAVING count(*) > 10),
    t AS (SELECT c1, v1, c2, v2, a, greatest(m1.m - a, 1) AS b, greatest(m2.m - a, 1) AS c, greatest((SELECT count(*) FROM part) - m1.m - m2.m + a, 1) AS d FROM j JOIN m m1 ON c1 = m1.c AND v1 = m1.v JOIN m m2 ON c2 = m2.c AND v2 = m2.v),
    p AS (SELECT *, a * d / (b * c) AS odds_ratio, {fisher_sql('two-sided')} AS p FROM t), o AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, v1, v2) AS i FROM p)
    SELECT c1, v1, c2, v2, a, b, c, d, round(odds_ratio, 5) AS odds_ratio, round(p, 5) AS p, round(min(least(1.0, p * m / i)) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 4) AS q FROM o""",
)
def st4(spark, d):
    out = S.relations(load(spark, d, "part"), "p_partkey", ["p_brand", "p_type"])
    return out.select("c1", "v1", "c2", "v2", "a", "b", "c", "d", F.round("odds_ratio", 5).alias("odds_ratio"), F.round("p", 5).alias("p"), F.round("q", 4).alias("q"))


@query(
    "st10_t_statistic",
    "SELECT p_brand, round(avg(p_retailprice) FILTER (s) - avg(p_retailprice) FILTER (NOT s), 6) AS diff, round((avg(p_retailprice) FILTER (s) - avg(p_retailprice) FILTER (NOT s)) / sqrt(var_samp(p_retailprice) FILTER (s) / count(*) FILTER (s) + var_samp(p_retailprice) FILTER (NOT s) / count(*) FILTER (NOT s)), 6) AS t FROM (SELECT *, p_size > 25 AS s FROM part) GROUP BY 1",
)
def st10(spark, d):
    return rounded(T.t_test(load(spark, d, "part"), "p_retailprice", F.col("p_size") > 25, ["p_brand"]).select("p_brand", "diff", "t"), 6)


@query("st10_t_test")
def st10_p(spark, d):
    return T.t_test(load(spark, d, "part"), "p_retailprice", F.col("p_size") > 25, ["p_brand"], welch=False)


@query(
    "st26_rank_sum",
    """WITH r AS (SELECT event_type, user_id % 2 = 0 AS g, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS r FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
    s AS (SELECT event_type, sum(r) FILTER (g) AS w, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n0 FROM r GROUP BY 1)
    SELECT event_type, w, round((w - n1 * (n1 + n0 + 1) / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 6) AS z FROM s""",
)
def st26(spark, d):
    return T.rank_sum(load(spark, d, "events"), "value", F.col("user_id") % 2 == 0, ["event_type"]).select("event_type", "w", F.round("z", 6).alias("z"))


@query(
    "st11_intervals",
    f"""WITH {_TAB_SQL}, x AS (SELECT k, a AS x, a + b AS n, a / (a + b) AS p FROM t)
    SELECT k, round((p + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) - {Z} * sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n)) / (1 + {Z}*{Z}/n), 6) AS wilson_lo, round((p + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) + {Z} * sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n)) / (1 + {Z}*{Z}/n), 6) AS wilson_hi,
    round(p - {Z} * sqrt(p*(1-p)/n), 6) AS wald_lo, round(p + {Z} * sqrt(p*(1-p)/n), 6) AS wald_hi,
    round((x + {Z}*{Z}/2) / (n + {Z}*{Z}) - {Z} * sqrt((x + {Z}*{Z}/2) / (n + {Z}*{Z}) * (1 - (x + {Z}*{Z}/2) / (n + {Z}*{Z})) / (n + {Z}*{Z})), 6) AS ac_lo FROM x""",
)
def st11(spark, d):
    t = _table(spark, d).select("k", F.col("a").alias("x"), (F.col("a") + F.col("b")).alias("n"))
    (wl, wh), (dl, dh), (al, _) = T.wilson("x", "n"), T.wald("x", "n"), T.agresti_coull("x", "n")
    return rounded(t.select("k", wl.alias("wilson_lo"), wh.alias("wilson_hi"), dl.alias("wald_lo"), dh.alias("wald_hi"), al.alias("ac_lo")), 6)


@query("st11_exact_interval")
def st11_exact(spark, d):
    lo, hi = T.clopper_pearson("a", F.col("a") + F.col("b"))
    return _table(spark, d).select("k", lo.alias("lo"), hi.alias("hi"))


@query(
    "st13_risk_ratio",
    f"""WITH {_TAB_SQL}, x AS (SELECT k, (nullif(a, 0) / (a + b)) / (nullif(c, 0) / (c + d)) AS rr, sqrt(1/nullif(a, 0) - 1/nullif(a+b, 0) + 1/nullif(c, 0) - 1/nullif(c+d, 0)) AS se FROM t)
    SELECT k, round(rr, 6) AS rr, round(exp(ln(rr) - {Z} * se), 6) AS lo, round(exp(ln(rr) + {Z} * se), 6) AS hi FROM x""",
)
def st13(spark, d):
    rr, lo, hi, _ = T.risk_ratio("a", F.col("a") + F.col("b"), "c", F.col("c") + F.col("d"))
    return rounded(_table(spark, d).select("k", rr.alias("rr"), lo.alias("lo"), hi.alias("hi")), 6)


@query("st15_difference_interval")
def st15(spark, d):
    lo, hi = T.difference_interval("a", F.col("a") + F.col("b"), "c", F.col("c") + F.col("d"))
    return _table(spark, d).select("k", lo.alias("lo"), hi.alias("hi"))


@query(
    "st16_proportions",
    f"WITH {_TAB_SQL}, e AS (SELECT *, a + b AS n1, c + d AS n2, (a + c) / (a + b + c + d) AS q FROM t), x AS (SELECT k, sqrt((a - n1 * q) ** 2 / nullif(n1 * q * (1 - q), 0) + (c - n2 * q) ** 2 / nullif(n2 * q * (1 - q), 0)) AS z FROM e) SELECT k, round(2 * {normal_cdf_sql('-z')}, 6) AS p FROM x",
)
def st16(spark, d):
    return rounded(_table(spark, d).select("k", T.proportions_p("a", F.col("a") + F.col("b"), "c", F.col("c") + F.col("d")).alias("p")), 6)


@query(
    "st7_chi2_clusters",
    """WITH c AS (SELECT p_brand AS cl, p_size % 3 AS co, count(*) AS o FROM part GROUP BY 1, 2), g AS (SELECT * FROM (SELECT cl, sum(o) AS r FROM c GROUP BY 1), (SELECT co, sum(o) AS s FROM c GROUP BY 1), (SELECT sum(o) AS t FROM c)),
    f AS (SELECT cl, r, r * s / t AS e, (t - r) * s / t AS e2, s, coalesce(o, 0) AS o FROM g LEFT JOIN c USING (cl, co)) SELECT cl, round(sum((o - e) ** 2 / e + (s - o - e2) ** 2 / e2), 6) AS chi2, count(*) - 1 AS dof FROM f GROUP BY 1""",
)
def st7(spark, d):
    c = load(spark, d, "part").groupBy(F.col("p_brand").alias("cl"), (F.col("p_size") % 3).alias("co")).agg(F.count(F.lit(1)).alias("n"))
    return T.chi2_clusters(c, "cl", "co", "n").select("cl", F.round("chi2", 6).alias("chi2"), "dof")


@query(
    "st8_cluster_tests",  # three conditions: two degrees, of which the tail is an exponential
    """WITH c AS (SELECT p_brand AS cl, p_size % 3 AS co, count(*) AS o FROM part GROUP BY 1, 2), g AS (SELECT * FROM (SELECT cl, sum(o) AS r FROM c GROUP BY 1), (SELECT co, sum(o) AS s FROM c GROUP BY 1), (SELECT sum(o) AS t FROM c)),
    f AS (SELECT cl, r, r * s / t AS e, (t - r) * s / t AS e2, s, coalesce(o, 0) AS o FROM g LEFT JOIN c USING (cl, co)), p AS (SELECT cl, CASE WHEN any_value(r) > 5 THEN exp(-sum((o - e) ** 2 / e + (s - o - e2) ** 2 / e2) / 2) END AS p FROM f GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p WHERE p IS NOT NULL)
    SELECT cl, round(p, 9) AS p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i), 9) AS holm, round(min(least(1.0, p * m / i)) OVER (ORDER BY i DESC), 9) AS fdr FROM i UNION ALL SELECT cl, NULL, NULL, NULL FROM p WHERE p IS NULL""",
)
def st8(spark, d):
    c = load(spark, d, "part").groupBy(F.col("p_brand").alias("cl"), (F.col("p_size") % 3).alias("co")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(T.chi2_clusters(c, "cl", "co", "n", 5).select("cl", "p", "holm", "fdr"), 9)


_SUMS = " + ".join(f"(CASE WHEN bit_count(m) >= 3 THEN {' * '.join(f'CASE WHEN m & {1 << i} <> 0 THEN {0.1 * (i + 1):.1f} ELSE {0.9 - 0.1 * i:.1f} END' for i in range(7))} ELSE 0 END)" for _ in (0,))


@query(
    "st20_tails",
    f"WITH s AS (SELECT s_suppkey, s_suppkey % 20 + 5 AS n, s_nationkey % 5 + 2 AS k FROM supplier), e AS (SELECT sum({_SUMS}) AS e FROM (SELECT m::INT AS m FROM range(0, 128) t(m))) SELECT s_suppkey, round(coalesce((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.3) + (n - i) * ln(0.7))) FROM range(0, 25) t(i) WHERE i BETWEEN k AND n), 0), 9) AS binomial, round(e, 9) AS any3 FROM s, e",
)
def st20(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 20 + 5).alias("n"), (F.col("s_nationkey") % 5 + 2).alias("k"))
    p = F.array(*(F.lit(0.1 * i) for i in range(1, 8)))
    return rounded(s.select("s_suppkey", T.binomial_tail("n", F.lit(0.3), "k").alias("binomial"), T.poisson_binomial_tail(p, 3).alias("any3")), 9)


@query("st21_power")
def st21(spark, d):
    """A study for each supplier, of a size and an effect by its key and nation."""
    grid = load(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10 + 1).alias("id"), (10 * (F.col("s_nationkey") + 1)).alias("n"))
    return grid.select(
        "s_suppkey", (F.col("id") / 10).alias("effect"), "n", T.power_two_means(F.col("id") / 10, "n", "n").alias("power"),
        T.endpoints_required(0.3 + F.col("id") / 20, 0.0, 1.0).alias("endpoints"), T.case_control_size(F.lit(0.3), 1.2 + F.col("id") / 5).alias("cases"),
    )


@query(
    "st21_correlation_interval",
    f"SELECT p_brand, round(corr(p_size, p_retailprice), 6) AS r, round(tanh(atanh(corr(p_size, p_retailprice)) - {Z} / sqrt(count(*) - 3)), 6) AS lo, round(tanh(atanh(corr(p_size, p_retailprice)) + {Z} / sqrt(count(*) - 3)), 6) AS hi FROM part GROUP BY 1",
)
def st21_corr(spark, d):
    r = load(spark, d, "part").groupBy("p_brand").agg(F.corr("p_size", "p_retailprice").alias("r"), F.count(F.lit(1)).alias("n"))
    lo, hi = T.correlation_interval("r", "n")
    return rounded(r.select("p_brand", "r", lo.alias("lo"), hi.alias("hi")), 6)


@query("st25_westfall_young", """WITH t AS (SELECT user_id AS t, count(*) AS n FROM events GROUP BY 1), o AS (SELECT t, ((t * 37) % 101 + 1) / 102.0 AS p FROM t), x AS (SELECT b, t, ((t * (7 + b * 13) + b * 29) % 103 + 1) / 104.0 AS p FROM t, range(0, 40) r(b)),
    j AS (SELECT t, p AS op, row_number() OVER (ORDER BY p, t) AS j FROM o), m AS (SELECT b, t, op, j, min(p) OVER (PARTITION BY b ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS least FROM x JOIN j USING (t)), s AS (SELECT t, op, j, avg((least <= op)::INT) AS s FROM m GROUP BY 1, 2, 3)
    SELECT t, round(op::DOUBLE, 9) AS p, round(max(s) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING), 9) AS fwer FROM s""")
def st25(spark, d):
    t = load(spark, d, "events").groupBy(F.col("user_id").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    o = t.select("t", ((F.col("t") * 37 % 101 + 1) / 102.0).alias("p"))
    x = t.crossJoin(spark.range(40).toDF("b")).select("b", "t", (((F.col("t") * (7 + F.col("b") * 13) + F.col("b") * 29) % 103 + 1) / 104.0).alias("p"))
    return rounded(T.westfall_young(o, x, "t", "p", "b"), 9)


@query(
    "st28_correlation_difference",
    f"WITH r AS (SELECT p_brand AS b, corr(p_size, p_retailprice) AS r, count(*) AS n FROM part GROUP BY 1), z AS (SELECT x.b AS b1, y.b AS b2, (atanh(x.r) - atanh(y.r)) / sqrt(1 / (x.n - 3) + 1 / (y.n - 3)) AS z FROM r x JOIN r y ON x.b < y.b) SELECT b1, b2, round(2 * {normal_cdf_sql('-abs(z)')}, 6) AS p FROM z",
)
def st28(spark, d):
    r = load(spark, d, "part").groupBy("p_brand").agg(F.corr("p_size", "p_retailprice").alias("r"), F.count(F.lit(1)).alias("n"))
    a, b = r.toDF("b1", "r1", "n1"), r.toDF("b2", "r2", "n2")
    return a.join(b, F.col("b1") < F.col("b2")).select("b1", "b2", F.round(T.correlation_difference_p("r1", "n1", "r2", "n2"), 6).alias("p"))


# --- correlation


_WIDE_SQL = "w AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q, l_discount AS d, CASE WHEN l_suppkey % 6 <> 0 THEN l_tax END AS t FROM lineitem)"


def _wide(spark, d):
    li = load(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"), F.col("l_discount").alias("d"), F.when(F.col("l_suppkey") % 6 != 0, F.col("l_tax")).alias("t"))


@query(
    "co1_pearson",
    f"WITH {_WIDE_SQL} SELECT 'q' AS a, 'd' AS b, regr_count(q, d)::BIGINT AS n, round(corr(q, d), 6) AS rho FROM w UNION ALL SELECT 'q', 't', regr_count(q, t)::BIGINT, round(corr(q, t), 6) FROM w UNION ALL SELECT 'd', 't', regr_count(d, t)::BIGINT, round(corr(d, t), 6) FROM w",
)
def co1(spark, d):
    return S.correlations(_wide(spark, d), "id", ["q", "d", "t"]).select("a", "b", "n", F.round("rho", 6).alias("rho"))


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"
_SP = "SELECT '{0}' AS a, '{1}' AS b, count(*) AS n, round(corr(x, y), 6) AS rho FROM (SELECT " + _RANK.format("{0}") + " AS x, " + _RANK.format("{1}") + " AS y FROM w WHERE {0} IS NOT NULL AND {1} IS NOT NULL)"


_PART_SQL = "w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS q, p_retailprice AS d, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 97 END AS t FROM part)"


@query("co1_spearman", f"WITH {_PART_SQL} " + " UNION ALL ".join(_SP.format(a, b) for a, b in (("q", "d"), ("q", "t"), ("d", "t"))))
def co1_spearman(spark, d):
    k = F.col("p_partkey")
    p = load(spark, d, "part").select(k.alias("id"), F.when(k % 3 != 0, F.col("p_size")).alias("q"), F.col("p_retailprice").alias("d"), F.when(k % 5 != 0, k % 97).alias("t"))
    return S.correlations(p, "id", ["q", "d", "t"], method="spearman").select("a", "b", "n", F.round("rho", 6).alias("rho"))


@query("co1_p_values")
def co1_p(spark, d):
    return S.correlations(_wide(spark, d), "id", ["q"], ["d", "t"])


@query("co2_kendall", """WITH c AS (SELECT p_size AS x, floor(p_retailprice / 50) AS y, count(*) AS n FROM part GROUP BY 1, 2),
    s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) AS s FROM c a JOIN c b ON a.x < b.x), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS t FROM c), tx AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM c GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM c GROUP BY y))
    SELECT round(s / nullif(sqrt((t - tx.v) * (t - ty.v)), 0), 6) AS tau FROM s, t, tx, ty""")
def co2(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_size", F.floor(F.col("p_retailprice") / 50).alias("y"))
    return S.kendall(p, "p_partkey", "p_size", "y").select(F.round("tau", 6).alias("tau"))


@query("co4_covariance", f"WITH {_WIDE_SQL} SELECT 'q' AS a, 'd' AS b, round(covar_samp(q, d) / (stddev_samp(q) * stddev_samp(d)), 6) AS rho FROM w UNION ALL SELECT 'q', 't', round(covar_samp(q, t) / (stddev_samp(q) * stddev_samp(t)), 6) FROM w UNION ALL SELECT 'd', 't', round(covar_samp(d, t) / (stddev_samp(d) * stddev_samp(t)), 6) FROM w")
def co4(spark, d):
    return rounded(S.covariance_correlations(_wide(spark, d), ["q", "d", "t"]), 6)


@query("co5_partial", f"WITH {_WIDE_SQL}, c AS (SELECT * FROM w WHERE q IS NOT NULL AND d IS NOT NULL AND t IS NOT NULL), r AS (SELECT count(*) AS n, corr(q, d) AS a, corr(q, t) AS b, corr(d, t) AS c FROM c) SELECT n, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS rho FROM r")
def co5(spark, d):
    return S.partial_correlation(_wide(spark, d), "q", "d", ["t"]).select("n", F.round("rho", 6).alias("rho"))


@query("co9_distance", f"WITH {_WIDE_SQL}, r AS (SELECT corr(q, d) AS r FROM w) SELECT round(r * r, 9) AS similarity, round(1 - r * r, 9) AS distance FROM r")
def co9(spark, d):
    sim, dist = S.correlation_distance(F.col("rho"))
    return S.correlations(_wide(spark, d), "id", ["q"], ["d"]).select(F.round(sim, 9).alias("similarity"), F.round(dist, 9).alias("distance"))


@query("co11_line_fit", "SELECT p_brand, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2 FROM part GROUP BY 1")
def co11(spark, d):
    return rounded(load(spark, d, "part").groupBy("p_brand").agg(F.regr_slope("p_retailprice", "p_size").alias("slope"), F.regr_intercept("p_retailprice", "p_size").alias("intercept"), F.regr_r2("p_retailprice", "p_size").alias("r2")), 6)


@query("co12_mutual_information", """WITH c AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c),
    h AS (SELECT (SELECT -sum(n / t * log2(n / t)) FROM (SELECT x, sum(n) AS n FROM c GROUP BY 1), t) AS h_x, (SELECT -sum(n / t * log2(n / t)) FROM (SELECT y, sum(n) AS n FROM c GROUP BY 1), t) AS h_y, (SELECT -sum(n / t * log2(n / t)) FROM c, t) AS h_xy)
    SELECT round(h_x, 6) AS h_x, round(h_y, 6) AS h_y, round(h_xy, 6) AS h_xy, round(h_x + h_y - h_xy, 6) AS mi FROM h""")
def co12(spark, d):
    return rounded(S.mutual_information(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select("h_x", "h_y", "h_xy", "mi"), 6)


# --- classification

_ROC_SQL = "r AS (SELECT l_discount AS s, l_quantity > 25 AS o, l_suppkey % 5 AS g FROM lineitem)"


def _scored(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_discount").alias("s"), (F.col("l_quantity") > 25).alias("o"), (F.col("l_suppkey") % 5).alias("g"), F.col("l_tax").alias("s2"))


@query(
    "ro2_confusion_stats",
    f"""WITH {_ROC_SQL}, t AS (SELECT g, count(*) FILTER (s > 0.05 AND o)::DOUBLE AS a, count(*) FILTER (s > 0.05 AND NOT o)::DOUBLE AS b, count(*) FILTER (s <= 0.05 AND o)::DOUBLE AS c, count(*) FILTER (s <= 0.05 AND NOT o)::DOUBLE AS d FROM r GROUP BY 1)
    SELECT g, round(a / (a + c), 6) AS sens, round(d / (b + d), 6) AS spec, round(a / (a + b), 6) AS ppv, round(d / (c + d), 6) AS npv, round((a + d) / (a + b + c + d), 6) AS acc, round((a / (a + b)) / (c / (c + d)), 6) AS rr, round(a * d / (b * c), 6) AS odds, round((a + c) / (a + b + c + d), 6) AS prev_obs FROM t""",
)
def ro2(spark, d):
    t = S.confusion(_scored(spark, d), F.col("s") > 0.05, F.col("o"), ["g"])
    return rounded(S.confusion_stats(t).select("g", "sens", "spec", "ppv", "npv", "acc", "rr", "odds", "prev_obs"), 6)


@query("ro4_roc_points", f"WITH {_ROC_SQL}, c AS (SELECT s, count(*) FILTER (o) AS p, count(*) FILTER (NOT o) AS q FROM r GROUP BY 1), x AS (SELECT s AS threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(q) OVER w)::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS np, (sum(q) OVER ())::BIGINT AS nq FROM c WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT threshold, tp, fp, np - tp AS fn, nq - fp AS tn, round(tp / np, 6) AS tpr, round(fp / nq, 6) AS fpr FROM x")
def ro4(spark, d):
    return rounded(S.roc_points(_scored(spark, d), "s", F.col("o")), 6, "threshold")


@query("ro4_roc_thresholds", f"WITH {_ROC_SQL}, e AS (SELECT min(s) AS lo, (max(s) - min(s)) / 20 AS w FROM r), b AS (SELECT least(19, floor((s - lo) / w))::INT AS k, o FROM r, e) SELECT round(lo + i * w, 9) AS threshold, count(*) FILTER (k >= i AND o) AS a, count(*) FILTER (k >= i AND NOT o) AS b, count(*) FILTER (k < i AND o) AS c, count(*) FILTER (k < i AND NOT o) AS d FROM b, e, range(1, 20) t(i) GROUP BY i, lo, w")
def ro4_grid(spark, d):
    return rounded(S.roc_thresholds(_scored(spark, d), "s", F.col("o"), 20), 9)


_AUC = """c AS (SELECT g, s, count(*) FILTER (o) AS p, count(*) FILTER (NOT o) AS q FROM r GROUP BY 1, 2), x AS (SELECT *, sum(q) OVER (PARTITION BY g ORDER BY s ROWS UNBOUNDED PRECEDING) - q / 2 AS below, sum(p) OVER (PARTITION BY g) - sum(p) OVER (PARTITION BY g ORDER BY s ROWS UNBOUNDED PRECEDING) + p / 2 AS above, sum(p) OVER (PARTITION BY g) AS np, sum(q) OVER (PARTITION BY g) AS nq FROM c),
    a AS (SELECT g, any_value(np) AS np, any_value(nq) AS nq, sum(p * below / nq) AS s10, sum(p * (below / nq) ** 2) AS q10, sum(q * above / np) AS s01, sum(q * (above / np) ** 2) AS q01 FROM x GROUP BY 1)"""


@query("ro5_auc", f"WITH {_ROC_SQL}, {_AUC} SELECT g, np::BIGINT AS n_pos, nq::BIGINT AS n_neg, round(s10 / np, 6) AS auc, round((q10 - s10 ** 2 / np) / (np - 1) / np + (q01 - s01 ** 2 / nq) / (nq - 1) / nq, 9) AS variance FROM a")
def ro5(spark, d):
    return S.auc(_scored(spark, d), "s", F.col("o"), ["g"]).select("g", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("variance", 9).alias("variance"))


@query("ro7_auc_interval", f"WITH {_ROC_SQL}, {_AUC}, v AS (SELECT g, s10 / np AS auc, (q10 - s10 ** 2 / np) / (np - 1) / np + (q01 - s01 ** 2 / nq) / (nq - 1) / nq AS v FROM a) SELECT g, round(auc, 6) AS auc, round(greatest(0, auc - {Z} * sqrt(v)), 6) AS lo, round(least(1, auc + {Z} * sqrt(v)), 6) AS hi FROM v")
def ro7(spark, d):
    return rounded(S.auc_interval(S.auc(_scored(spark, d), "s", F.col("o"), ["g"])).select("g", "auc", "lo", "hi"), 6)


def _score_interval(x: str, n: str) -> list[str]:
    p = f"({x}::DOUBLE / ({n}))"
    return [f"round(({p} + {Z}**2 / (2 * ({n})) {sign} {Z} * sqrt(({p} * (1 - {p}) + {Z}**2 / (4 * ({n}))) / ({n}))) / (1 + {Z}**2 / ({n})), 6)" for sign in "-+"]


_TPR, _FPR = _score_interval("tp", "np"), _score_interval("fp", "nq")


@query("ro8_roc_intervals", f"WITH {_ROC_SQL}, c AS (SELECT s, count(*) FILTER (o) AS p, count(*) FILTER (NOT o) AS q FROM r GROUP BY 1), x AS (SELECT s AS threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(q) OVER w)::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS np, (sum(q) OVER ())::BIGINT AS nq FROM c WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT threshold, tp, fp, {_TPR[0]} AS tpr_lo, {_TPR[1]} AS tpr_hi, {_FPR[0]} AS fpr_lo, {_FPR[1]} AS fpr_hi FROM x")
def ro8(spark, d):
    return rounded(S.roc_points_with_interval(_scored(spark, d), "s", F.col("o")).select("threshold", "tp", "fp", "tpr_lo", "tpr_hi", "fpr_lo", "fpr_hi"), 6, "threshold")


@query("st27_delong")
def st27(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), (F.col("l_quantity") > 25).alias("o"))
    return S.delong_test(li, "l_orderkey", "x", "y", F.col("o"))


# --- survival

_SURV_SQL = "v AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE) % 400 AS dur, o_orderstatus = 'F' AS ev, o_custkey % 2 = 0 AS arm, (o_custkey % 3 + 1)::DOUBLE AS st FROM orders)"


def _surv(spark, d):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return load(spark, d, "orders").select((days % 400).cast("long").alias("dur"), (F.col("o_orderstatus") == "F").alias("ev"), (F.col("o_custkey") % 2 == 0).alias("arm"), (F.col("o_custkey") % 3 + 1).cast("double").alias("st"))


_NA = "c AS (SELECT {0} dur, count(*) AS l, count(*) FILTER (ev) AS e FROM v GROUP BY ALL), h AS (SELECT {0} dur AS time, (sum(l) OVER (PARTITION BY {1}) - sum(l) OVER (PARTITION BY {1} ORDER BY dur ROWS UNBOUNDED PRECEDING) + l)::BIGINT AS at_risk, e AS events FROM c), n AS (SELECT {0} time, at_risk, events, sum(events / at_risk) OVER (PARTITION BY {1} ORDER BY time ROWS UNBOUNDED PRECEDING) AS hazard, sum(events / at_risk / at_risk) OVER (PARTITION BY {1} ORDER BY time ROWS UNBOUNDED PRECEDING) AS variance FROM h)"


@query("sv1_nelson_aalen", f"WITH {_SURV_SQL}, {_NA.format('arm,', 'arm')} SELECT arm, time, at_risk, events, round(hazard, 6) AS hazard, round(variance, 9) AS variance FROM n")
def sv1(spark, d):
    return E.nelson_aalen(_surv(spark, d), "dur", F.col("ev"), ["arm"]).select("arm", "time", "at_risk", "events", F.round("hazard", 6).alias("hazard"), F.round("variance", 9).alias("variance"))


@query("sv2_incidence", f"WITH {_SURV_SQL}, {_NA.format('', '1')} SELECT time, round(1 - exp(-hazard), 6) AS incidence, round(sqrt(variance) * exp(-hazard), 6) AS se, round(1 - exp(-greatest(0, hazard - {Z} * sqrt(variance))), 6) AS lo, round(1 - exp(-(hazard + {Z} * sqrt(variance))), 6) AS hi FROM n")
def sv2(spark, d):
    return rounded(E.cumulative_incidence(_surv(spark, d), "dur", F.col("ev")).select("time", "incidence", "se", "lo", "hi"), 6)


@query(
    "sv2_stratified",
    f"""WITH {_SURV_SQL}, {_NA.format('st,', 'st')}, g AS (SELECT * FROM (SELECT DISTINCT time FROM n), (SELECT DISTINCT st FROM n)),
    f AS (SELECT g.time, g.st, coalesce(last_value(hazard IGNORE NULLS) OVER (PARTITION BY g.st ORDER BY g.time ROWS UNBOUNDED PRECEDING), 0) AS hazard, coalesce(last_value(variance IGNORE NULLS) OVER (PARTITION BY g.st ORDER BY g.time ROWS UNBOUNDED PRECEDING), 0) AS variance FROM g LEFT JOIN n ON g.time = n.time AND g.st = n.st)
    SELECT time, round(sum(st / 6 * hazard), 6) AS hazard, round(sum((st / 6) ** 2 * variance), 9) AS variance FROM f GROUP BY 1""",
)
def sv2_strata(spark, d):
    return E.cumulative_incidence(_surv(spark, d), "dur", F.col("ev"), stratum="st").select("time", F.round("hazard", 6).alias("hazard"), F.round("variance", 9).alias("variance"))


@query(
    "sv3_contrast",
    f"""WITH {_SURV_SQL}, {_NA.format('arm,', 'arm')}, g AS (SELECT DISTINCT time FROM n), i AS (SELECT arm, time, 1 - exp(-hazard) AS i FROM n),
    f AS (SELECT g.time, coalesce(last_value(a.i IGNORE NULLS) OVER w, 0) AS i1, coalesce(last_value(b.i IGNORE NULLS) OVER w, 0) AS i0 FROM g LEFT JOIN i a ON a.time = g.time AND a.arm LEFT JOIN i b ON b.time = g.time AND NOT b.arm WINDOW w AS (ORDER BY g.time ROWS UNBOUNDED PRECEDING))
    SELECT time, round(i1, 6) AS i1, round(i0, 6) AS i0, round(CASE WHEN i1 > 0 AND i0 > 0 THEN i1 / i0 END, 6) AS ratio, round(i1 - i0, 6) AS difference FROM f""",
)
def sv3(spark, d):
    return rounded(E.incidence_contrast(_surv(spark, d), "dur", F.col("ev"), F.col("arm")).select("time", "i1", "i0", "ratio", "difference"), 6)


@query(
    "sv4_log_rank",
    f"WITH {_SURV_SQL}, c AS (SELECT dur, count(*) AS l, count(*) FILTER (arm) AS l1, count(*) FILTER (ev) AS d, count(*) FILTER (ev AND arm) AS d1 FROM v WHERE dur IS NOT NULL GROUP BY 1), n AS (SELECT *, sum(l) OVER (ORDER BY dur DESC) AS n, sum(l1) OVER (ORDER BY dur DESC) AS n1 FROM c), s AS (SELECT sum(d1)::BIGINT AS o, sum(d * n1 / n) AS e, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM n) SELECT o AS observed, round(e, 6) AS expected, round(v, 6) AS variance, round((o - e) / sqrt(v), 6) AS z FROM s",
)
def sv4(spark, d):
    return rounded(E.log_rank(_surv(spark, d), "dur", F.col("ev"), F.col("arm")), 6)


# --- quantiles

_WQ = "c AS (SELECT l_returnflag AS g, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), f AS (SELECT *, (sum(w) OVER (PARTITION BY g ORDER BY x ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY g) AS f FROM c), n AS (SELECT *, lead(f) OVER o AS f2, lead(x) OVER o AS x2, row_number() OVER o AS k FROM f WINDOW o AS (PARTITION BY g ORDER BY x))"


@query(
    "qt1_weighted_quantile",
    f"WITH {_WQ} SELECT g, q::DOUBLE AS q, round(max(CASE WHEN k = 1 AND q <= f THEN x WHEN f2 IS NULL AND q >= f THEN x WHEN q >= f AND q < f2 THEN x + (q - f) / (f2 - f) * (x2 - x) END), 4) AS quantile FROM n, (VALUES (0.1), (0.5), (0.99)) v(q) GROUP BY 1, 2",
)
def qt1(spark, d):
    li = load(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g")
    return E.weighted_quantile(li, "l_extendedprice", "l_quantity", [0.1, 0.5, 0.99], ["g"]).select("g", "q", F.round("quantile", 4).alias("quantile"))


@query("qt2_quantile_interval")
def qt2(spark, d):
    return E.quantile_interval(load(spark, d, "part"), "p_retailprice", 0.5)


@query("qt3_ecdf", "SELECT p_size, round(sum(n) OVER (ORDER BY p_size ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS f FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)")
def qt3(spark, d):
    return E.ecdf(load(spark, d, "part"), "p_size").withColumn("f", F.round("f", 9))


@query("qt5_bin_edges", "SELECT round(2 * (quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25)) / count(*) ** (1.0 / 3), 6) AS width, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part")
def qt5(spark, d):
    return E.bin_edges(load(spark, d, "part"), "p_retailprice").select(F.round("width", 6).alias("width"), "lo", "hi")


@query("qt6_box_stats", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, count(value) AS n FROM events GROUP BY 1")
def qt6(spark, d):
    return rounded(E.box_stats(load(spark, d, "events"), "value", ["event_type"]), 6)


# --- diversity and composition

_CNT = "c AS (SELECT event_type AS g, user_id AS k, count(*) AS n FROM events GROUP BY 1, 2)"


def _counts(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("g"), F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("dv1_diversity", f"WITH {_CNT}, p AS (SELECT g, n / sum(n) OVER (PARTITION BY g) AS p FROM c) SELECT g, round(-sum(p * log2(p)), 6) AS entropy, round(sum(p * p), 9) AS simpson, round(1 / sum(p * p), 6) AS reciprocal FROM p GROUP BY 1")
def dv1(spark, d):
    return E.diversity(_counts(spark, d), "n", ["g"]).select("g", F.round("entropy", 6).alias("entropy"), F.round("simpson", 9).alias("simpson"), F.round("reciprocal", 6).alias("reciprocal"))


@query(
    "dv3_compare",
    """WITH x AS (SELECT user_id AS k, count(*)::DOUBLE AS x FROM events WHERE event_type = 'click' GROUP BY 1), y AS (SELECT user_id AS k, count(*)::DOUBLE AS y FROM events WHERE event_type = 'view' GROUP BY 1),
    j AS (SELECT coalesce(x, 0) / sum(coalesce(x, 0)) OVER () AS p, coalesce(y, 0) / sum(coalesce(y, 0)) OVER () AS q FROM x FULL JOIN y USING (k))
    SELECT round(sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END), 6) AS kl, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS jsd, round(2 * sum(p * q) / (sum(p * p) + sum(q * q)), 6) AS morisita_horn FROM j""",
)
def dv3(spark, d):
    c = _counts(spark, d)
    return rounded(E.compare_distributions(c.where("g = 'click'"), c.where("g = 'view'"), "k", "n"), 6)


@query(
    "dv5_generalized_simpson",
    f"WITH {_CNT}, t AS (SELECT *, sum(n) OVER (PARTITION BY g) AS t FROM c) SELECT g, 1 AS \"order\", round(sum(n / t), 6) AS z FROM t GROUP BY 1 UNION ALL SELECT g, 2, round(sum(n / t * (1 - (n - 1) / (t - 1))), 6) FROM t GROUP BY 1 UNION ALL SELECT g, 3, round(sum(n / t * (1 - (n - 1) / (t - 1)) * (1 - (n - 1) / (t - 2))), 6) FROM t GROUP BY 1",
)
def dv5(spark, d):
    return E.generalized_simpson(_counts(spark, d), "n", [1, 2, 3], ["g"]).select("g", "order", F.round("z", 6).alias("z"))


@query("dv5_simpson_interval")
def dv5_interval(spark, d):
    return E.generalized_simpson(_counts(spark, d), "n", [2, 3, 4], ["g"])


@query(
    "dv7_fuzzy",
    """WITH c AS (SELECT p_size AS k, count(*) AS n FROM part GROUP BY 1) SELECT round((SELECT sum(a.n * b.n) FROM c a JOIN c b ON a.k < b.k AND b.k - a.k < 3) / (SELECT sum(n) ** 2 FROM c), 9) AS diversity""",
)
def dv7(spark, d):
    c = load(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    dist = c.select(F.col("k").alias("i"), F.explode(F.sequence(F.col("k") + 1, F.col("k") + 5)).alias("j")).withColumn("d", F.col("j") - F.col("i"))
    return E.fuzzy_diversity(c, "k", "n", dist, 3).select(F.round("diversity", 9).alias("diversity"))


_OTU = "o AS (SELECT l_suppkey % 25 AS s, l_returnflag || l_linestatus AS f, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _otu(spark, d):
    return load(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("s"), F.concat("l_returnflag", "l_linestatus").alias("f")).agg(F.sum("l_quantity").alias("v"))


@query("cp1_log_ratios", f"WITH {_OTU} SELECT a.s, a.f AS i, b.f AS j, round(ln(b.v) - ln(a.v), 6) AS log_ratio FROM o a JOIN o b ON a.s = b.s AND a.f < b.f")
def cp1(spark, d):
    return rounded(E.log_ratios(_otu(spark, d), "s", "f", "v"), 6)


@query("cp2_clr", f"WITH {_OTU}, p AS (SELECT s, f, v / sum(v) OVER (PARTITION BY s) AS p FROM o) SELECT s, f, round(ln(p) - avg(ln(p)) OVER (PARTITION BY s), 6) AS clr FROM p")
def cp2(spark, d):
    return rounded(E.centred_log_ratio(_otu(spark, d), "s", "f", "v"), 6)


@query("em3_density")
def em3(spark, d):
    p = load(spark, d, "part").select((F.col("p_size") / 10).alias("x"), (F.col("p_retailprice") / 500).alias("y"))
    return E.kernel_density(p, "x", "y", 40, 0.2)


@query(
    "em4_ellipse",
    """WITH s AS (SELECT p_brand, avg(p_size) AS cx, avg(p_retailprice) AS cy, var_samp(p_size) AS a, var_samp(p_retailprice) AS c, covar_samp(p_size, p_retailprice) AS b FROM part GROUP BY 1), e AS (SELECT *, (a + c) / 2 AS m, sqrt(((a - c) / 2) ** 2 + b ** 2) AS g FROM s)
    SELECT p_brand, round(cx, 4) AS cx, round(cy, 4) AS cy, round(4 * sqrt(m + g), 4) AS width, round(4 * sqrt(greatest(m - g, 0)), 4) AS height, round(degrees(atan2(m + g - a, b)), 4) AS angle FROM e""",
)
def em4(spark, d):
    return rounded(E.covariance_ellipse(load(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"]), 4)
