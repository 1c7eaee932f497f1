"""Likelihood fits, the gap statistic and the feather format over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions.distributions import normal_cdf_sql
from quillon.operators import comparisons as C
from quillon.operators import gap as G
from quillon.operators import regression as R
from quillon.plans.registry import query
from quillon.plans.statistics import Z, _SURV_SQL, _surv, fisher_sql, rounded
from quillon.session import load, shared_dir
from quillon.sources import feather

# --- SV4: the peak by Newton's steps here, by bisection of the score in SQL

_SCORE = "sum(d1 - d * n1 * exp(({b})) / (n1 * exp(({b})) + n - n1))"
_COX = f"""WITH RECURSIVE {_SURV_SQL},
c AS (SELECT dur, count(*) AS l, count(*) FILTER (arm) AS l1, count(*) FILTER (ev) AS d, count(*) FILTER (ev AND arm) AS d1 FROM v GROUP BY 1),
r AS (SELECT * FROM (SELECT d, d1, sum(l) OVER (ORDER BY dur DESC) AS n, sum(l1) OVER (ORDER BY dur DESC) AS n1 FROM c) WHERE d > 0),
bis AS (SELECT 0 AS k, -16::DOUBLE AS lo, 16::DOUBLE AS hi
  UNION ALL SELECT k + 1, CASE WHEN {_SCORE.format(b='(lo + hi) / 2')} > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_SCORE.format(b='(lo + hi) / 2')} > 0 THEN hi ELSE (lo + hi) / 2 END
  FROM bis, r WHERE k < 52 GROUP BY k, lo, hi),
b AS (SELECT (lo + hi) / 2 AS b FROM bis WHERE k = 52),
e AS (SELECT b, 1 / sqrt(sum(d * n1 * exp(b) / (n1 * exp(b) + n - n1) * (1 - n1 * exp(b) / (n1 * exp(b) + n - n1)))) AS se FROM r, b GROUP BY b)
SELECT round(b, 6) AS log_ratio, round(se, 6) AS se, round(exp(b), 6) AS ratio, round(exp(b - {Z} * se), 6) AS lo, round(exp(b + {Z} * se), 6) AS hi, round(2 * {normal_cdf_sql('-abs(b / se)')}, 6) AS p FROM e"""


@query("sv4_cox", _COX)
def sv4_cox(spark, d):
    return rounded(C.cox_two_arms(_surv(spark, d), "dur", F.col("ev"), F.col("arm")), 6)


def _cohort(spark, d):
    """Orders as a cohort: time, event, two covariates, strata, and whether an order is in the subcohort."""
    o = load(spark, d, "orders")
    v = F.col("o_orderkey")
    draw = F.conv(F.substring(F.md5(v.cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return o.select(v.alias("id"), (days % 400 + 1).cast("double").alias("time"), (F.col("o_orderstatus") == "F").alias("event"), (F.col("o_totalprice") / 100_000).alias("price"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), (F.col("o_custkey") % 4).alias("stratum"), draw.alias("draw"), (F.col("o_custkey") % 3 + 1).cast("double").alias("w"))


@query("sv4_cox_regression")
def sv4_cox_regression(spark, d):
    return R.cox_regression(_cohort(spark, d), "time", F.col("event"), ["price", "urgent"], F.col("w"), "stratum", "id", robust=True)


@query("ro19_case_cohort")
def ro19_case_cohort(spark, d):
    whole = _cohort(spark, d)
    sizes = whole.where("NOT event").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return R.case_cohort(whole.where("event OR draw < 0.3"), "time", F.col("event"), ["price", "urgent"], "stratum", sizes)


@query("ro19_two_phase_logistic")
def ro19_two_phase(spark, d):
    whole = _cohort(spark, d).withColumn("y", F.col("event").cast("int"))
    sizes = whole.groupBy("stratum", "y").agg(F.count(F.lit(1)).alias("n"))
    return R.two_phase_logistic(whole.where("draw < 0.3"), "y", ["price", "urgent"], "stratum", sizes)


@query("ro18_beta_binomial")
def ro18(spark, d):
    """Of each of twelve classes of orders: lines of an order with a large quantity against its mean price, with Wald tests."""
    li = load(spark, d, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 30).alias("y"), F.count(F.lit(1)).alias("m"), (F.avg("l_extendedprice") / 10_000).alias("price"))
    rows = rows.withColumn("taxon", F.col("l_orderkey") % 12)
    return R.wald_tests(R.beta_binomial(rows, ["taxon"], "y", "m", ["price"]), ["taxon"], ["intercept", "price", "dispersion"])


@query("ro11_logistic_newton")
def ro11_newton(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "F").cast("int").alias("y"), (F.col("l_quantity") / 10).alias("q"), (F.col("l_discount") * 10).alias("disc"))
    return R.coefficients(R.logistic_fits(li.where("l_returnflag = 'N'"), ["l_returnflag"], "y", ["q", "disc"]), ["l_returnflag"], ["intercept", "q", "disc"])


@query("rs6_optimism")
def rs6(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("x1"), (F.col("p_retailprice") / 1000).alias("x2"), (F.pmod(F.xxhash64("p_name"), F.lit(100)) / 100).alias("x3"))
    p = p.withColumn("y", (F.col("x1") + F.pmod(F.xxhash64("p_partkey"), F.lit(100)) / 100 > 1.0).cast("int"))
    return R.optimism_bootstrap(p, "p_partkey", "y", ["x1", "x2", "x3"], n=40)


# --- ST3 with weights

_EDGE = "SELECT coalesce(nullif(sum(w) FILTER (x AND y), 0), 1)::DOUBLE AS a, coalesce(nullif(sum(w) FILTER (x AND NOT y), 0), 1)::DOUBLE AS b, coalesce(nullif(sum(w) FILTER (NOT x AND y), 0), 1)::DOUBLE AS c, coalesce(nullif(sum(w) FILTER (NOT x AND NOT y), 0), 1)::DOUBLE AS d FROM (SELECT l_returnflag = 'R' AS x, l_linestatus = 'F' AS y, {w}::DOUBLE AS w FROM lineitem WHERE l_linenumber = 7)"


@query("st3_edge_weighted", f"WITH f AS ({_EDGE.format(w='l_discount')}), t AS (SELECT a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d FROM ({_EDGE.format(w='(l_linenumber - 5)')})) SELECT 'fraction' AS weight, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, round(a * d / (b * c), 6) AS odds_ratio, NULL::DOUBLE AS p FROM f UNION ALL SELECT 'whole', a, b, c, d, round(a * d / (b * c), 6), round({fisher_sql('two-sided')}, 6) FROM t")
def st3_weighted(spark, d):
    li = load(spark, d, "lineitem").where("l_linenumber = 7")
    test = lambda name, w: C.edge_test(li, F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", w).select(F.lit(name).alias("weight"), "*")
    return rounded(test("fraction", F.col("l_discount")).unionByName(test("whole", (F.col("l_linenumber") - 5).cast("double"))), 6)


# --- SNK2, SRC3


@query("snk2_feather", "SELECT * EXCLUDE (l_shipdate), l_shipdate FROM lineitem")
def snk2(spark, d):
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    feather.write(load(spark, d, "lineitem"), path)
    return feather.read(spark, path)


@query("src3_feather_columns", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def src3(spark, d):
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    feather.write(load(spark, d, "orders"), path)
    rows = feather.read(spark, path, ["o_totalprice", "o_orderstatus"])
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("snk2_merge_feather", "SELECT o_orderkey AS k, o_orderstatus AS status, NULL::DOUBLE AS price FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderkey % 2 = 1")
def snk2_merge(spark, d):
    base, o = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}", load(spark, d, "orders")
    feather.write(o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")), f"{base}/a")
    feather.write(o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), f"{base}/b")
    feather.merge(spark, [f"{base}/a", f"{base}/b"], f"{base}/out", delete_sources=True)
    return feather.read(spark, f"{base}/out")


# --- CLU2


@query("clu2_gap")
def clu2_gap(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3 * 10 + F.pmod(F.xxhash64("s_name"), F.lit(100)) / 100).alias("a"), (F.col("s_nationkey") % 2 * 7 + F.col("s_acctbal") / 10_000).alias("b"))
    return G.gap_statistic(s, "s_suppkey", ["a", "b"], most=8, n=8)
