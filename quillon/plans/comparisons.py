"""Queries of the composed operators: responses, cross correlation, composition tests, intervals of ratios, alignment."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from quillon.functions.distributions import normal_cdf_sql
from quillon.operators import aggregates as A
from quillon.operators import comparisons as C
from quillon.operators import estimators as E
from quillon.operators import models as M
from quillon.operators.blocks import PairTable, points
from quillon.plans.inference import _K, _distances
from quillon.plans.registry import query
from quillon.plans.statistics import Z, _OTU, _SURV_SQL, _TAB_SQL, _WIDE_SQL, _otu, _surv, _table, _wide, fisher_sql, rounded
from quillon.session import load, shared_dir
from quillon.sources import readers, sinks


# --- assay responses

_GATES = "c AS (SELECT l_linestatus AS k, l_quantity > 25 AS big, l_extendedprice > 30000 AS dear, l_discount > 0.05 AS disc, l_tax > 0.04 AS tax, l_returnflag = 'R' AS ret FROM lineitem), u AS (SELECT k, 'big' AS subset, disc, tax, ret FROM c WHERE big UNION ALL SELECT k, 'dear', disc, tax, ret FROM c WHERE dear)"
_SIGN = lambda c: f"'{c}' || CASE WHEN {c} THEN '+' ELSE '-' END"
_GRID = "g AS (SELECT DISTINCT {keys}subset, d.x AS disc, t.x AS tax, r.x AS ret FROM u, (VALUES (true), (false)) d(x), (VALUES (true), (false)) t(x), (VALUES (true), (false)) r(x)), n AS (SELECT g.*, (SELECT count(*) FROM u WHERE {same}u.subset = g.subset AND u.disc = g.disc AND u.tax = g.tax AND u.ret = g.ret) AS cytnum FROM g)"


def _gates(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(F.col("l_linestatus").alias("k"), (F.col("l_quantity") > 25).alias("big"), (F.col("l_extendedprice") > 30000).alias("dear"), (F.col("l_discount") > 0.05).alias("disc"), (F.col("l_tax") > 0.04).alias("tax"), (F.col("l_returnflag") == "R").alias("ret"))


@query("agg7_function_markers", f"WITH {_GATES}, {_GRID.format(keys='', same='')} SELECT subset, {_SIGN('disc')} || {_SIGN('tax')} AS cytokine, {_SIGN('ret')} AS marker, cytnum, sum(cytnum) OVER (PARTITION BY subset)::BIGINT AS nsub, sum(cytnum) OVER (PARTITION BY subset, disc, tax)::BIGINT AS nsub_cyt FROM n")
def agg7(spark, d):
    return C.function_markers(_gates(spark, d), ["big", "dear"], ["disc", "tax"], ["ret"])


@query("agg9_function_markers_by", f"WITH {_GATES}, {_GRID.format(keys='k, ', same='u.k = g.k AND ')}, m AS (SELECT k, subset, {_SIGN('ret')} AS marker, sum(cytnum)::BIGINT AS cytnum, (SELECT count(*) FROM u WHERE u.k = n.k AND u.subset = n.subset) AS nsub FROM n WHERE disc OR tax GROUP BY 1, 2, 3) SELECT k, subset, '1+' AS cytokine, marker, cytnum, nsub::DOUBLE AS nsub, sum(cytnum) OVER (PARTITION BY k, subset)::BIGINT AS nsub_cyt FROM m")
def agg9(spark, d):
    return C.function_markers(_gates(spark, d), ["big", "dear"], ["disc", "tax"], ["ret"], ["k"], least=1)


_ASSAY = "e AS (SELECT user_id AS u, event_type AS antigen, count(*) FILTER (value > 50) AS k, count(*) AS n FROM events GROUP BY 1, 2)"


def _assay(spark, d):
    return load(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("antigen")).agg(F.count_if(F.col("value") > 50).alias("k"), F.count(F.lit(1)).alias("n"))


@query(
    "st6_response_p",
    f"""WITH {_ASSAY}, c AS (SELECT u, sum(k)::BIGINT AS k0, sum(n)::BIGINT AS n0 FROM e WHERE antigen = 'view' GROUP BY 1), t AS (SELECT e.u, antigen, k, n, k0, n0, k AS a, n - k AS b, k0 AS c, n0 - k0 AS d FROM e LEFT JOIN c USING (u) WHERE antigen <> 'view')
    SELECT u, antigen, k AS count_pos, n AS total_pos, k0 AS count_neg, n0 AS total_neg, round(a * d / nullif(b * c, 0), 6) AS odds_ratio, CASE WHEN k0 IS NOT NULL AND 100 * k / n <= 60 THEN round({fisher_sql('greater')}, 6) END AS p, round(k0 / n0, 6) AS bg, round(k / n, 6) AS mag, round(k / n - k0 / n0, 6) AS mag_adj FROM t""",
)
def st6(spark, d):
    return rounded(C.response_p_values(_assay(spark, d), ["u"], "antigen", "view", "k", "n", 60), 6)


@query("agg16_member_weights", f"WITH {_ASSAY} SELECT u, sum(n)::BIGINT AS weight FROM e WHERE u IN (SELECT user_id FROM events WHERE value > 90) GROUP BY 1")
def agg16(spark, d):
    members = load(spark, d, "events").where("value > 90").select(F.col("user_id").alias("u"))
    return C.member_weights(members, _assay(spark, d), "u", "antigen", "n")


_CALLS = f"{_TAB_SQL}, p AS (SELECT k % 50 AS r, CASE k % 3 WHEN 0 THEN 'x+y-' WHEN 1 THEN 'x-y-' ELSE 'x+y+' END AS c, min({fisher_sql('two-sided')}) AS p FROM t GROUP BY 1, 2)"


@query("piv5_calls", f"WITH {_CALLS} SELECT r, coalesce(string_agg(c, ',' ORDER BY -(length(c) - length(replace(c, '+', ''))), c) FILTER (p < 0.4), '') AS calls FROM p GROUP BY 1")
def piv5(spark, d):
    from quillon.operators.tests import fisher_exact

    t = _table(spark, d).withColumn("p", fisher_exact("a", "b", "c", "d"))
    name = F.when(F.col("k") % 3 == 0, "x+y-").when(F.col("k") % 3 == 1, "x-y-").otherwise("x+y+")
    return C.response_calls(t.groupBy((F.col("k") % 50).alias("r"), name.alias("c")).agg(F.min("p").alias("p")), "r", "c", "p", 0.4)


_BATCH = "b AS (SELECT * FROM (SELECT 'batch_' || l_returnflag AS batch, l_discount > 0.05 AS disc, l_tax > 0.04 AS tax FROM lineitem WHERE l_quantity > 25) WHERE batch IN ('batch_A', 'batch_R')), g AS (SELECT DISTINCT batch, d.x AS disc, t.x AS tax FROM b, (VALUES (true), (false)) d(x), (VALUES (true), (false)) t(x))"


@query("agg20_merge_batches", f"WITH {_BATCH} SELECT batch, {_SIGN('disc')} || {_SIGN('tax')} AS combination, (SELECT count(*) FROM b WHERE b.batch = g.batch AND b.disc = g.disc AND b.tax = g.tax) AS cytnum, (SELECT count(*) FROM b WHERE b.batch = g.batch) AS nsub, CASE batch WHEN 'batch_A' THEN 'one' ELSE 'two' END AS lab FROM g")
def agg20(spark, d):
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    gates = load(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).alias("big"), (F.col("l_discount") > 0.05).alias("disc"), (F.col("l_tax") > 0.04).alias("tax"))
    for flag in "ANR":
        gates.where(F.col("l_returnflag") == flag).drop("l_returnflag").write.parquet(f"{path}/batch_{flag}")
    labels = spark.createDataFrame([("batch_A", "one", "x"), ("batch_N", "one", "y"), ("batch_R", "two", "x")], "batch string, lab string, kind string")
    extract = lambda rows, keys: A.gate_counts(rows, ["big"], ["disc", "tax"], keys)
    out = C.merge_samples(readers.read_batches(spark, f"{path}/*"), extract, labels, "batch", {"kind": ["x"]})
    return out.select("batch", "combination", "cytnum", "nsub", "lab")


@query(
    "st5_graph",
    f"""WITH l AS (SELECT o_orderkey AS r, 'o_orderstatus' AS c, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders), n AS (SELECT count(*) AS n FROM orders), m AS (SELECT c, v, count(*) AS m FROM l GROUP BY 1, 2),
    j AS (SELECT x.c AS c1, x.v AS v1, y.c AS c2, y.v AS v2, count(*) AS a FROM l x JOIN l y ON x.r = y.r AND x.c < y.c GROUP BY 1, 2, 3, 4),
    t AS (SELECT c1, v1, c2, v2, a, greatest(m1.m - a, 1) AS b, greatest(m2.m - a, 1) AS c, greatest(n - m1.m - m2.m + a, 1) AS d, m1.m / n AS f1, m2.m / n AS f2, a / n AS w FROM n, j JOIN m m1 ON c1 = m1.c AND v1 = m1.v JOIN m m2 ON c2 = m2.c AND v2 = m2.v)
    SELECT v1, v2, round(f1, 9) AS freq1, round(f2, 9) AS freq2, round(w, 9) AS weight, round(a * d / (b * c), 5) AS odds_ratio, round({fisher_sql('two-sided')}, 5) AS p FROM t""",
)
def st5(spark, d):
    nodes, edges = C.relation_graph(load(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    side = lambda k: nodes.select(F.col("c").alias(f"c{k}"), F.col("v").alias(f"v{k}"), F.round("freq", 9).alias(f"freq{k}"))
    out = edges.join(side(1), ["c1", "v1"]).join(side(2), ["c2", "v2"])
    return out.select("v1", "v2", "freq1", "freq2", F.round("weight", 9).alias("weight"), F.round("odds_ratio", 5).alias("odds_ratio"), F.round("p", 5).alias("p"))


# --- correlations

_PAIR = "SELECT '{0}' AS a, '{1}' AS b, count(*) FILTER ({0} IS NOT NULL AND {1} IS NOT NULL) AS n, round((SELECT (corr({0}, {1}) - corr({0}, z) * corr({1}, z)) / sqrt((1 - corr({0}, z) ** 2) * (1 - corr({1}, z) ** 2)) FROM x WHERE {0} IS NOT NULL AND {1} IS NOT NULL), 6) AS rho FROM x"


@query("co3_condensed", f"WITH {_WIDE_SQL} SELECT 0 AS k, 'q' AS a, 'd' AS b, round(corr(q, d), 6) AS rho FROM w UNION ALL SELECT 1, 'q', 't', round(corr(q, t), 6) FROM w UNION ALL SELECT 2, 'd', 't', round(corr(d, t), 6) FROM w")
def co3(spark, d):
    from quillon.operators.association import correlations

    columns = ["q", "d", "t"]
    return C.condensed_correlations(correlations(_wide(spark, d), "id", columns), columns).select("k", "a", "b", F.round("rho", 6).alias("rho"))


@query("co6_partial_pairs", f"WITH {_WIDE_SQL}, x AS (SELECT *, (id % 13)::DOUBLE AS z FROM w) " + " UNION ALL ".join(_PAIR.format(a, b) for a in "qdt" for b in "qdt" if a != b) + " UNION ALL SELECT v, v, 0, 1 FROM (VALUES ('q'), ('d'), ('t')) t(v)")
def co6(spark, d):
    w = _wide(spark, d).withColumn("z", (F.col("id") % 13).cast("double"))
    return C.partial_correlations(w, ["q", "d", "t"], ["q", "d", "t"], ["z"]).select("a", "b", "n", F.round("rho", 6).alias("rho"))


@query("co7_cross", "WITH j AS (SELECT c_acctbal AS x, c_nationkey AS y, o_totalprice AS v FROM customer JOIN (SELECT o_custkey AS c_custkey, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) USING (c_custkey)) SELECT 'c_acctbal_A' AS a, 'o_totalprice_B' AS b, count(*) AS n, round(corr(x, v), 6) AS rho FROM j UNION ALL SELECT 'c_nationkey_A', 'o_totalprice_B', count(*), round(corr(y, v), 6) FROM j")
def co7(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("o_totalprice"))
    return C.cross_correlations(load(spark, d, "customer"), o, "c_custkey", ["c_acctbal", "c_nationkey"], ["o_totalprice"]).select("a", "b", "n", F.round("rho", 6).alias("rho"))


# --- compositions

_SHUFFLED = """l AS (SELECT s, s % 2 = 0 AS lab, row_number() OVER (ORDER BY s) AS k FROM (SELECT DISTINCT s FROM o)),
    r AS (SELECT rep, s, row_number() OVER (PARTITION BY rep ORDER BY md5(s || ':' || rep || ':0'), s) AS k FROM l, range(0, 60) t(rep)),
    m AS (SELECT -1 AS rep, s, lab FROM l UNION ALL SELECT rep, r.s, l.lab FROM r JOIN l USING (k))"""
_CLR = "v AS (SELECT s, f, ln(v) - avg(ln(v)) OVER (PARTITION BY s) AS x FROM o)"
_DMEAN = "avg(x) FILTER (lab) - avg(x) FILTER (NOT lab)"
_BH = "h AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS i, count(*) OVER () AS t FROM e), q AS (SELECT *, min(least(1.0, p * t / i)) OVER (ORDER BY p DESC) AS q FROM h)"


def _labels(spark, d):
    return _otu(spark, d).select("s").distinct().withColumn("lab", F.col("s") % 2 == 0)


@query("cp4_clr_tests", f"WITH {_OTU}, {_SHUFFLED}, {_CLR}, z AS (SELECT rep, f, {_DMEAN} AS d FROM v JOIN m USING (s) GROUP BY 1, 2), e AS (SELECT f, max(b.d) AS observed, (count(*) FILTER (abs(z.d) >= abs(b.d) - 1e-12) + 1) / 61 AS p FROM z JOIN (SELECT f, d FROM z WHERE rep = -1) b USING (f) WHERE rep >= 0 GROUP BY 1), {_BH} SELECT f, round(observed, 9) AS observed, round(p, 9) AS p, round(q, 9) AS q FROM q")
def cp4(spark, d):
    return rounded(C.clr_label_tests(_otu(spark, d), "s", "f", "v", _labels(spark, d), "lab", 60), 9)


_RHO = _SHUFFLED.replace("s % 2 = 0 AS lab,", "rank() OVER (ORDER BY s % 7) + (count(*) OVER (PARTITION BY s % 7) - 1) / 2 AS lab,")


@query(
    "cp3_global_rho",
    f"WITH {_OTU}, {_RHO}, v AS (SELECT s, f, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2 AS x FROM o), z AS (SELECT rep, f, corr(x, lab) AS d FROM v JOIN m USING (s) GROUP BY 1, 2), w AS (SELECT rep, sum(d * d) AS d FROM z GROUP BY 1) SELECT round(b.d, 9) AS observed, round((count(*) FILTER (w.d >= b.d - 1e-12) + 1) / 61, 9) AS p FROM w, (SELECT d FROM w WHERE rep = -1) b WHERE rep >= 0 GROUP BY b.d",
)
def cp3_rho(spark, d):
    otu = _otu(spark, d)
    return rounded(C.global_label_test(otu, "s", ["f"], "v", otu.select("s").distinct().withColumn("lab", F.col("s") % 7), "lab", 60, "rho"), 9)


@query("cp3_global_test", f"WITH {_OTU}, {_SHUFFLED}, {_CLR}, z AS (SELECT rep, f, {_DMEAN} AS d FROM v JOIN m USING (s) GROUP BY 1, 2), w AS (SELECT rep, sum(d * d) AS d FROM z GROUP BY 1) SELECT round(b.d, 9) AS observed, round((count(*) FILTER (w.d >= b.d - 1e-12) + 1) / 61, 9) AS p FROM w, (SELECT d FROM w WHERE rep = -1) b WHERE rep >= 0 GROUP BY b.d")
def cp3(spark, d):
    values = E.centred_log_ratio(_otu(spark, d), "s", "f", "v")
    return rounded(C.global_label_test(values, "s", ["f"], "clr", _labels(spark, d), "lab", 60), 9)


@query("cp5_composition_tests", f"WITH {_OTU}, {_SHUFFLED}, v AS (SELECT a.s, a.f AS i, b.f AS j, ln(b.v) - ln(a.v) AS x FROM o a JOIN o b ON a.s = b.s AND a.f < b.f), z AS (SELECT rep, i, j, {_DMEAN} AS d FROM v JOIN m USING (s) GROUP BY 1, 2, 3), e AS (SELECT i, j, (count(*) FILTER (abs(z.d) >= abs(b.d) - 1e-12) + 1) / 61 AS p FROM z JOIN (SELECT i, j, d FROM z WHERE rep = -1) b USING (i, j) WHERE rep >= 0 GROUP BY 1, 2), {_BH.replace(' AS i, count', ' AS k, count').replace('t / i', 't / k')}, n AS (SELECT i AS f, q FROM q UNION ALL SELECT j, q FROM q) SELECT f, count(*) FILTER (q < 0.6) AS w, count(*) FILTER (q < 0.6) >= (SELECT count(DISTINCT f) FROM o) - 1 AS rejected FROM n GROUP BY 1")
def cp5(spark, d):
    return C.composition_tests(_otu(spark, d), "s", "f", "v", _labels(spark, d), "lab", 0.6, 60)


@query("cp6_abundance", "WITH o AS (SELECT l_suppkey % 25 AS s, l_partkey % 7 AS f, sum(CASE WHEN l_linenumber = 5 AND l_suppkey % 25 < 20 THEN 0 WHEN l_partkey % 7 = 3 THEN 0.001 ELSE l_quantity END) FILTER (l_linenumber > 4)::DOUBLE AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT f FROM o GROUP BY 1 HAVING sum(v) > 0.005 * (SELECT sum(v) FROM o) AND count(DISTINCT s) FILTER (v > 0) > 0.25 * (SELECT count(DISTINCT s) FROM o)), k AS (SELECT *, count(*) OVER w AS d, v / sum(v) OVER w AS p, count(*) FILTER (v = 0) OVER w AS z FROM o WHERE f IN (FROM g) WINDOW w AS (PARTITION BY s)) SELECT s, f, round(CASE WHEN v = 0 THEN 1 / (d * d) ELSE (1 - z / (d * d)) * p END, 9) AS v FROM k")
def cp6(spark, d):
    v = F.when((F.col("l_linenumber") == 5) & (F.col("l_suppkey") % 25 < 20), F.lit(0.0)).when(F.col("l_partkey") % 7 == 3, F.lit(0.001)).otherwise(F.col("l_quantity"))
    o = load(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("s"), (F.col("l_partkey") % 7).alias("f")).agg(F.sum(F.when(F.col("l_linenumber") > 4, v)).alias("v"))
    return rounded(C.load_abundance(o, "s", "f", "v"), 9)


# --- ratios

_RR = "CASE WHEN a > 0 AND c > 0 THEN {0} END"


@query("st3_edge", f"WITH t AS (SELECT greatest(1, count(*) FILTER (x AND y)) AS a, greatest(1, count(*) FILTER (x AND NOT y)) AS b, greatest(1, count(*) FILTER (NOT x AND y)) AS c, greatest(1, count(*) FILTER (NOT x AND NOT y)) AS d FROM (SELECT o_orderstatus = 'F' AS x, o_orderpriority = '1-URGENT' AS y FROM orders)) SELECT a, b, c, d, round(a * d / (b * c), 6) AS odds_ratio, round({fisher_sql('two-sided')}, 6) AS p FROM t")
def st3(spark, d):
    return rounded(C.edge_test(load(spark, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"), 6)


@query("st18_relative_risk", f"WITH {_TAB_SQL}, r AS (SELECT k, a, c, a / (a + b) / (c / (c + d)) AS rr, sqrt(1 / a + 1 / c - 1 / (a + b) - 1 / (c + d)) AS se, (a + 0.5) / (a + b + 1) / ((c + 0.5) / (c + d + 1)) AS ra, sqrt(1 / (a + 0.5) + 1 / (c + 0.5) - 1 / (a + b + 1) - 1 / (c + d + 1)) AS sa FROM t WHERE a > 0 AND c > 0) SELECT k, round(rr, 6) AS rr, round(exp(ln(rr) - {Z} * se), 6) AS lo, round(exp(ln(rr) + {Z} * se), 6) AS hi, round(ra, 6) AS rr_adj, round(exp(ln(ra) - {Z} * sa), 6) AS lo_adj FROM r")
def st18(spark, d):
    t = _table(spark, d).where("a > 0 AND c > 0")
    rr, lo, hi, _ = C.relative_risk("a", "b", "c", "d")
    ra, la, _, _ = C.relative_risk("a", "b", "c", "d", method="adj-log")
    return rounded(t.select("k", rr.alias("rr"), lo.alias("lo"), hi.alias("hi"), ra.alias("rr_adj"), la.alias("lo_adj")), 6)


@query("st17_efficacy", f"WITH {_TAB_SQL}, r AS (SELECT k, a / (a + b) / (c / (c + d)) AS rr, sqrt(b / (a * (a + b)) + d / (c * (c + d))) AS se, a / (a + c) AS s, a + c AS e, (c + d) / (a + b) AS w FROM t WHERE a > 0 AND c > 0), i AS (SELECT *, (s + {Z}**2 / (2 * e) + {Z} * sqrt((s * (1 - s) + {Z}**2 / (4 * e)) / e)) / (1 + {Z}**2 / e) AS hi, (s + {Z}**2 / (2 * e) - {Z} * sqrt((s * (1 - s) + {Z}**2 / (4 * e)) / e)) / (1 + {Z}**2 / e) AS lo FROM r) SELECT k, round(1 - rr, 6) AS ve, round(1 - exp(ln(rr) + {Z} * se), 6) AS ll, round(1 - exp(ln(rr) - {Z} * se), 6) AS ul, round(1 - w * s / (1 - s), 6) AS ve_c, round(1 - w * hi / (1 - hi), 6) AS ll_c, round(1 - w * lo / (1 - lo), 6) AS ul_c FROM i")
def st17(spark, d):
    t = _table(spark, d).where("a > 0 AND c > 0").withColumns({"n": F.col("a") + F.col("b"), "m": F.col("c") + F.col("d")})
    ve, ll, ul, _ = C.unconditional_efficacy("a", "n", "c", "m")
    vc, lc, uc, _ = C.conditional_efficacy("a", "n", "c", "m")
    return rounded(t.select("k", ve.alias("ve"), ll.alias("ll"), ul.alias("ul"), vc.alias("ve_c"), lc.alias("ll_c"), uc.alias("ul_c")), 6)


_WILSON = lambda x, n, s: f"round(({x} / ({n}) + {Z}**2 / (2 * ({n})) {s} {Z} * sqrt(({x} / ({n}) * (1 - {x} / ({n})) + {Z}**2 / (4 * ({n}))) / ({n}))) / (1 + {Z}**2 / ({n})), 6)"


@query("st19_rate_intervals", f"WITH {_TAB_SQL} SELECT k, a, b, c, d, round(a / (a + c), 6) AS sens, {_WILSON('a', 'a + c', '-')} AS sens_lo, {_WILSON('a', 'a + c', '+')} AS sens_hi, round(d / (b + d), 6) AS spec, {_WILSON('d', 'b + d', '-')} AS spec_lo, {_WILSON('d', 'b + d', '+')} AS spec_hi FROM t")
def st19(spark, d):
    return rounded(C.rate_intervals(_table(spark, d)), 6)


@query("ro3_by_outcome", "SELECT l_linenumber, count(*) FILTER (p AND o) AS a, count(*) FILTER (NOT p AND o) AS b, count(*) FILTER (p AND NOT o) AS c, count(*) FILTER (NOT p AND NOT o) AS d FROM (SELECT l_linenumber, l_discount > 0.05 AS p, l_quantity > 25 AS o FROM lineitem) GROUP BY 1")
def ro3(spark, d):
    return C.confusion_by_outcome(load(spark, d, "lineitem"), F.col("l_discount") > 0.05, F.col("l_quantity") > 25, ["l_linenumber"]).select("l_linenumber", "a", "b", "c", "d")


@query("ro6_paired_auc", "WITH g AS (SELECT p_brand, p_size - p_partkey % 50 AS g FROM part), x AS (SELECT p_brand, g AS s, 0 AS o FROM g UNION ALL SELECT p_brand, -g, 1 FROM g), r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY p_brand, s) - 1) / 2 AS r FROM x WINDOW w AS (PARTITION BY p_brand ORDER BY s)) SELECT p_brand, count(*) // 2 AS n, round((sum(r) FILTER (o = 1) - (count(*) / 2) * (count(*) / 2 + 1) / 2) / ((count(*) / 2) ** 2), 9) AS auc FROM r GROUP BY 1")
def ro6(spark, d):
    p = load(spark, d, "part").select("p_brand", "p_size", (F.col("p_partkey") % 50).alias("other"))
    return rounded(C.paired_auc(p, "p_size", "other", ["p_brand"]), 9)


_Z2 = "SELECT sum(n / t * (1 - (n - 1) / (t - 1))) AS z, sqrt(greatest(0, sum(n / t * (1 - n / t - n / t) ** 2) - sum(n / t * (1 - n / t - n / t)) ** 2) / max(t)) AS s FROM (SELECT n, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM events WHERE event_type = '{0}' GROUP BY user_id))"


@query("dv6_simpson_difference", f"SELECT 2 AS \"order\", round(a.z - b.z, 9) AS difference, round(a.z - b.z - {Z} * sqrt(a.s ** 2 + b.s ** 2), 9) AS lo, round(a.z - b.z + {Z} * sqrt(a.s ** 2 + b.s ** 2), 9) AS hi FROM ({_Z2.format('click')}) a, ({_Z2.format('view')}) b")
def dv6(spark, d):
    c = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(C.simpson_difference(c.where("event_type = 'click'"), c.where("event_type = 'view'"), "n", [2]), 9)


@query("qt4_replicated", "WITH r AS (SELECT p_retailprice AS v, unnest(range(0, round(p_size * 2000 / (SELECT sum(p_size) FROM part))::INT)) AS k FROM part) SELECT 0.25::DOUBLE AS share, round(quantile_cont(v, 0.25), 6) AS value FROM r UNION ALL SELECT 0.9, round(quantile_cont(v, 0.9), 6) FROM r")
def qt4(spark, d):
    return rounded(C.replicated_percentiles(load(spark, d, "part"), "p_retailprice", "p_size", [0.25, 0.9], 2000), 6)


# --- alignment

@query("j8_strata_weights", "WITH w AS (SELECT c_mktsegment, c_nationkey, count(*) / 10 AS weight FROM customer GROUP BY 1, 2), i AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS stratum FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey > 3)) SELECT c_custkey, round(weight, 6) AS weight, stratum FROM customer LEFT JOIN w USING (c_mktsegment, c_nationkey) LEFT JOIN i USING (c_nationkey)")
def j8(spark, d):
    from pyspark.sql import Window

    c = load(spark, d, "customer")
    w = c.groupBy("c_mktsegment", "c_nationkey").agg((F.count(F.lit(1)) / 10).alias("weight"))
    i = c.where("c_nationkey > 3").select("c_nationkey").distinct().withColumn("stratum", F.row_number().over(Window.orderBy("c_nationkey")) - 1)
    return C.join_strata_weights(c, w, ["c_mktsegment", "c_nationkey"], i, ["c_nationkey"]).select("c_custkey", F.round("weight", 6).alias("weight"), F.col("stratum").cast("long").alias("stratum"))


@query("j17_common_times", "WITH x AS (SELECT 2 * p_size + p_partkey % 2 AS t, p_partkey % 3 = 0 AS e, p_partkey % 2 AS arm FROM part), c AS (SELECT arm, t, count(*) AS n, count(*) FILTER (e) AS k FROM x GROUP BY 1, 2), r AS (SELECT arm, t, k, sum(n) OVER (PARTITION BY arm ORDER BY t DESC) AS risk FROM c), h AS (SELECT arm, t, sum(k / risk) OVER (PARTITION BY arm ORDER BY t) AS hazard, sum(k / (risk * risk)) OVER (PARTITION BY arm ORDER BY t) AS variance FROM r) SELECT a.arm, g.t AS time, round(coalesce((SELECT arg_max(hazard, h.t) FROM h WHERE h.arm = a.arm AND h.t <= g.t), 0), 9) AS hazard, round(coalesce((SELECT arg_max(variance, h.t) FROM h WHERE h.arm = a.arm AND h.t <= g.t), 0), 9) AS variance FROM (SELECT DISTINCT arm FROM x) a, (SELECT DISTINCT t FROM x) g")
def j17(spark, d):
    k = F.col("p_partkey")
    x = load(spark, d, "part").select((2 * F.col("p_size") + k % 2).alias("t"), (k % 3 == 0).alias("e"), (k % 2).alias("arm"))
    return rounded(C.hazards_on_common_times(x, "t", F.col("e"), ["arm"]), 9)


@query("j19_paired_scores", "SELECT s_suppkey, s_nationkey, a.p AS p_a, b.p AS p_b FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, max(l_tax) AS p FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a USING (s_suppkey) JOIN (SELECT l_suppkey AS s_suppkey, max(l_discount) AS p FROM lineitem WHERE l_quantity < 2 GROUP BY 1) b USING (s_suppkey)")
def j19(spark, d):
    li = load(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    a = li.where("l_quantity > 49").groupBy("s_suppkey").agg(F.max("l_tax").alias("p"))
    b = li.where("l_quantity < 2").groupBy("s_suppkey").agg(F.max("l_discount").alias("p"))
    return C.paired_scores(load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), a, b, "s_suppkey", "p")


@query("srt2_untangle", "WITH a AS (SELECT p_partkey AS k, p_size AS v, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS i FROM part), b AS (SELECT -p_partkey AS k, p_size AS v, row_number() OVER (PARTITION BY p_size ORDER BY -p_partkey) AS i FROM part) SELECT a.k, b.k AS k_b FROM a JOIN b USING (v, i)")
def srt2(spark, d):
    p = load(spark, d, "part")
    return C.untangle(p.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v")), p.select((-F.col("p_partkey")).alias("k"), F.col("p_size").alias("v")), "k", "v")


# --- epitopes and binding

@query("ep5_breadth", "WITH b AS (SELECT o_custkey AS u, count(DISTINCT o_orderpriority) AS breadth FROM orders GROUP BY 1), g AS (SELECT c_custkey AS u, c_mktsegment AS g, coalesce(breadth, 0) AS breadth FROM customer LEFT JOIN b ON u = c_custkey) SELECT u, g, breadth, row_number() OVER (PARTITION BY g ORDER BY breadth, u)::INT AS place FROM g")
def ep5(spark, d):
    r = load(spark, d, "orders").select(F.col("o_custkey").alias("u"), F.col("o_orderpriority").alias("e"))
    g = load(spark, d, "customer").select(F.col("c_custkey").alias("u"), F.col("c_mktsegment").alias("g"))
    return C.response_breadth(r, g, "u", "e", "g")


@query("ep4_encode", "WITH s AS (SELECT p_size AS g, translate(substr(md5(p_name), 1, 6), '0123456789abcdef', 'AAAAAAAACCCCCCDD') AS q FROM part), x AS (SELECT g, i, list_sort(list(DISTINCT substr(q, i::INT, 1))) AS r FROM s, range(1, 7) t(i) GROUP BY 1, 2) SELECT g, string_agg(CASE WHEN len(r) = 1 THEN r[1] ELSE '[' || array_to_string(r, '') || ']' END, '' ORDER BY i) AS pattern FROM x GROUP BY 1")
def ep4(spark, d):
    q = F.translate(F.substring(F.md5("p_name"), 1, 6), "0123456789abcdef", "AAAAAAAACCCCCCDD")
    return C.encode_variants(load(spark, d, "part").select(F.col("p_size").alias("g"), q.alias("q")), "g", "q")


@query("ep4_decode", "SELECT n_nationkey AS k, x || 'K' || y AS seq FROM nation, (VALUES ('A'), ('C')) a(x), (VALUES ('D'), ('E'), ('F')) b(y)")
def ep4_decode(spark, d):
    return C.decode_variants(load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit("[AC]K[DEF]").alias("pattern")), "pattern").select("k", "seq")


@query("hs1_binding", "WITH b AS (SELECT p_brand AS mer, p_size AS allele, avg(p_retailprice) AS v FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1, 2) SELECT a.allele, m.mer, round(CASE WHEN m.mer NOT LIKE '-%' THEN v END, 6) AS v FROM (SELECT DISTINCT CASE WHEN p_size = 7 THEN '-' || p_brand ELSE p_brand END AS mer FROM part) m CROSS JOIN (SELECT DISTINCT p_size AS allele FROM part) a LEFT JOIN b USING (mer, allele)")
def hs1(spark, d):
    p = load(spark, d, "part")
    b = p.where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("mer"), F.col("p_size").alias("allele")).agg(F.avg("p_retailprice").alias("v"))
    mers = p.select(F.when(F.col("p_size") == 7, F.concat(F.lit("-"), "p_brand")).otherwise(F.col("p_brand")).alias("mer"))
    return rounded(C.binding_table(mers, p.select(F.col("p_size").alias("allele")), b, "mer", "allele", "v"), 6)


@query("sq8_generate", "WITH f AS (SELECT p_size % 4 AS site, substr('ACDEF', (p_partkey % 5)::INT + 1, 1) AS r, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT site, r, n / sum(n) OVER (PARTITION BY site) AS p FROM f), c AS (SELECT site, r, p, sum(p) OVER (PARTITION BY site ORDER BY r) AS hi, row_number() OVER (PARTITION BY site ORDER BY r DESC) AS last FROM s), d AS (SELECT i AS id, site, ('0x' || substr(md5(i || ':' || site || ':0'), 1, 8))::BIGINT / 4294967296 AS u FROM range(0, 500) t(i), (SELECT DISTINCT site FROM c)) SELECT id, string_agg(r, '' ORDER BY site) AS seq FROM d JOIN c USING (site) WHERE u >= hi - p AND (u < hi OR last = 1) GROUP BY 1")
def sq8(spark, d):
    f = load(spark, d, "part").groupBy((F.col("p_size") % 4).alias("site"), F.substring(F.lit("ACDEF"), (F.col("p_partkey") % 5).cast("int") + 1, F.lit(1)).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    shares = f.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("site")))
    return C.generated_sequences(shares, "site", "r", "p", 500)


# --- permutations, regressions, masks

_MI = "l AS (SELECT s_suppkey AS i, s_nationkey % 3 AS x, (s_acctbal > 4000)::INT AS y, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier), r AS (SELECT rep, i, row_number() OVER (PARTITION BY rep ORDER BY md5(i || ':' || rep || ':0'), i) AS k FROM l, range(0, 40) t(rep)), m AS (SELECT -1 AS rep, i, y FROM l UNION ALL SELECT rep, r.i, l.y FROM r JOIN l USING (k))"


@query("co12_permutation", f"WITH {_MI}, c AS (SELECT rep, x, m.y, count(*) AS n FROM m JOIN l USING (i) GROUP BY 1, 2, 3), t AS (SELECT rep, n / sum(n) OVER (PARTITION BY rep) * log2(n * sum(n) OVER (PARTITION BY rep) / (sum(n) OVER (PARTITION BY rep, x) * sum(n) OVER (PARTITION BY rep, y))) AS t FROM c), s AS (SELECT rep, sum(t) AS s FROM t GROUP BY 1) SELECT round(b.s, 9) AS mi, round((count(*) FILTER (s.s >= b.s - 1e-12) + 1) / 41, 9) AS p FROM s, (SELECT s FROM s WHERE rep = -1) b WHERE rep >= 0 GROUP BY b.s")
def co12_test(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") % 3).alias("x"), (F.col("s_acctbal") > 4000).cast("int").alias("y"))
    return rounded(C.mutual_information_test(s, "i", "x", "y", 40), 9)


@query("ro16_kernel_permutation", f"WITH {_K}, l AS (SELECT s_suppkey AS i, s_nationkey - (SELECT avg(s_nationkey) FROM supplier) AS r, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), h AS (SELECT rep, i, row_number() OVER (PARTITION BY rep ORDER BY md5(i || ':' || rep || ':0'), i) AS n FROM l, range(0, 20) t(rep)), m AS (SELECT -1 AS rep, i, r FROM l UNION ALL SELECT rep, h.i, l.r FROM h JOIN l USING (n)), s AS (SELECT a.rep, sum(a.r * k * b.r) / (SELECT var_samp(r) FROM l) AS s FROM k JOIN m a ON k.i = a.i JOIN m b ON k.j = b.i AND a.rep = b.rep GROUP BY 1) SELECT round(b.s, 3) AS q, round((count(*) FILTER (s.s >= b.s * (1 - 1e-12)) + 1) / 21, 9) AS p FROM s, (SELECT s FROM s WHERE rep = -1) b WHERE rep >= 0 GROUP BY b.s")
def ro16_test(spark, d):
    s = load(spark, d, "supplier")
    m = s.agg(F.avg("s_nationkey")).first()[0]
    out = C.kernel_permutation_test(M.gower_kernel(_distances(spark, d)), s.select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") - m).alias("r")), 20)
    return out.select(F.round("q", 3).alias("q"), F.round("p", 9).alias("p"))


@query(
    "ro16_omnibus",
    f"""WITH {_K}, x AS (SELECT s_suppkey AS i, s_acctbal / 700 + s_nationkey AS v FROM supplier),
    ks AS (SELECT 'distance' AS kernel, i, j, k FROM k UNION ALL SELECT 'linear', a.i, b.i, a.v * b.v FROM x a, x b),
    l AS (SELECT s_suppkey AS i, s_nationkey - (SELECT avg(s_nationkey) FROM supplier) AS r, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier),
    h AS (SELECT rep, i, row_number() OVER (PARTITION BY rep ORDER BY md5(i || ':' || rep || ':0'), i) AS n FROM l, range(0, 20) t(rep)),
    m AS (SELECT -1 AS rep, i, r FROM l UNION ALL SELECT rep, h.i, l.r FROM h JOIN l USING (n)),
    s AS (SELECT kernel, a.rep, sum(a.r * k * b.r) / (SELECT var_samp(r) FROM l) AS q FROM ks JOIN m a ON ks.i = a.i JOIN m b ON ks.j = b.i AND a.rep = b.rep GROUP BY 1, 2),
    z AS (SELECT *, round(q / max(abs(q)) OVER (PARTITION BY kernel), 12) AS z FROM s),
    pv AS (SELECT a.kernel, a.rep, a.q, count(*) / 21 AS p FROM z a JOIN z b ON a.kernel = b.kernel AND b.z >= a.z GROUP BY 1, 2, 3),
    e AS (SELECT rep, min(p) AS p FROM pv GROUP BY 1)
    SELECT kernel, round(q, 3) AS q, round(p, 9) AS p, (SELECT round(count(*) / 21, 9) FROM e WHERE p <= (SELECT p FROM e WHERE rep = -1)) AS omnibus FROM pv WHERE rep = -1""",
)
def ro16_omnibus(spark, d):
    s = load(spark, d, "supplier")
    m = s.agg(F.avg("s_nationkey")).first()[0]
    linear = PairTable(points(s, "s_suppkey", F.col("s_acctbal") / 700 + F.col("s_nationkey")), lambda x, y: np.outer(x, y))  # of one coordinate
    kernels = {"linear": linear, "distance": M.gower_kernel(_distances(spark, d))}
    out = C.kernel_omnibus_test(kernels, "kernel", s.select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") - m).alias("r")), 20)
    return out.select("kernel", F.round("q", 3).alias("q"), F.round("p", 9).alias("p"), F.round("omnibus", 9).alias("omnibus"))


@query("flt8_complete_pairs", f"WITH {_WIDE_SQL} SELECT id, q, t FROM w WHERE q IS NOT NULL AND t IS NOT NULL")
def flt8(spark, d):
    return C.complete_pairs(_wide(spark, d), "q", "t").select("id", "q", "t")


@query("set6_outside", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 13)")
def set6(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return C.outside(p.select("p_partkey", "p_brand"), "p_brand", p.where("p_size = 13").select("p_brand"))


@query("src8_fasta_records", "SELECT p_partkey::VARCHAR AS header, upper(md5(p_name)) AS seq FROM part")
def src8(spark, d):
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    p = load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("n"), F.upper(F.md5("p_name")).alias("seq"))
    sinks.write_fasta(p, path, "n", "seq")
    return readers.read_fasta(spark, path, []).select("header", "seq")
