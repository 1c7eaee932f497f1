"""Queries of filters, projections, joins, aggregates, pivots, windows and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import aggregates as A
from quillon.operators import columns as C
from quillon.operators import filters as P
from quillon.operators import joins as J
from quillon.plans.registry import query
from quillon.session import load

# --- filters


@query("flt1_equal", "SELECT l_shipmode_proxy, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM (SELECT *, l_linestatus AS l_shipmode_proxy FROM lineitem) WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1")
def flt1(spark: SparkSession, d: str) -> DataFrame:
    df = P.where_equal(load(spark, d, "lineitem"), l_returnflag="R", l_linestatus="F")
    return df.groupBy(F.col("l_linestatus").alias("l_shipmode_proxy")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query("flt2_members", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'F') GROUP BY 1")
def flt2(spark, d):
    df = P.where_in(load(spark, d, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["O", "F"]})
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("flt3_dimension_prune", "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 2)) GROUP BY 1")
def flt3(spark, d):
    dim = load(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return P.where_dimension(load(spark, d, "supplier"), dim, "s_nationkey", {"n_regionkey": [0, 2]}).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt4_frequent",
    """WITH t AS (SELECT count(*) AS n FROM part),
    a AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 0.03 * (SELECT n FROM t)), b AS (SELECT p_size FROM part GROUP BY 1 HAVING count(*) > 0.015 * (SELECT n FROM t)),
    c AS (SELECT * FROM part WHERE p_brand IN (FROM a) AND p_size IN (FROM b)) SELECT p_partkey, p_brand, p_size FROM c""",
)
def flt4(spark, d):
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return P.keep_frequent(P.keep_frequent(part, ["p_brand"], 0.03).join(part.select("p_partkey"), "p_partkey"), [], 0).join(P.keep_frequent(part, ["p_size"], 0.015).select("p_partkey"), "p_partkey", "left_semi")


def _wide(spark, d):
    """Orders by customer, status pivoted: a wide frame with gaps."""
    o = load(spark, d, "orders")
    return o.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


@query(
    "flt5_drop_sparse",
    """WITH w AS (SELECT o_custkey, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1)
    SELECT o_custkey, F, O, P FROM w WHERE (F IS NOT NULL)::INT + (O IS NOT NULL)::INT + (P IS NOT NULL)::INT >= 3""",
)
def flt5(spark, d):
    return P.drop_sparse(_wide(spark, d), min_row=3, min_col=5, keys=["o_custkey"])


@query(
    "flt6_discard_low",
    """WITH l AS (SELECT p_brand AS feature, l_suppkey % 20 AS sample, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    k AS (SELECT feature FROM l GROUP BY 1 HAVING sum(v) > 0.04 * (SELECT sum(v) FROM l) AND count(DISTINCT CASE WHEN v > 0 THEN sample END) > 0.25 * (SELECT count(DISTINCT sample) FROM l))
    SELECT feature, sample::BIGINT AS sample, round(v, 4) AS v FROM l WHERE feature IN (FROM k)""",
)
def flt6(spark, d):
    li, part = load(spark, d, "lineitem"), load(spark, d, "part")
    long = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("feature"), (F.col("l_suppkey") % 20).alias("sample")).agg(F.sum("l_quantity").alias("v"))
    return P.discard_low(long, "feature", "sample", "v", share=0.04).withColumn("v", F.round("v", 4))


@query("flt7_complete_cases", "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND NOT isnan(value)")
def flt7(spark, d):
    return P.complete_cases(load(spark, d, "events"), ["value", "user_id"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "flt9_valid_residues",
    "SELECT p_partkey, coalesce(NOT regexp_matches(upper(p_name), '[-*BX#Z]'), false) AS valid, regexp_replace(upper(p_name), '[-*BX#Z]', '', 'g') AS cleaned FROM part",
)
def flt9(spark, d):
    up = F.upper("p_name")
    return load(spark, d, "part").select("p_partkey", P.valid_residues(up).alias("valid"), P.strip_residues(up).alias("cleaned"))


@query("flt10_censor", "SELECT l_orderkey, l_linenumber, CASE WHEN 100 * l_tax > 4.5 THEN NULL ELSE l_discount END AS p FROM lineitem")
def flt10(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.censor_background(F.col("l_discount"), F.col("l_tax"), 4.5).alias("p"))


@query("flt11_significant", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount <= 0.01 GROUP BY 1 HAVING count(*) >= 2)")
def flt11(spark, d):
    return P.keep_significant(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_orderkey", "l_discount", 0.01, 2)


def _gates(spark, d):
    """Order lines as cells with Boolean gates."""
    return load(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("sample"), (F.col("l_returnflag") == "N").alias("CD4"), (F.col("l_returnflag") != "N").alias("CD8"),
        (F.col("l_quantity") > 30).alias("IFNg"), (F.col("l_discount") > 0.05).alias("IL2"), (F.col("l_tax") > 0.04).alias("TNFa"),
    )


_GATES_SQL = """g AS (SELECT l_suppkey AS sample, l_returnflag = 'N' AS CD4, l_returnflag <> 'N' AS CD8, l_quantity > 30 AS IFNg, l_discount > 0.05 AS IL2, l_tax > 0.04 AS TNFa FROM lineitem)"""


@query("flt12_any_flag", f"WITH {_GATES_SQL} SELECT sample, IFNg, IL2 FROM g WHERE IFNg OR IL2")
def flt12(spark, d):
    return P.any_flag(_gates(spark, d), ["IFNg", "IL2"], ["sample", "IFNg", "IL2"])


@query("flt13_clamp", "SELECT event_id, greatest(0.5, least(value, 20.0)) AS v FROM events")
def flt13(spark, d):
    return load(spark, d, "events").select("event_id", P.clamp(F.col("value"), 0.5, 20.0).alias("v"))


# --- projections and imputation


@query("prj3_clean_id", "SELECT c_custkey, coalesce(regexp_replace(replace(c_phone, '-', ''), '\\.0$', ''), 'NA') AS id FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment || '-' || c_custkey || '.0' END AS c_phone FROM customer)")
def prj3(spark, d):
    raw = F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.concat("c_mktsegment", F.lit("-"), F.col("c_custkey").cast("string"), F.lit(".0")))
    return load(spark, d, "customer").select("c_custkey", C.clean_id(raw).alias("id"))


@query("prj4_composite_key", "SELECT o_orderstatus || ' ' || o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1")
def prj4(spark, d):
    return load(spark, d, "orders").groupBy(C.composite_key("o_orderstatus", "o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj5_min_max",
    "SELECT event_id, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)",
)
def prj5(spark, d):
    return load(spark, d, "events").select("event_id", F.round(C.min_max("value", ["event_type"]), 6).alias("scaled"))


@query(
    "prj6_standardize",
    "SELECT s_suppkey, round((s_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM supplier",
)
def prj6(spark, d):
    fitted = C.fit_standardization(load(spark, d, "customer").select(F.col("c_acctbal").alias("s_acctbal")), ["s_acctbal"])
    return C.standardize(load(spark, d, "supplier"), fitted).select("s_suppkey", F.round("s_acctbal", 6).alias("z"))


@query("src14_floor_log10", "SELECT event_id, round(log10(greatest(value, 0.25)), 6) AS m, round(log10(greatest(value, 1.0) + 1), 6) AS m1 FROM events WHERE value IS NOT NULL")
def src14(spark, d):
    v = F.col("value")
    return load(spark, d, "events").where("value IS NOT NULL").select("event_id", F.round(C.floor_log10(v, 0.25), 6).alias("m"), F.round(C.floor_log10(v, 1.0, 1.0), 6).alias("m1"))


_GAPS_SQL = "x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id::DOUBLE END AS u FROM events)"


def _gaps(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("double")).alias("u"))


@query("na1_impute_median", f"WITH {_GAPS_SQL} SELECT event_id, coalesce(value, (SELECT median(value) FROM x)) AS value, coalesce(u, (SELECT median(u) FROM x)) AS u FROM x WHERE value IS NOT NULL OR u IS NOT NULL")
def na1(spark, d):
    return C.impute(_gaps(spark, d), ["value", "u"], "median", drop_share=0.5)


@query("na1_impute_mean", f"WITH {_GAPS_SQL} SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM x)), 6) AS value, round(coalesce(u, (SELECT avg(u) FROM x)), 6) AS u FROM x")
def na1_mean(spark, d):
    out = C.impute(_gaps(spark, d), ["value", "u"], "mean")
    return out.select("event_id", F.round("value", 6).alias("value"), F.round("u", 6).alias("u"))


@query(
    "na1_impute_regression",
    f"""WITH {_GAPS_SQL}, m AS (SELECT avg(value) AS v, avg(u) AS u FROM x),
    a AS (SELECT regr_slope(value, coalesce(x.u, m.u)) AS s, regr_intercept(value, coalesce(x.u, m.u)) AS i FROM x, m WHERE x.value IS NOT NULL),
    b AS (SELECT regr_slope(x.u, coalesce(x.value, m.v)) AS s, regr_intercept(x.u, coalesce(x.value, m.v)) AS i FROM x, m WHERE x.u IS NOT NULL)
    SELECT event_id, round(coalesce(x.value, a.i + a.s * coalesce(x.u, m.u)), 5) AS value, round(coalesce(x.u, b.i + b.s * coalesce(x.value, m.v)), 5) AS u FROM x, m, a, b""",
)
def na1_regression(spark, d):
    out = C.impute(_gaps(spark, d), ["value", "u"], "regression")
    return out.select("event_id", F.round("value", 5).alias("value"), F.round("u", 5).alias("u"))


@query("na1_impute_sample")
def na1_sample(spark, d):
    return C.impute(_gaps(spark, d), ["value"], "sample").select("event_id", "value")


# --- joins


@query(
    "j1_left_suffixed",
    """WITH a AS (SELECT l_suppkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT a.l_suppkey, a.qty, a.n, b.qty AS qty_neg, b.n AS n_neg FROM a LEFT JOIN b USING (l_suppkey)""",
)
def j1(spark, d):
    li = load(spark, d, "lineitem")
    side = lambda f: li.where(F.col("l_returnflag") == f).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    return J.left_suffixed(side("R"), side("A"), ["l_suppkey"], "_neg")


@query("j3_with_totals", "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS total FROM orders")
def j3(spark, d):
    return J.with_totals(load(spark, d, "orders"), ["o_custkey"], "o_totalprice", "total").select("o_orderkey", "o_custkey", F.round("total", 4).alias("total"))


@query("j4_dimension", "SELECT n_name, count(*) AS n, round(sum(s_acctbal), 4) AS bal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def j4(spark, d):
    s, n = load(spark, d, "supplier"), load(spark, d, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 4).alias("bal"))


@query(
    "j5_inner_suffixed",
    """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT user_id, a.n AS "n_A", b.n AS "n_B" FROM a JOIN b USING (user_id)""",
)
def j5(spark, d):
    e = load(spark, d, "events")
    side = lambda t: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return J.inner_suffixed(side("click"), side("error"), "user_id")


@query(
    "j7_outer_all",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), c AS (SELECT o_custkey AS k, count(*) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT k, f, o, p FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""",
)
def j7(spark, d):
    o = load(spark, d, "orders")
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(n))
    return J.outer_all([side("F", "f"), side("O", "o"), side("P", "p")], ["k"])


@query("j9_left_zero", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j9(spark, d):
    counts = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return J.left_zero(load(spark, d, "customer").select("c_custkey"), counts, "c_custkey", ["n"])


@query(
    "j10_paired",
    """WITH s AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY 1, 2)
    SELECT a.user_id, a.event_type AS cat_a, a.v AS value_a, b.event_type AS cat_b, b.v AS value_b FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type < b.event_type""",
)
def j10(spark, d):
    s = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    return J.paired(s, "user_id", "event_type", "v")


@query(
    "j11_match_substring",
    """WITH f AS (SELECT 'run/' || s_name || '_' || s_suppkey || '.parquet' AS path FROM supplier), m AS (SELECT s_name || '_' AS name FROM supplier ),
    h AS (SELECT path, name FROM f JOIN m ON contains(path, name)) SELECT path, name FROM h QUALIFY count(*) OVER (PARTITION BY path) = 1 AND count(*) OVER (PARTITION BY name) = 1""",
)
def j11(spark, d):
    s = load(spark, d, "supplier")
    files = s.select(F.concat(F.lit("run/"), "s_name", F.lit("_"), F.col("s_suppkey").cast("string"), F.lit(".parquet")).alias("path"))
    return J.match_substring(files, s.select(F.concat("s_name", F.lit("_")).alias("name")), "path", "name")


_INTERVALS_SQL = "i AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey AS k, (l_quantity * 7)::INT AS start, (l_quantity * 7)::INT + 5 + l_linenumber AS \"end\" FROM lineitem)"


def _intervals(spark, d):
    li = load(spark, d, "lineitem")
    start = (F.col("l_quantity") * 7).cast("int")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("k"), start.alias("start"), (start + 5 + F.col("l_linenumber")).alias("end"))


@query(
    "j12_interval_overlap",
    f"""WITH {_INTERVALS_SQL} SELECT a.k, count(*) AS pairs, sum(least(a."end", b."end") - greatest(a.start, b.start))::BIGINT AS shared FROM i a JOIN i b ON a.k = b.k AND a.start < b."end" AND b.start < a."end" AND (a.id, a.ln) < (b.id, b.ln) GROUP BY 1""",
)
def j12(spark, d):
    i = _intervals(spark, d)
    pairs = J.interval_overlap(i, i, ["k"], 16).where((F.col("id") < F.col("id_b")) | ((F.col("id") == F.col("id_b")) & (F.col("ln") < F.col("ln_b"))))
    return pairs.groupBy("k").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.least("end", "end_b") - F.greatest("start", "start_b")).alias("shared"))


@query("j13_all_pairs", "SELECT a.s_suppkey, b.s_suppkey AS s_suppkey_b, round(abs(a.s_acctbal - b.s_acctbal), 4) AS d FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def j13(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return J.all_pairs(s, "s_suppkey", ["s_nationkey"]).select("s_suppkey", "s_suppkey_b", F.round(F.abs(F.col("s_acctbal") - F.col("s_acctbal_b")), 4).alias("d"))


@query(
    "j16_maximal_sets",
    """WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 12)) AS items FROM lineitem GROUP BY 1),
    u AS (SELECT items, min(k) AS k FROM s GROUP BY 1)
    SELECT k, array_to_string(items, ',') AS items FROM u WHERE NOT EXISTS (SELECT 1 FROM u t WHERE len(t.items) > len(u.items) AND list_has_all(t.items, u.items))""",
)
def j16(spark, d):
    s = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 12)).alias("items"))
    return J.maximal_sets(s, "k", "items").select("k", F.array_join("items", ",").alias("items"))


@query(
    "j18_align_last",
    """WITH a AS (SELECT user_id, ts, max(value) AS x FROM events WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id, ts, max(value) AS y FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    g AS (SELECT user_id, ts FROM a UNION SELECT user_id, ts FROM b)
    SELECT user_id, epoch_us(ts) AS us, last_value(x IGNORE NULLS) OVER w AS x, last_value(y IGNORE NULLS) OVER w AS y FROM g LEFT JOIN a USING (user_id, ts) LEFT JOIN b USING (user_id, ts) WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)
def j18(spark, d):
    e = load(spark, d, "events")
    side = lambda t, n: e.where(F.col("event_type") == t).groupBy("user_id", "ts").agg(F.max("value").alias(n))
    out = J.align_last(side("click", "x"), side("view", "y"), ["user_id"], "ts", ["x", "y"])
    return out.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "x", "y")


@query(
    "j18_as_of",
    """WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts, max(value) AS y FROM events WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT a.event_id, b.y FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def j18_as_of(spark, d):
    e = load(spark, d, "events")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("y"))
    return J.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), right, ["user_id"], "ts", ["y"]).select("event_id", "y")


# --- aggregates


@query("agg1_negative_control", "SELECT l_suppkey, round(sum(l_discount), 4) AS pos, round(sum(l_quantity), 4) AS total, round(sum(l_discount) / sum(l_quantity), 9) AS bg FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def agg1(spark, d):
    li = load(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_suppkey", F.col("l_discount").alias("pos"), F.col("l_quantity").alias("total"))
    out = A.negative_control(li, ["l_suppkey"], "pos", "total")
    return out.select("l_suppkey", F.round("pos", 4).alias("pos"), F.round("total", 4).alias("total"), F.round("bg", 9).alias("bg"))


MARKERS = ["IFNg", "IL2", "TNFa"]
_COMBO_SQL = f"""{_GATES_SQL}, c AS (SELECT sample, concat('IFNg', CASE WHEN IFNg THEN '+' ELSE '-' END, 'IL2', CASE WHEN IL2 THEN '+' ELSE '-' END, 'TNFa', CASE WHEN TNFa THEN '+' ELSE '-' END) AS combo, count(*) AS mag FROM g GROUP BY 1, 2),
m AS (SELECT *, (sum(mag) OVER (PARTITION BY sample))::BIGINT AS nsub FROM c)"""


def _combos(spark, d):
    sign = F.concat(*(F.concat(F.lit(m), F.when(F.col(m), "+").otherwise("-")) for m in MARKERS))
    c = _gates(spark, d).groupBy("sample", sign.alias("combo")).agg(F.count(F.lit(1)).alias("mag"))
    return c.withColumn("nsub", F.sum("mag").over(Window.partitionBy("sample")))


@query(
    "agg2_compress_markers",
    f"WITH {_COMBO_SQL} SELECT sample, 'IFNg' || substr(combo, 5, 1) || 'TNFa' || substr(combo, 14, 1) AS combo, sum(mag)::BIGINT AS mag, median(nsub) AS nsub FROM m GROUP BY 1, 2",
)
def agg2(spark, d):
    return A.compress_markers(_combos(spark, d), ["IFNg", "TNFa"], "combo", ["sample"], ["mag"], ["nsub"])


@query("agg3_response", f"WITH {_COMBO_SQL} SELECT sample, sum(mag)::BIGINT AS mag, median(nsub) AS nsub FROM m WHERE length(regexp_replace(combo, '[^+]', '', 'g')) >= 1 AND combo <> 'IFNg-IL2-TNFa+' GROUP BY 1")
def agg3(spark, d):
    return A.response(_combos(spark, d), MARKERS, "combo", ["sample"], ["mag"], ["nsub"], least=1, exceptions=A.only_positive_in(MARKERS, ["TNFa"]))


@query(
    "agg5_one_way_marginals",
    f"WITH {_COMBO_SQL} SELECT sample, mk || '+' AS marker, sum(mag)::BIGINT AS mag, median(nsub) AS nsub FROM m, (VALUES ('IFNg'), ('IL2'), ('TNFa')) AS v(mk) WHERE contains(combo, mk || '+') GROUP BY 1, 2",
)
def agg5(spark, d):
    return A.one_way_marginals(_combos(spark, d), "combo", MARKERS, ["sample"], ["mag"], ["nsub"])


@query(
    "agg6_gate_counts",
    f"""WITH {_GATES_SQL}, s AS (SELECT sample, 'CD4' AS subset, IFNg, IL2, TNFa FROM g WHERE CD4 UNION ALL SELECT sample, 'CD8', IFNg, IL2, TNFa FROM g WHERE CD8),
    k AS (SELECT DISTINCT sample, subset FROM s), b AS (SELECT a.x AS IFNg, b.x AS IL2, c.x AS TNFa FROM (VALUES (true), (false)) a(x), (VALUES (true), (false)) b(x), (VALUES (true), (false)) c(x)),
    n AS (SELECT sample, subset, IFNg, IL2, TNFa, count(*) AS c FROM s GROUP BY ALL)
    SELECT sample, subset, concat('IFNg', CASE WHEN IFNg THEN '+' ELSE '-' END, 'IL2', CASE WHEN IL2 THEN '+' ELSE '-' END, 'TNFa', CASE WHEN TNFa THEN '+' ELSE '-' END) AS combination, coalesce(c, 0) AS cytnum, (sum(coalesce(c, 0)) OVER (PARTITION BY sample, subset))::BIGINT AS nsub
    FROM k CROSS JOIN b LEFT JOIN n USING (sample, subset, IFNg, IL2, TNFa)""",
)
def agg6(spark, d):
    return A.gate_counts(_gates(spark, d), ["CD4", "CD8"], MARKERS, ["sample"])


@query(
    "agg8_gate_counts_min",
    f"""WITH {_GATES_SQL}, s AS (SELECT 'CD4' AS subset, IFNg, IL2, TNFa FROM g WHERE CD4 UNION ALL SELECT 'CD8', IFNg, IL2, TNFa FROM g WHERE CD8), n AS (SELECT subset, IFNg, IL2, TNFa, count(*) AS c FROM s GROUP BY ALL)
    SELECT subset, concat('IFNg', CASE WHEN IFNg THEN '+' ELSE '-' END, 'IL2', CASE WHEN IL2 THEN '+' ELSE '-' END, 'TNFa', CASE WHEN TNFa THEN '+' ELSE '-' END) AS combination, c AS cytnum, nsub FROM (SELECT *, (sum(c) OVER (PARTITION BY subset))::BIGINT AS nsub FROM n) WHERE c >= 100""",
)
def agg8(spark, d):
    return A.gate_counts(_gates(spark, d), ["CD4", "CD8"], MARKERS, least=100, complete=False)


@query(
    "agg10_grouping_sets",
    """SELECT l_returnflag, l_linestatus, ln, month, (4 - bit_count(grouping(l_returnflag, l_linestatus, ln, month)))::BIGINT AS level, count(*) AS n
    FROM (SELECT l_returnflag, l_linestatus, l_linenumber AS ln, month(l_shipdate)::INT AS month FROM lineitem)
    GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, ln), (l_returnflag, month), (l_linestatus, ln), (l_linestatus, month), (ln, month), (l_returnflag, l_linestatus, ln), (l_returnflag, l_linestatus, month), (l_returnflag, ln, month), (l_linestatus, ln, month), (l_returnflag, l_linestatus, ln, month))
    HAVING count(*) >= 30""",
)
def agg10(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("ln"), F.month("l_shipdate").alias("month"))
    return A.grouping_sets(li, ["l_returnflag", "l_linestatus", "ln", "month"], F.count(F.lit(1)), 30)


@query("agg11_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT value) AS vals FROM events GROUP BY 1")
def agg11(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("value").alias("vals"))


@query("agg12_moments", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, median(p_retailprice) AS med, round(stddev_samp(p_retailprice), 6) AS sd FROM part GROUP BY 1")
def agg12(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("mean"), F.median("p_retailprice").alias("med"), F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"))


@query("agg13_histogram", "SELECT event_type, n, round(n / sum(n) OVER (), 9) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def agg13(spark, d):
    return A.histogram(load(spark, d, "events"), "event_type", share=True).withColumn("share", F.round("share", 9))


@query("agg13_expand", "SELECT event_type, unnest(range(1, n + 1))::INT AS copy FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def agg13_expand(spark, d):
    h = A.histogram(load(spark, d, "events"), "event_type").withColumn("n", F.col("n").cast("int"))
    return A.expand(h, "event_type", "n")


@query("agg14_contingency", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def agg14(spark, d):
    return load(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg15_crosstab",
    "SELECT c_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
def agg15(spark, d):
    o = load(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return A.crosstab(o, "k", "o_orderstatus", ["F", "O", "P"], index=load(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query(
    "agg17_co_observed",
    """WITH w AS (SELECT o_custkey, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1)
    SELECT 'F' AS a, 'O' AS b, count(*) FILTER (F > 0 AND O > 0) AS n FROM w UNION ALL SELECT 'F', 'P', count(*) FILTER (F > 0 AND P > 0) FROM w UNION ALL SELECT 'O', 'P', count(*) FILTER (O > 0 AND P > 0) FROM w""",
)
def agg17(spark, d):
    return A.co_observed(_wide(spark, d), ["F", "O", "P"])


@query(
    "agg18_ip_weights",
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS pr, (o_orderstatus = 'P')::INT AS c FROM orders), t AS (SELECT * FROM o WHERE o_orderkey % 3 = 0),
    a AS (SELECT pr, c, count(*) AS n1 FROM o GROUP BY 1, 2), b AS (SELECT pr, c, count(*) AS n2 FROM t GROUP BY 1, 2)
    SELECT o_orderkey, pr, c, CASE WHEN c = 1 THEN 1.0 ELSE round(n1 / n2, 9) END::DOUBLE AS weight, (dense_rank() OVER (ORDER BY pr) - 1)::INT AS stratum, 1 - c AS insubcohort FROM t JOIN a USING (pr, c) JOIN b USING (pr, c)""",
)
def agg18(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("pr"), (F.col("o_orderstatus") == "P").cast("int").alias("c"))
    return A.inverse_probability_weights(o, o.where("o_orderkey % 3 = 0"), ["pr", "c"], "c").withColumn("weight", F.round("weight", 9))


@query("agg21_apply_groups", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, count(value) AS n FROM events GROUP BY 1")
def agg21(spark, d):
    import pandas as pd

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_type": [pdf.event_type.iloc[0]], "median": [round(float(pdf.value.median()), 6)], "n": [int(pdf.value.count())]})

    return A.apply_groups(load(spark, d, "events").select("event_type", "value"), ["event_type"], f, "event_type string, median double, n long")


@query(
    "piv1_pivot_unique",
    "SELECT o_custkey, max(n) FILTER (o_orderstatus = 'F') AS F, max(n) FILTER (o_orderstatus = 'O') AS O FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
)
def piv1(spark, d):
    s = load(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return A.pivot_unique(s, ["o_custkey"], "o_orderstatus", ["F", "O"], ["n"])


@query("piv3_pivot_duplicates", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1")
def piv3(spark, d):
    return A.pivot_duplicates(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"])


@query("piv4_unpivot", "SELECT l_orderkey, l_linenumber, 'l_tax' AS variable, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def piv4(spark, d):
    return load(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "variable", "value")


@query(
    "grid1_complete",
    """WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM s) CROSS JOIN (SELECT DISTINCT event_type FROM s) LEFT JOIN s USING (user_id, event_type)""",
)
def grid1(spark, d):
    s = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return A.complete_grid(s, ["user_id", "event_type"], {"n": 0})


@query("dis1_unique_rows", "SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS first, (row_number() OVER (ORDER BY p_brand, p_type) - 1)::INT AS number FROM part GROUP BY 1, 2")
def dis1(spark, d):
    return A.unique_rows(load(spark, d, "part"), ["p_brand", "p_type"], "p_partkey")


@query("dis2_first_seen", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dis2(spark, d):
    return A.first_seen(load(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("dis2_just_seen", "SELECT event_id, user_id, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w")
def dis2_just(spark, d):
    return A.just_seen(load(spark, d, "events"), "event_type", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("win1_mid_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS r FROM lineitem")
def win1(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.mid_rank("l_quantity", ["l_suppkey"]).alias("r"))


@query("win3_cumulative", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def win3(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("total"))


@query("win4_lag_fill", "SELECT event_id, lag(value) OVER w AS before, round(value - lag(value) OVER w, 4) AS step, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win4(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    filled = F.last(F.when(F.col("event_type") == "error", F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("value").over(w)
    return load(spark, d, "events").select("event_id", before.alias("before"), F.round(F.col("value") - before, 4).alias("step"), filled.alias("filled"))


@query(
    "win5_moving_sum",
    "SELECT p_brand, site::BIGINT AS site, round(sum(v), 4) AS score FROM (SELECT p_brand, p_size, round(avg(p_retailprice), 4) AS v FROM part GROUP BY 1, 2), range(0, 200) r(site) WHERE site BETWEEN p_size AND p_size + 8 GROUP BY 1, 2",
)
def win5(spark, d):
    s = load(spark, d, "part").groupBy("p_brand", F.col("p_size").cast("long").alias("p_size")).agg(F.round(F.avg("p_retailprice"), 4).alias("v"))
    return A.moving_sum(s, "v", ["p_brand"], "p_size", 9).withColumn("score", F.round("score", 4))


@query(
    "win6_recipes",
    """SELECT user_id, count(*) FILTER (nxt IS NOT NULL) AS pairs, max(grp)::BIGINT AS groups, max(CASE WHEN rn = 3 THEN event_id END) AS nth, min(value) IS NOT DISTINCT FROM max(value) AS all_equal, count(*) FILTER (value > 10) AS quantify, min_by(event_id, rn) FILTER (value > 10) AS first_true
    FROM (SELECT *, row_number() OVER w AS rn, lead(event_id) OVER w AS nxt, (row_number() OVER w - 1) // 4 AS grp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1""",
)
def win6(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").withColumn("rn", F.row_number().over(w)).withColumn("nxt", F.lead("event_id").over(w)).withColumn("grp", F.floor((F.col("rn") - 1) / 4))
    return e.groupBy("user_id").agg(
        F.count("nxt").alias("pairs"), F.max("grp").alias("groups"), F.max(F.when(F.col("rn") == 3, F.col("event_id"))).alias("nth"), F.min("value").eqNullSafe(F.max("value")).alias("all_equal"),
        F.count_if(F.col("value") > 10).alias("quantify"), F.min_by("event_id", F.when(F.col("value") > 10, F.col("rn"))).alias("first_true"),
    )


@query("win6_powerset", "SELECT r_regionkey, string_agg(item, '' ORDER BY i) AS subset FROM (SELECT r_regionkey, m, i, substr('ABCD', i::INT + 1, 1) AS item FROM region, range(0, 16) a(m), range(0, 4) b(i) WHERE (m >> i) & 1 = 1) GROUP BY r_regionkey, m UNION ALL SELECT r_regionkey, '' FROM region")
def win6_powerset(spark, d):
    return load(spark, d, "region").select("r_regionkey", F.explode(A.power_set(F.array(*map(F.lit, "ABCD")))).alias("s")).select("r_regionkey", F.array_join("s", "").alias("subset"))


@query("top1_frequent", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def top1(spark, d):
    return A.top_n(A.histogram(load(spark, d, "events"), "user_id"), 5, [F.desc("n"), F.asc("user_id")])


@query("top1_by_group", "SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 3")
def top1_group(spark, d):
    c = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return A.top_n(c, 3, [F.desc("n"), F.asc("user_id")], ["event_type"])


@query(
    "top2_union",
    """SELECT DISTINCT p_partkey, p_retailprice, p_size FROM (FROM (SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5) UNION ALL FROM (SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice, p_partkey LIMIT 5)
    UNION ALL FROM (SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 5))""",
)
def top2(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    tops = [A.top_n(p, 5, [o, F.asc("p_partkey")]) for o in (F.desc("p_retailprice"), F.asc("p_retailprice"), F.desc("p_size"))]
    return tops[0].union(tops[1]).union(tops[2]).distinct()


@query("top3_arg", "SELECT p_brand, arg_max(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS best, arg_min(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS worst, min(CASE WHEN p_size > 20 THEN p_partkey END) AS first FROM part GROUP BY 1")
def top3(spark, d):
    key = F.struct("p_retailprice", "p_partkey")
    return load(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", key).alias("best"), F.min_by("p_partkey", key).alias("worst"), F.min(F.when(F.col("p_size") > 20, F.col("p_partkey"))).alias("first"))


@query("srt1_order", "SELECT p_partkey, (row_number() OVER (ORDER BY p_brand, p_type, p_partkey))::INT AS place FROM part")
def srt1(spark, d):
    return load(spark, d, "part").select("p_partkey", F.row_number().over(Window.orderBy("p_brand", "p_type", "p_partkey")).alias("place"))


@query("set2_union_distinct", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set2(spark, d):
    a = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return a.union(load(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("set4_exact_sharing", """WITH m AS (SELECT DISTINCT user_id, event_type FROM events), s AS (SELECT event_type, count(*) AS n FROM m GROUP BY 1)
    SELECT a.event_type AS g1, b.event_type AS g2, count(*) AS shared, round(count(*) / any_value(s1.n), 9) AS share, round(2 * count(*) / (any_value(s1.n) + any_value(s2.n)), 9) AS dice, round(count(*) / (any_value(s1.n) + any_value(s2.n) - count(*)), 9) AS jaccard
    FROM m a JOIN m b USING (user_id) JOIN s s1 ON a.event_type = s1.event_type JOIN s s2 ON b.event_type = s2.event_type GROUP BY 1, 2""")
def set4(spark, d):
    out = A.shared_counts(load(spark, d, "events"), "user_id", "event_type")
    return out.select("g1", "g2", "shared", *(F.round(c, 9).alias(c) for c in ("share", "dice", "jaccard")))


@query("j15_radius_sharing", """WITH m AS (SELECT DISTINCT s_suppkey AS i, s_nationkey % 5 AS g FROM supplier), p AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON abs(a.s_acctbal - b.s_acctbal) <= 100 OR a.s_suppkey = b.s_suppkey),
    h AS (SELECT a.g AS g1, b.g AS g2, count(DISTINCT a.i) AS shared FROM m a JOIN p ON a.i = p.i JOIN m b ON p.j = b.i GROUP BY 1, 2), s AS (SELECT g, count(*) AS n FROM m GROUP BY 1)
    SELECT h.g1, h.g2, h.shared, round(h.shared / s1.n, 9) AS share, round((h.shared + coalesce(k.shared, 0)) / (s1.n + s2.n), 9) AS "index" FROM h LEFT JOIN h k ON h.g1 = k.g2 AND h.g2 = k.g1 JOIN s s1 ON h.g1 = s1.g JOIN s s2 ON h.g2 = s2.g""")
def j15(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") % 5).alias("g"), "s_acctbal")
    out = A.radius_shared_values(s, "i", "g", "s_acctbal", 100)
    return out.select("g1", "g2", "shared", F.round("share", 9).alias("share"), F.round("index", 9).alias("index"))


@query("cmb1_sign_vectors", "WITH g AS (SELECT concat('F', a.x, 'O', b.x, 'P', c.x) AS combo FROM (VALUES ('+'), ('-')) a(x), (VALUES ('+'), ('-')) b(x), (VALUES ('+'), ('-')) c(x)), o AS (SELECT concat('F', CASE WHEN bool_or(o_orderstatus = 'F') THEN '+' ELSE '-' END, 'O', CASE WHEN bool_or(o_orderstatus = 'O') THEN '+' ELSE '-' END, 'P', CASE WHEN bool_or(o_orderstatus = 'P') THEN '+' ELSE '-' END) AS combo FROM orders GROUP BY o_custkey) SELECT combo, count(o.combo) AS n FROM g LEFT JOIN o USING (combo) GROUP BY 1")
def cmb1(spark, d):
    """Customers by the statuses that their orders have, over all vectors of signs."""
    status = ["F", "O", "P"]
    grid = spark.createDataFrame([(s,) for s in C.sign_vectors(status)], "combo string")
    sign = lambda s: F.concat(F.lit(s), F.when(F.bool_or(F.col("o_orderstatus") == s), "+").otherwise("-"))
    have = load(spark, d, "orders").groupBy("o_custkey").agg(F.concat(*map(sign, status)).alias("combo")).groupBy("combo").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(have, "combo", "left").select("combo", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("lbl_subset_labels", f"WITH {_COMBO_SQL} SELECT sample, combo, regexp_replace(combo, '(IFNg|IL2|TNFa)-', '', 'g') AS positives FROM m")
def lbl(spark, d):
    c = _combos(spark, d)
    return c.select("sample", C.subset_label(C.subset_vector(F.col("combo")), MARKERS).alias("combo"), C.subset_label(C.subset_vector(F.col("combo")), MARKERS, True).alias("positives"))
