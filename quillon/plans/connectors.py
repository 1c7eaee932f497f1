"""Queries of joins by part of a key, of column names, and of small files that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.operators import association as S
from quillon.operators import columns as K
from quillon.operators import joins as J
from quillon.operators import sequences as Q
from quillon.operators import tests as T
from quillon.plans.registry import query
from quillon.session import load, shared_dir
from quillon.sources import readers, sinks


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"


@query("j2_background_join", "SELECT o_orderkey, o_custkey, o_totalprice, n AS n_bg, mean AS mean_bg FROM orders LEFT JOIN (SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (o_custkey)")
def j2(spark, d):
    o = load(spark, d, "orders")
    background = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return J.left_suffixed(o.select("o_orderkey", "o_custkey", "o_totalprice"), background, ["o_custkey"], "_bg")


@query("j6_aligned_tables", "SELECT k, a.n AS n_A, b.n AS n_B FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) b USING (k)")
def j6(spark, d):
    counts = lambda cond: load(spark, d, "lineitem").where(cond).groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return J.inner_suffixed(counts("l_returnflag = 'R'"), counts("l_quantity > 49"), "k")


@query("prj1_sanitize", "SELECT p_partkey AS part_key_, p_size AS size__cm_, p_brand AS brand FROM part")
def prj1(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("part key!"), F.col("p_size").alias("size (cm)"), F.col("p_brand").alias("brand"))
    return K.sanitize_columns(p, "_")


@query("prj2_strip_prefix", "SELECT l_orderkey AS id, l_quantity AS qty, l_tax AS tax FROM lineitem")
def prj2(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch.id"), F.col("l_quantity").alias("gs.flow.qty"), F.col("l_tax").alias("tax"))
    return K.strip_prefix(li)


@query("na2_median_fill", "WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer) SELECT c_custkey, round(coalesce(balance, (SELECT median(balance) FROM x)), 6) AS balance FROM x")
def na2(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return K.impute(c, ["balance"], "median").select("c_custkey", F.round("balance", 6).alias("balance"))


@query("st9_likelihood_ratio", "SELECT p_partkey, round(exp(-p_size / 20.0), 9) AS p FROM part")
def st9(spark, d):
    """Two more coefficients: chi-squared of two degrees has the tail exp(-x / 2)."""
    full = F.col("p_retailprice") / 100
    p = T.likelihood_ratio_p(full, full - F.col("p_size") / 20, F.lit(2))
    return load(spark, d, "part").select("p_partkey", F.round(p, 9).alias("p"))


@query("ro9_table_of_rates", "WITH r AS (SELECT s_suppkey, 0.5 + s_nationkey / 60.0 AS se, 0.95 - s_nationkey / 100.0 AS sp, (s_suppkey % 9 + 1) / 20.0 AS pr FROM supplier) SELECT s_suppkey, round(se * pr * 1000, 6) AS a, round((1 - sp) * (1 - pr) * 1000, 6) AS b, round((1 - se) * pr * 1000, 6) AS c, round(sp * (1 - pr) * 1000, 6) AS d FROM r")
def ro9(spark, d):
    cells = S.confusion_from_rates(0.5 + F.col("s_nationkey") / 60, 0.95 - F.col("s_nationkey") / 100, (F.col("s_suppkey") % 9 + 1) / 20, 1000)
    return load(spark, d, "supplier").select("s_suppkey", *(F.round(v, 6).alias(k) for k, v in cells.items()))


@query("src10_configuration", "SELECT CASE n_regionkey WHEN 0 THEN 'subset' WHEN 1 THEN 'marker' WHEN 2 THEN 'function' ELSE 'exclude' END AS type, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'n' || n_nationkey END AS name, n_name AS value FROM nation")
def src10(spark, d):
    path, n = _scratch(spark), load(spark, d, "nation")
    kind = F.element_at(F.array(*map(F.lit, ("subset", "marker", "function", "exclude", "exclude"))), F.col("n_regionkey").cast("int") + 1)
    name = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("n"), "n_nationkey"))  # a missing name is the value
    sinks.write_csv(n.select(kind.alias("type"), name.alias("name"), F.col("n_name").alias("value")), path)
    return spark.createDataFrame([(t, k, v) for t, pairs in readers.read_config(spark, path).items() for k, v in pairs.items()], "type string, name string, value string")


@query("snk6_mer_list", "SELECT DISTINCT substring(upper(md5(p_name)), i, 4) AS value FROM part, range(1, 30) t(i)")
def snk6(spark, d):
    path = _scratch(spark)
    p = load(spark, d, "part").select("p_partkey", F.upper(F.md5("p_name")).alias("seq"))
    mers = Q.kmers(p, "p_partkey", "seq", 4)
    sinks.write_lines(mers.select(F.col("kmer").alias("value")), path)
    return spark.read.text(path)
