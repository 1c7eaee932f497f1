"""Bootstrap, permutation and generators (RS1-RS9).

A replicate is a column, not a loop: rows meet a replicate dimension, weights come
from a hash of (row, replicate, seed), and one group-by gives every replicate's
statistic. Repeats are thus the same on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distributions import NORMAL, normal_cdf_col
from quillon.session import shuffle_partitions

Stat = Callable[[Column], dict[str, Column]]


def uniform(*parts) -> Column:
    """A number in [0, 1) from the hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def poisson_one(u: Column) -> Column:
    """A Poisson(1) count from a uniform number."""
    out, total = F.lit(0), 0.0
    steps = []
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    for k in reversed(range(12)):
        out = F.when(u < steps[k], k).otherwise(out if k < 11 else F.lit(12))
    return out


def replicates(df: DataFrame, row: str, n: int, seed: int = 0) -> DataFrame:
    """Every row under every replicate with its Poisson(1) weight; rows of weight 0 are gone."""
    out = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("weight", poisson_one(uniform(F.col(row), "replicate", F.lit(seed)))).where("weight > 0")


def bootstrap_ci(df: DataFrame, row: str, stat: Stat, n: int = 500, alpha: float = 0.05, method: str = "percentile", by: list[str] = (), seed: int = 0, groups: int = 100) -> DataFrame:
    """(statistic, estimate, lo, hi) of weighted statistics.

    ``stat`` maps a weight column to aggregates. ``percentile`` takes the replicates
    of rank round((n - 1) alpha / 2) and its mirror; ``bca`` corrects both for bias and
    for the acceleration of a delete-a-group jackknife. A statistic without
    variation has its estimate as both limits.
    """
    names = list(stat(F.lit(1)))
    long = lambda x: x.unpivot([c for c in x.columns if c not in names], names, "statistic", "value")
    whole = long(df.groupBy(*by).agg(*(c.cast("double").alias(k) for k, c in stat(F.lit(1)).items()))).withColumnRenamed("value", "estimate")
    boot = long(replicates(df, row, n, seed).groupBy(*by, "replicate").agg(*(c.cast("double").alias(k) for k, c in stat(F.col("weight")).items())))
    keys = [*by, "statistic"]
    boot = boot.where("value IS NOT NULL").join(whole, keys)
    w = Window.partitionBy(*keys)
    ranked = boot.withColumn("k", F.row_number().over(w.orderBy("value")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    if method == "percentile":
        limits = ranked.withColumn("a", F.lit(alpha / 2)).withColumn("b", F.lit(1 - alpha / 2))
    else:
        gid = (F.pmod(F.xxhash64(row, F.lit(seed + 1)), F.lit(groups))).cast("int")
        parts = df.withColumn("_g", gid).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where("_g <> replicate")
        jack = long(parts.groupBy(*by, "replicate").agg(*(c.cast("double").alias(k) for k, c in stat(F.lit(1)).items()))).withColumn("m", F.avg("value").over(w))
        accel = jack.groupBy(*keys).agg((F.sum((F.col("m") - F.col("value")) ** 3) / (6 * F.pow(F.sum((F.col("m") - F.col("value")) ** 2), F.lit(1.5)))).alias("acc"))
        below = ranked.groupBy(*keys).agg(F.avg((F.col("value") < F.col("estimate")).cast("double")).alias("share"))
        fixed = below.join(accel, keys)
        inv = F.udf(lambda p: NORMAL.inv_cdf(min(max(p, 1e-9), 1 - 1e-9)), "double")  # one row a statistic
        z0, acc = inv("share"), F.coalesce(F.col("acc"), F.lit(0.0))
        shift = lambda q: normal_cdf_col(z0 + (z0 + NORMAL.inv_cdf(q)) / (1 - acc * (z0 + NORMAL.inv_cdf(q))))
        limits = ranked.join(fixed.select(*keys, shift(alpha / 2).alias("a"), shift(1 - alpha / 2).alias("b")), keys)
    at = lambda q: F.max(F.when(F.col("k") == F.round((F.col("n") - 1) * F.col(q)), F.col("value")))
    return limits.groupBy(*keys).agg(F.first("estimate").alias("estimate"), at("a").alias("lo"), at("b").alias("hi"))


def permutation_test(df: DataFrame, row: str, group: Column, stat: Callable[[Column], Column], n: int = 500, alternative: str = "two-sided", seed: int = 0, strict: bool = False) -> DataFrame:
    """(observed, p): group labels permuted jointly; p = (count at least as extreme + 1) / (n + 1).

    In each replicate the rows of the lowest hashes take the label, as many as have it.
    """
    d = df.withColumn("_g", group).where("_g IS NOT NULL")
    size = d.agg(F.count_if("_g").alias("k")).first()["k"]
    observed = d.agg(stat(F.col("_g")).cast("double").alias("observed"))
    perm = d.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    order = Window.partitionBy("replicate").orderBy(F.xxhash64(row, "replicate", F.lit(seed)), row)
    values = perm.withColumn("_p", F.row_number().over(order) <= size).groupBy("replicate").agg(stat(F.col("_p")).cast("double").alias("s"))
    v, o = (F.abs("s"), F.abs("observed")) if alternative == "two-sided" else (F.col("s"), F.col("observed")) if alternative == "greater" else (-F.col("s"), -F.col("observed"))
    hit = v > o if strict else v >= o - 1e-12
    return values.join(observed).groupBy("observed").agg(((F.sum(hit.cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def permuted_correlation(df: DataFrame, row: str, x: str, y: str, n: int = 500, seed: int = 0) -> DataFrame:
    """(rho, p) of a correlation under permutations of y: ranks of two hashes are matched, one join a run.

    Ranks are taken in ranges of the hash, so that no task holds a replicate. The join is of rows times replicates on both sides, whose
    size Spark takes for that of the rows: it is told to merge, not to broadcast one.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(row, x, y)
    parts = shuffle_partitions(df.sparkSession)
    d = d.repartition(parts)  # a file of few rows is one task's otherwise

    def ranked(value: str, s: int) -> DataFrame:
        rows = d.select(row, value, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate")).withColumn("_h", F.xxhash64(row, "replicate", F.lit(s)))
        rows = rows.withColumn("_b", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * parts).cast("int"))
        before = Window.partitionBy("replicate").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        starts = rows.groupBy("replicate", "_b").agg(F.count(F.lit(1)).alias("_n")).select("replicate", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        own = rows.select("replicate", "_b", value, F.row_number().over(Window.partitionBy("replicate", "_b").orderBy("_h", row)).alias("_own"))
        return own.join(F.broadcast(starts), ["replicate", "_b"]).select("replicate", value, (F.col("_own") + F.col("_start")).alias("k"))

    s = ranked(x, seed).join(ranked(y, seed + 1).hint("merge"), ["replicate", "k"]).groupBy("replicate").agg(F.corr(x, y).alias("s"))
    return s.join(d.agg(F.corr(x, y).alias("rho"))).groupBy("rho").agg(((F.sum((F.abs("s") >= F.abs("rho")).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def two_sample_bootstrap(df: DataFrame, row: str, value: str, group: Column, n: int = 500, seed: int = 0) -> DataFrame:
    """(difference, p): both groups recentred on the common mean, studentised differences resampled."""
    d = df.withColumn("_g", group).where(F.col("_g").isNotNull() & F.col(value).isNotNull())
    means = d.agg(F.avg(value).alias("m"), F.avg(F.when(F.col("_g"), F.col(value))).alias("a"), F.avg(F.when(~F.col("_g"), F.col(value))).alias("b")).first()
    centred = d.withColumn("_v", F.col(value) - F.when(F.col("_g"), means["a"]).otherwise(means["b"]) + means["m"])

    def t(v: str, w: Column) -> Column:
        part = lambda g: (F.sum(F.when(g, w * F.col(v))), F.sum(F.when(g, w * F.col(v) ** 2)), F.sum(F.when(g, w)))
        (s1, q1, n1), (s0, q0, n0) = part(F.col("_g")), part(~F.col("_g"))
        return (s1 / n1 - s0 / n0) / F.sqrt((q1 / n1 - (s1 / n1) ** 2) / (n1 - 1) + (q0 / n0 - (s0 / n0) ** 2) / (n0 - 1))

    observed = d.agg(t(value, F.lit(1)).alias("t"))
    boot = replicates(centred, row, n, seed).groupBy("replicate").agg(t("_v", F.col("weight")).alias("s"))
    return boot.join(observed).groupBy("t").agg(F.avg((F.abs("s") >= F.abs("t")).cast("double")).alias("p")).select(F.lit(means["a"] - means["b"]).alias("difference"), "t", "p")


def rejection_sample(spark, density: Callable[[Column], Column], envelope: float, low: float, high: float, n: int, seed: int = 0, rounds: int = 4) -> DataFrame:
    """n draws from a density, known up to a factor, on [low, high] under a constant envelope.

    Candidates are tried until n are accepted, each round as many as the acceptance so far asks for. Raises where the density exceeds the
    envelope, or where ``rounds`` do not give n.
    """
    width = high - low
    tries = int(2 * n * max(1.0, envelope * width)) + 100
    for _ in range(rounds):
        c = spark.range(tries).select("id", (low + width * uniform("id", F.lit(seed))).alias("x"), uniform("id", F.lit(seed + 1)).alias("u"))
        c = c.withColumn("_d", density(F.col("x")) / envelope)
        seen = c.agg(F.count_if(F.col("u") < F.col("_d")).alias("n"), F.max("_d").alias("top")).first()
        if seen["top"] is not None and seen["top"] > 1 + 1e-9:
            raise ValueError("the density exceeds its envelope")
        if seen["n"] >= n:
            return c.where(F.col("u") < F.col("_d")).orderBy("id").limit(n).select("id", "x")
        tries = int(min(1.2 * tries * n / seen["n"], 20 * tries) if seen["n"] else 20 * tries) + 100
    raise ValueError(f"fewer than {n} draws were accepted")


def normal_draws(spark, n: int, covariance: list[list[float]], seed: int = 0) -> DataFrame:
    """(id, x0, x1, ...) of a multivariate normal: Box-Muller on hashes, Cholesky factor as literals."""
    import numpy as np

    root = np.linalg.cholesky(np.asarray(covariance, float))
    k = len(root)
    z = [F.sqrt(-2 * F.ln(1 - uniform("id", F.lit(seed), F.lit(2 * j)))) * F.cos(2 * math.pi * uniform("id", F.lit(seed), F.lit(2 * j + 1))) for j in range(k)]
    return spark.range(n).select("id", *(sum((float(root[i, j]) * z[j] for j in range(i + 1)), F.lit(0.0)).alias(f"x{i}") for i in range(k)))


def binary_draws(spark, n: int, p: list[float], shared: float, seed: int = 0) -> DataFrame:
    """Correlated binary columns: each is 1 where its own and a shared Poisson count are both zero."""
    rate = [-math.log(x) for x in p]
    common = min(min(rate), shared)
    zero = lambda lam, j: uniform("id", F.lit(seed), F.lit(j)) < math.exp(-lam)
    return spark.range(n).select("id", *((zero(common, -1) & zero(r - common, j)).cast("int").alias(f"b{j}") for j, r in enumerate(rate)))


def draw_by_frequency(counts: DataFrame, key: str, n_col: str, draws: int, seed: int = 0) -> DataFrame:
    """Draws of keys by their share: each draw's place on the running total, as an as-of window over the union."""
    spark = counts.sparkSession
    total = counts.agg(F.sum(n_col)).first()[0]
    edges = counts.select(key, (F.sum(n_col).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n_col)).cast("double").alias("place"), F.lit(None).cast("long").alias("draw"))
    drawn = spark.range(draws).select(F.lit(None).cast(dict(counts.dtypes)[key]).alias(key), (uniform("id", F.lit(seed)) * total).alias("place"), F.col("id").alias("draw"))
    filled = F.last(key, ignorenulls=True).over(Window.orderBy("place", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return edges.unionByName(drawn).withColumn("_k", filled).where("draw IS NOT NULL").select("draw", F.col("_k").alias(key))
