"""Survival, quantiles, diversity and composition (SV1-SV4, QT1-QT6, DV1-DV8, CP1-CP5)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distributions import beta_inc, z_value

# --- survival


def nelson_aalen(df: DataFrame, duration: str, event: Column, by: list[str] = ()) -> DataFrame:
    """(time, at_risk, events, hazard, variance) at each distinct duration: one group-by and running sums."""
    cells = df.where(F.col(duration).isNotNull()).groupBy(*by, F.col(duration).alias("time")).agg(F.count(F.lit(1)).alias("left"), F.count_if(event).alias("events"))
    w = Window.partitionBy(*by)
    run = w.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    c = cells.withColumn("at_risk", F.sum("left").over(w) - F.sum("left").over(run) + F.col("left"))
    return c.select(*by, "time", "at_risk", "events", F.sum(F.col("events") / F.col("at_risk")).over(run).alias("hazard"), F.sum(F.col("events") / (F.col("at_risk") * F.col("at_risk"))).over(run).alias("variance"))


def cumulative_incidence(df: DataFrame, duration: str, event: Column, by: list[str] = (), stratum: str | None = None, alpha: float = 0.05) -> DataFrame:
    """1 - exp(-H) with its standard error and interval; strata are put on one grid of times and weighted by ``stratum`` (normalised)."""
    z = z_value(alpha)
    if stratum is None:
        h = nelson_aalen(df, duration, event, by)
    else:
        keys = [*by, stratum]
        h = nelson_aalen(df, duration, event, keys)
        grid = h.select(*by, "time").distinct().join(h.select(*keys).distinct(), list(by)) if by else h.select("time").distinct().crossJoin(h.select(stratum).distinct())
        w = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
        fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0))
        full = grid.join(h, [*keys, "time"], "left").withColumn("hazard", fill("hazard")).withColumn("variance", fill("variance"))
        whole = Window.partitionBy(*by, "time")
        share = F.col(stratum) / F.sum(stratum).over(whole)
        full = full.withColumn("_s", share)
        h = full.groupBy(*by, "time").agg(F.sum(F.col("_s") * F.col("hazard")).alias("hazard"), F.sum(F.col("_s") ** 2 * F.col("variance")).alias("variance"))
    half = z * F.sqrt("variance")
    inc = lambda x: 1 - F.exp(-x)
    return h.withColumns({"incidence": inc(F.col("hazard")), "se": F.sqrt("variance") * F.exp(-F.col("hazard")), "lo": inc(F.greatest(F.lit(0.0), F.col("hazard") - half)), "hi": inc(F.col("hazard") + half)})


def incidence_contrast(df: DataFrame, duration: str, event: Column, arm: Column, alpha: float = 0.05) -> DataFrame:
    """Ratio, difference and efficacy of the two arms' cumulative incidence on the union of their times; null while either is zero."""
    c = cumulative_incidence(df.withColumn("_arm", arm), duration, event, ["_arm"])
    grid = c.select("time").distinct()
    out = grid
    for name, flag in (("1", True), ("0", False)):
        side = c.where(F.col("_arm") == flag).select("time", F.col("incidence").alias("i" + name), F.col("se").alias("s" + name))
        out = out.join(side, "time", "left")
    w = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({x: F.coalesce(F.last(x, ignorenulls=True).over(w), F.lit(0.0)) for x in ("i1", "s1", "i0", "s0")})
    z = z_value(alpha)
    both = (F.col("i1") > 0) & (F.col("i0") > 0)
    log, se = F.when(both, F.ln(F.col("i1") / F.col("i0"))), F.when(both, F.sqrt((F.col("s1") / F.col("i1")) ** 2 + (F.col("s0") / F.col("i0")) ** 2))
    return out.select("time", "i1", "i0", F.exp(log).alias("ratio"), F.exp(log - z * se).alias("ratio_lo"), F.exp(log + z * se).alias("ratio_hi"), (1 - F.exp(log)).alias("efficacy"), (F.col("i1") - F.col("i0")).alias("difference"), F.sqrt(F.col("s1") ** 2 + F.col("s0") ** 2).alias("difference_se"))


def log_rank(df: DataFrame, duration: str, event: Column, arm: Column) -> DataFrame:
    """Observed and expected events of the arm, and z, from risk sets by window."""
    cells = df.withColumn("_arm", arm).where(F.col(duration).isNotNull()).groupBy(F.col(duration).alias("time")).agg(
        F.count(F.lit(1)).alias("left"), F.count_if("_arm").alias("left1"), F.count_if(event).alias("d"), F.count_if(event & F.col("_arm")).alias("d1")
    )
    whole, run = Window.partitionBy(), Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda c: F.sum(c).over(whole) - F.sum(c).over(run) + F.col(c)
    c = cells.withColumn("n", n("left")).withColumn("n1", n("left1"))
    e = F.col("d") * F.col("n1") / F.col("n")
    v = F.when(F.col("n") > 1, F.col("d") * (F.col("n1") / F.col("n")) * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    s = c.agg(F.sum("d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    return s.withColumn("z", F.try_divide(F.col("observed") - F.col("expected"), F.sqrt("variance")))


# --- quantiles


def weighted_quantile(df: DataFrame, value: str, weight: str, q: list[float], by: list[str] = ()) -> DataFrame:
    """(q, quantile): linear interpolation of the midpoint weighted CDF (cum - w/2) / sum, clamped at the ends."""
    cells = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, F.col(value).alias("x")).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*by)
    order = w.orderBy("x")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    c = cells.withColumn("f", (F.sum("w").over(run) - F.col("w") / 2) / F.sum("w").over(w))
    c = c.withColumn("f2", F.lead("f").over(order)).withColumn("x2", F.lead("x").over(order)).withColumn("first", F.row_number().over(order) == 1)
    c = c.withColumn("q", F.explode(F.array(*map(F.lit, q))))
    at = F.when(F.col("first") & (F.col("q") <= F.col("f")), F.col("x")).when(F.col("f2").isNull() & (F.col("q") >= F.col("f")), F.col("x")).when((F.col("q") >= F.col("f")) & (F.col("q") < F.col("f2")), F.col("x") + (F.col("q") - F.col("f")) / (F.col("f2") - F.col("f")) * (F.col("x2") - F.col("x")))
    return c.withColumn("quantile", at).groupBy(*by, "q").agg(F.max("quantile").alias("quantile"))


def quantile_interval(df: DataFrame, value: str, q: float, alpha: float = 0.05, method: str = "exact") -> DataFrame:
    """(quantile, lo, hi): linear quantiles at q and at the ends of an interval of fractional order statistics.

    The ends x solve I_q((n + 1) x, (n + 1) (1 - x)) = 1 - alpha / 2 and alpha / 2
    (``exact``), or are quantiles of the beta distribution of ((n + 1) q, (n + 1) (1 - q))
    (``approximate``); they depend on n and q alone. Nulls do not count; without values all is null.
    """
    n = df.where(F.col(value).isNotNull()).count()
    q = min(max(q, 1e-7), 1 - 1e-7)

    def root(rises: Callable[[float], float], level: float) -> float:
        lo, hi = 1e-8, 1 - 1e-8
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if rises(mid) < level else (lo, mid)
        return (lo + hi) / 2

    if method == "exact":
        upper = lambda x: 1 - beta_inc((n + 1) * x, (n + 1) * (1 - x), q)
    elif method == "approximate":
        upper = lambda x: beta_inc((n + 1) * q, (n + 1) * (1 - q), x)
    else:
        raise ValueError(f"unknown method {method}")
    ends = [root(upper, alpha / 2), root(upper, 1 - alpha / 2)]
    at = F.percentile(value, F.array(*map(F.lit, [q, *ends])))
    return df.agg(at.alias("p")).select(*(F.get("p", F.lit(k)).alias(name) for k, name in enumerate(("quantile", "lo", "hi"))))


def ecdf(df: DataFrame, value: str, weight: Column | None = None, by: list[str] = ()) -> DataFrame:
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("w"))
    w = Window.partitionBy(*by)
    return cells.select(*by, value, (F.sum("w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(w)).alias("f"))


def bin_edges(df: DataFrame, value: str) -> DataFrame:
    """Freedman and Diaconis: width 2 IQR / n^(1/3) and the edges."""
    s = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    s = s.withColumn("width", 2 * (F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / F.pow("n", F.lit(1 / 3)))
    return s.select("width", F.ceil(F.try_divide(F.col("hi") - F.col("lo"), F.col("width"))).alias("bins"), "lo", "hi")


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(q.alias("q"), F.count(value).alias("n")).select(*by, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q2"), F.get("q", F.lit(2)).alias("q3"), "n")


# --- diversity


def diversity(counts: DataFrame, n: str, by: list[str] = ()) -> DataFrame:
    """Shannon entropy (bits), Simpson's concentration, complement and reciprocal of counts."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*by))
    s = counts.where(F.col(n) > 0).withColumn("_p", p).groupBy(*by).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"), F.sum(F.col("_p") * F.col("_p")).alias("simpson"))
    return s.withColumn("complement", 1 - F.col("simpson")).withColumn("reciprocal", 1 / F.col("simpson"))


def generalized_simpson(counts: DataFrame, n: str, orders: list[int], by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Z_r = sum p prod_{k<r} (1 - (c - 1) / (N - k)), its delta-method interval and the effective number 1 / (1 - Z^(1/r))."""
    z = z_value(alpha)
    total = F.sum(n).over(Window.partitionBy(*by)).cast("double")
    c = counts.where(F.col(n) > 0).withColumn("_t", total).withColumn("_p", F.col(n) / F.col("_t")).withColumn("order", F.explode(F.array(*map(F.lit, orders))))
    prod = F.aggregate(F.filter(F.sequence(F.lit(0), F.col("order") - 1), lambda k: k > 0), F.lit(1.0), lambda a, k: a * (1 - (F.col(n) - 1) / (F.col("_t") - k)))
    p, r = F.col("_p"), F.col("order").cast("double")
    slope = F.pow(1 - p, r - 1) - F.when(r > 1, (r - 1) * p * F.pow(1 - p, r - 2)).otherwise(0.0)
    s = c.withColumn("_z", p * prod).withColumn("_h", slope).groupBy(*by, "order").agg(F.sum("_z").alias("z"), F.sum(p * F.col("_h") ** 2).alias("_a"), F.sum(p * F.col("_h")).alias("_b"), F.first("_t").alias("_t"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_a") - F.col("_b") ** 2) / F.col("_t"))
    return s.select(*by, "order", "z", sd.alias("sd"), (F.col("z") - z * sd).alias("lo"), (F.col("z") + z * sd).alias("hi"), F.try_divide(F.lit(1.0), 1 - F.pow("z", 1 / F.col("order"))).alias("effective"))


def compare_distributions(a: DataFrame, b: DataFrame, key: str, n: str) -> DataFrame:
    """Kullback-Leibler (nats, over keys of both), Jensen-Shannon divergence and Morisita-Horn overlap of two histograms."""
    side = lambda x, s: x.groupBy(key).agg(F.sum(n).cast("double").alias(s))
    j = side(a, "x").join(side(b, "y"), key, "full_outer").na.fill(0.0, ["x", "y"])
    whole = Window.partitionBy()
    j = j.withColumn("p", F.coalesce(F.try_divide(F.col("x"), F.sum("x").over(whole)), F.lit(0.0))).withColumn("q", F.coalesce(F.try_divide(F.col("y"), F.sum("y").over(whole)), F.lit(0.0))).withColumn("m", (F.col("p") + F.col("q")) / 2)
    xlog = lambda u, v: F.when(u > 0, u * F.ln(u / v)).otherwise(0.0)
    kl = F.sum(F.when(F.col("q") > 0, xlog(F.col("p"), F.col("q"))))
    jsd = F.sum((xlog(F.col("p"), F.col("m")) + xlog(F.col("q"), F.col("m"))) / 2)
    mh = F.try_divide(2 * F.sum(F.col("p") * F.col("q")), F.sum(F.col("p") ** 2) + F.sum(F.col("q") ** 2))
    return j.agg(kl.alias("kl"), jsd.alias("jsd"), mh.alias("morisita_horn"))


def fuzzy_diversity(counts: DataFrame, key: str, n: str, distances: DataFrame, threshold: float) -> DataFrame:
    """Share of pairs of individuals (of unlike keys) nearer than the threshold: sum c_i c_j over all (sum c)^2."""
    c = counts.select(F.col(key).alias("i"), F.col(n).alias("ci"))
    near = distances.where((F.col("d") < threshold) & (F.col("i") < F.col("j"))).join(c, "i").join(c.toDF("j", "cj"), "j")
    total = counts.agg(F.sum(n).cast("double").alias("t"))
    return near.agg(F.sum(F.col("ci") * F.col("cj")).alias("s")).join(total).select((F.coalesce("s", F.lit(0)) / (F.col("t") * F.col("t"))).alias("diversity"))


# --- composition


def log_ratios(long: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """log x_j - log x_i of each pair of features i < j within a sample."""
    a = long.select(sample, F.col(feature).alias("i"), F.ln(value).alias("_a"))
    b = long.select(sample, F.col(feature).alias("j"), F.ln(value).alias("_b"))
    return a.join(b, sample).where("i < j").select(sample, "i", "j", (F.col("_b") - F.col("_a")).alias("log_ratio"))


def centred_log_ratio(long: DataFrame, sample: str, feature: str, value: str, delta: float | None = None) -> DataFrame:
    """CLR after multiplicative replacement of zeros (``delta``, by default 1 / D^2)."""
    w = Window.partitionBy(sample)
    d = F.count(F.lit(1)).over(w)
    p = F.col(value) / F.sum(value).over(w)
    fill = F.lit(delta) if delta is not None else 1.0 / (d * d)
    x = long.withColumn("_p", p).withColumn("_f", fill).withColumn("_z", F.count_if(F.col(value) == 0).over(w))
    x = x.withColumn("_r", F.when(F.col("_p") == 0, F.col("_f")).otherwise((1 - F.col("_z") * F.col("_f")) * F.col("_p")))
    return x.select(sample, feature, (F.ln("_r") - F.avg(F.ln("_r")).over(w)).alias("clr"))


def kernel_density(points: DataFrame, x: str, y: str, grid: int, bandwidth: float) -> DataFrame:
    """Gaussian density of 2-D points on a grid x grid lattice over their range.

    Points only reach lattice nodes within five bandwidths: an explode of near
    nodes, not a product of points and nodes.
    """
    e = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count(F.lit(1)).alias("n")).first()
    out = points
    for c, lo, hi in ((x, e["x0"], e["x1"]), (y, e["y0"], e["y1"])):
        step = (hi - lo) / (grid - 1) or 1.0
        near = F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - 5 * bandwidth - lo) / step)).cast("int"), F.least(F.lit(grid - 1), F.floor((F.col(c) + 5 * bandwidth - lo) / step)).cast("int"))
        out = out.withColumn(f"g_{c}", F.explode(near)).withColumn(f"d_{c}", F.col(c) - (F.col(f"g_{c}") * step + lo))
    k = F.exp(-(F.col(f"d_{x}") ** 2 + F.col(f"d_{y}") ** 2) / (2 * bandwidth**2)) / (2 * math.pi * bandwidth**2 * e["n"])
    return out.groupBy(F.col(f"g_{x}").alias("gx"), F.col(f"g_{y}").alias("gy")).agg(F.sum(k).alias("density"))


def covariance_ellipse(df: DataFrame, x: str, y: str, by: list[str] = (), deviations: float = 2.0) -> DataFrame:
    """Centre, axes and angle (degrees) of the covariance ellipse: the closed form of a 2x2 matrix."""
    s = df.groupBy(*by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("a"), F.var_samp(y).alias("c"), F.covar_samp(x, y).alias("b"))
    mid, gap = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    return s.select(*by, "cx", "cy", (2 * deviations * F.sqrt(mid + gap)).alias("width"), (2 * deviations * F.sqrt(F.greatest(mid - gap, F.lit(0.0)))).alias("height"), F.degrees(F.atan2(mid + gap - F.col("a"), F.col("b"))).alias("angle"))
