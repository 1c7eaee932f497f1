"""Exact and asymptotic tests, intervals of proportions, multiplicity (ST1-ST28)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distributions import NORMAL, beta_ppf_col, chi2_sf_col, log_choose_col, log_factorial_col, normal_cdf_col, t_p_col, z_value


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _nz(c: Column) -> Column:
    """A divisor: null where it is zero, so that the quotient is null."""
    return F.nullif(c, F.lit(0))


def fisher_exact(a, b, c, d, alternative: str = "two-sided") -> Column:
    """Fisher's exact p of a 2x2 table, row by row and inside the JVM.

    The log probability of the first table is closed form; those of the others
    follow by ratios in one fold. Two-sided sums the tables not likelier than the
    observed one (with a relative slack of 1e-7).
    """
    a, b, c, d = (_c(x).cast("long") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    low, high = F.greatest(F.lit(0), col - (c + d)), F.least(row, col)
    first, last = {"two-sided": (low, high), "greater": (a, high), "less": (low, a)}[alternative]
    rest = n - row - col
    facts = F.transform(F.array(col, n - col, row, n - row, n, *(x for k in (first, a) for x in (k, col - k, row - k, rest + k))), log_factorial_col)
    fixed = lambda f: f[0] + f[1] + f[2] + f[3] - f[4]
    logp = lambda f, i: fixed(f) - f[i] - f[i + 1] - f[i + 2] - f[i + 3]
    # One evaluation of the factorials feeds both probabilities.
    both = F.get(F.transform(F.array(facts), lambda f: F.struct(logp(f, 5).alias("lp"), logp(f, 9).alias("seen"))), F.lit(0))
    state = F.struct(both.alias("p"), row.alias("row"), col.alias("col"), rest.alias("rest"), F.lit(0.0).alias("sum"))

    def step(s, k):
        lp, seen = s["p"]["lp"], s["p"]["seen"]
        term = F.when(lp <= seen + 1e-7, F.exp(lp)).otherwise(0.0) if alternative == "two-sided" else F.exp(lp)
        ratio = (s["row"] - k) * (s["col"] - k) / ((k + 1) * F.greatest(s["rest"] + k + 1, F.lit(1)))
        moved = F.struct((lp + F.coalesce(F.ln(ratio), F.lit(0.0))).alias("lp"), seen.alias("seen"))
        return F.struct(moved.alias("p"), s["row"].alias("row"), s["col"].alias("col"), s["rest"].alias("rest"), (s["sum"] + term).alias("sum"))

    return F.least(F.lit(1.0), F.aggregate(F.sequence(first, last), state, step, lambda s: s["sum"]))


def odds_ratio(a, b, c, d) -> Column:
    return _c(a) * _c(d) / F.nullif(_c(b) * _c(c), F.lit(0))


def two_by_two(df: DataFrame, x: Column, y: Column, by: list[str] = ()) -> DataFrame:
    """Counts a (x and y), b (x only), c (y only), d (neither) of rows where both are known."""
    df = df.withColumn("_x", x).withColumn("_y", y).where("_x IS NOT NULL AND _y IS NOT NULL")
    n = lambda cond: F.count_if(cond)
    return df.groupBy(*by).agg(n(F.col("_x") & F.col("_y")).alias("a"), n(F.col("_x") & ~F.col("_y")).alias("b"), n(~F.col("_x") & F.col("_y")).alias("c"), n(~F.col("_x") & ~F.col("_y")).alias("d"))


def adjust(df: DataFrame, p: str, method: str = "holm", within: list[str] = (), name: str = "q") -> DataFrame:
    """Adjusted p-values within groups, over non-null ones alone; null stays null.

    Methods: holm, bonferroni, sidak, holm-sidak, simes-hochberg, fdr_bh, fdr_by.
    """
    w = Window.partitionBy(*within, F.col(p).isNull())
    order = w.orderBy(F.col(p))
    m = F.count(p).over(w)
    i = F.row_number().over(order)  # of equal p the one that counts most decides for all: the least i going up, the largest going down
    v = F.col(p)
    down = w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    up = w.orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_m", m).withColumn("_i", i)
    if method == "bonferroni":
        q = F.least(F.lit(1.0), v * F.col("_m"))
    elif method == "sidak":
        q = 1 - F.pow(1 - v, F.col("_m"))
    elif method == "holm":
        q = F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * v)).over(down)
    elif method == "holm-sidak":
        q = F.max(1 - F.pow(1 - v, F.col("_m") - F.col("_i") + 1)).over(down)
    elif method == "simes-hochberg":
        q = F.min(F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * v)).over(up)
    elif method in ("fdr_bh", "fdr_by"):
        scale = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda s, k: s + 1 / k) if method == "fdr_by" else F.lit(1.0)
        q = F.min(F.least(F.lit(1.0), v * F.col("_m") / F.col("_i") * scale)).over(up)
    else:
        raise ValueError(f"unknown method {method}")
    return out.withColumn(name, F.when(v.isNotNull(), q)).drop("_m", "_i")


def wilson(x, n, alpha: float = 0.05) -> tuple[Column, Column]:
    z = z_value(alpha)
    x, n = _c(x), _nz(_c(n))
    p, n2 = x / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / n2, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / n2
    return mid - half, mid + half


def agresti_coull(x, n, alpha: float = 0.05) -> tuple[Column, Column]:
    z = z_value(alpha)
    n2 = _c(n) + z * z
    p = (_c(x) + z * z / 2) / n2
    half = z * F.sqrt(p * (1 - p) / n2)
    return p - half, p + half


def wald(x, n, alpha: float = 0.05) -> tuple[Column, Column]:
    p = _c(x) / _nz(_c(n))
    half = z_value(alpha) * F.sqrt(p * (1 - p) / _nz(_c(n)))
    return p - half, p + half


def clopper_pearson(x, n, alpha: float = 0.05) -> tuple[Column, Column]:
    x, n = _c(x), _c(n)
    return (
        F.when(x == 0, 0.0).otherwise(beta_ppf_col(F.lit(alpha / 2), x, n - x + 1)),
        F.when(x == n, 1.0).otherwise(beta_ppf_col(F.lit(1 - alpha / 2), x + 1, n - x)),
    )


INTERVALS = {"score": wilson, "wilson": wilson, "agresti-coull": agresti_coull, "wald": wald, "exact": clopper_pearson}


def risk_ratio(x1, n1, x2, n2, alpha: float = 0.05, adjusted: bool = False) -> tuple[Column, Column, Column, Column]:
    """Ratio of x1/n1 to x2/n2, its log-normal interval (Katz; ``adjusted`` adds 0.5 to all) and two-sided p."""
    x1, n1, x2, n2 = (_c(x).cast("double") for x in (x1, n1, x2, n2))
    k = 0.5 if adjusted else 0.0
    x1, n1, x2, n2 = (_nz(v + k) for v in (x1, n1, x2, n2))
    rr = x1 / n1 / (x2 / n2)
    se = F.sqrt(1 / x1 - 1 / n1 + 1 / x2 - 1 / n2)
    z = z_value(alpha)
    return rr, F.exp(F.ln(rr) - z * se), F.exp(F.ln(rr) + z * se), 2 * normal_cdf_col(-F.abs(F.ln(rr) / _nz(se)))


def proportions_p(x1, n1, x2, n2, ratio: float = 1.0) -> Column:
    """Chi-squared p (one degree) of x1/n1 = ratio * x2/n2, with the expected counts under that ratio."""
    x1, n1, x2, n2 = (_c(x).cast("double") for x in (x1, n1, x2, n2))
    a, b, c = (n1 + n2) * ratio, -(n1 * ratio + x1 + n2 + x2 * ratio), x1 + x2
    p2 = (-b - F.sqrt(b * b - 4 * a * c)) / (2 * a)
    p1 = ratio * p2
    z2 = (x1 - n1 * p1) ** 2 / _nz(n1 * p1 * (1 - p1)) + (x2 - n2 * p2) ** 2 / _nz(n2 * p2 * (1 - p2))
    return chi2_sf_col(z2, F.lit(1))


def difference_interval(x1, n1, x2, n2, alpha: float = 0.05, steps: int = 50) -> tuple[Column, Column]:
    """Miettinen and Nurminen's score interval of p1 - p2 by bisection, inside the JVM."""
    x1, n1, x2, n2 = (_c(x).cast("double") for x in (x1, n1, x2, n2))
    n, x, z = n1 + n2, x1 + x2, z_value(alpha)
    gap = x1 / n1 - x2 / n2

    def score(delta: Column) -> Column:
        # The closed-form root of the restricted likelihood's cubic.
        l3, l2 = n, (n1 + 2 * n2) * delta - n - x
        l1, l0 = (n2 * delta - n - 2 * x2) * delta + x, x2 * delta * (1 - delta)
        q = l2**3 / (3 * l3) ** 3 - l1 * l2 / (6 * l3 * l3) + l0 / (2 * l3)
        s = F.sqrt(F.greatest(l2**2 / (3 * l3) ** 2 - l1 / (3 * l3), F.lit(0.0)))
        p = F.when(q > 0, s).otherwise(-s)
        angle = (math.pi + F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(p != 0, q / p**3).otherwise(0.0))))) / 3
        p2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * p * F.cos(angle) - l2 / (3 * l3)))
        p1 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p2 + delta))
        var = (p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) * n / (n - 1)
        return F.abs(gap - delta) / F.sqrt(F.greatest(var, F.lit(1e-300)))

    def bisect(end: float) -> Column:
        start = F.struct(gap.alias("inside"), F.lit(end).alias("outside"))

        def step(s, _):
            mid = (s["inside"] + s["outside"]) / 2
            good = score(mid) <= z
            return F.struct(F.when(good, mid).otherwise(s["inside"]).alias("inside"), F.when(good, s["outside"]).otherwise(mid).alias("outside"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["inside"])

    return bisect(-1.0), bisect(1.0)


def t_test(df: DataFrame, value: str, group: Column, by: list[str] = (), welch: bool = True) -> DataFrame:
    """Two-sample t of the rows where ``group`` holds against the rest: diff, t, degrees and two-sided p. Null values are left out."""
    g = df.withColumn("_g", group).where(F.col(value).isNotNull() & F.col("_g").isNotNull())
    side = lambda f, name: [f(F.when(F.col("_g"), F.col(value))).alias(name + "1"), f(F.when(~F.col("_g"), F.col(value))).alias(name + "0")]
    s = g.groupBy(*by).agg(*side(F.avg, "m"), *side(F.var_samp, "v"), *side(F.count, "n"))
    n1, n0 = _nz(F.col("n1")), _nz(F.col("n0"))
    a, b = F.col("v1") / n1, F.col("v0") / n0
    if welch:
        se, dof = F.sqrt(a + b), (a + b) ** 2 / _nz(a * a / _nz(n1 - 1) + b * b / _nz(n0 - 1))
    else:
        dof = (F.col("n1") + F.col("n0") - 2).cast("double")
        pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / _nz(dof)
        se = F.sqrt(pooled * (1 / n1 + 1 / n0))
    s = s.withColumn("diff", F.col("m1") - F.col("m0")).withColumn("dof", dof).withColumn("t", F.col("diff") / _nz(se))
    return s.withColumn("p", t_p_col("t", "dof")).select(*by, "diff", "t", "dof", "p")


def rank_sum(df: DataFrame, value: str, group: Column, by: list[str] = ()) -> DataFrame:
    """Wilcoxon's rank sum by midranks: z and two-sided normal p. Values are pre-aggregated, so ties cost nothing."""
    g = df.withColumn("_g", group).where(F.col(value).isNotNull() & F.col("_g").isNotNull())
    cells = g.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_g")).alias("_k"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_r", F.sum("_n").over(w) - (F.col("_n") - 1) / 2)
    s = cells.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_k")).alias("w"), F.sum("_k").alias("n1"), (F.sum("_n") - F.sum("_k")).alias("n0"))
    mean = F.col("n1") * (F.col("n1") + F.col("n0") + 1) / 2
    s = s.withColumn("z", (F.col("w") - mean) / _nz(F.sqrt(F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12)))
    return s.withColumn("p", 2 * normal_cdf_col(-F.abs("z"))).select(*by, "w", "z", "p")


def chi2_clusters(counts: DataFrame, cluster: str, condition: str, n: str, least: float = 0) -> DataFrame:
    """Each cluster against the rest: chi-squared of a 2 x conditions table, with Holm and BH. Small clusters have null p."""
    cells = counts.groupBy(cluster, condition).agg(F.sum(n).alias("o"))
    grid = cells.select(cluster).distinct().join(cells.groupBy(condition).agg(F.sum("o").alias("c")))
    full = grid.join(cells, [cluster, condition], "left").na.fill(0, ["o"])
    full = full.withColumn("r", F.sum("o").over(Window.partitionBy(cluster))).withColumn("t", F.sum("c").over(Window.partitionBy(cluster)))
    e = F.col("r") * F.col("c") / _nz(F.col("t"))
    rest = (F.col("t") - F.col("r")) * F.col("c") / _nz(F.col("t"))
    s = full.groupBy(cluster).agg(F.sum((F.col("o") - e) ** 2 / _nz(e) + (F.col("c") - F.col("o") - rest) ** 2 / _nz(rest)).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"), F.first("r").alias("total"))
    s = s.withColumn("p", F.when(F.col("total") > least, chi2_sf_col("chi2", "dof")))
    return adjust(adjust(s, "p", "holm", name="holm"), "p", "fdr_bh", name="fdr")


def likelihood_ratio_p(full: Column, restricted: Column, dof: Column) -> Column:
    return chi2_sf_col(-2 * (restricted - full), dof)


def correlation_difference_p(r1, n1, r2, n2) -> Column:
    """Two-sided p of equal correlations by Fisher's z."""
    z = (F.atanh(_c(r1)) - F.atanh(_c(r2))) / F.sqrt(1 / (_c(n1) - 3) + 1 / (_c(n2) - 3))
    return 2 * normal_cdf_col(-F.abs(z))


def correlation_interval(r, n, alpha: float = 0.05, factor: float = 1.0) -> tuple[Column, Column]:
    """Fisher's z interval; ``factor`` 1.06 is for rank correlations."""
    half = z_value(alpha) * F.sqrt(F.lit(factor) / (_c(n) - 3))
    return F.tanh(F.atanh(_c(r)) - half), F.tanh(F.atanh(_c(r)) + half)


def westfall_young(observed: DataFrame, permuted: DataFrame, test: str, p: str, replicate: str) -> DataFrame:
    """Step-down FWER-adjusted p from permutation p-values (replicate, test, p).

    For the j-th smallest p, the share of replicates whose least p over the tests
    not smaller is at most it, made monotone.
    """
    order = observed.select(test, F.col(p).alias("_p"), F.row_number().over(Window.orderBy(p, test)).alias("_j"))
    b = permuted.select(replicate).distinct().count()
    joined = permuted.join(order, test)
    least = F.min(p).over(Window.partitionBy(replicate).orderBy(F.col("_j").desc()).rowsBetween(Window.unboundedPreceding, 0))
    share = joined.withColumn("_least", least).groupBy(test, "_p", "_j").agg((F.sum((F.col("_least") <= F.col("_p")).cast("int")) / b).alias("_s"))
    return share.select(test, F.col("_p").alias(p), F.max("_s").over(Window.orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)).alias("fwer"))


def binomial_tail(n, p, k) -> Column:
    """P(X >= k) of a binomial, inside the JVM."""
    n, p, k = _c(n), _c(p), _c(k)
    term = lambda i: F.exp(log_choose_col(n, i) + i * F.ln(p) + (n - i) * F.ln(1 - p))
    return F.when(k > n, 0.0).otherwise(F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.lit(0.0), lambda s, i: s + term(i)))


def poisson_binomial_tail(p: Column, k: int) -> Column:
    """P(at least k of independent events), by folding the array of probabilities over the counts 0 to k."""
    zero = F.array(*(F.lit(1.0 if i == 0 else 0.0) for i in range(k + 1)))
    step = lambda state, q: F.transform(
        F.sequence(F.lit(0), F.lit(k)),
        lambda i: F.when(i == k, F.get(state, i) + F.when(i > 0, F.get(state, i - 1) * q).otherwise(0.0)).otherwise(F.get(state, i) * (1 - q) + F.when(i > 0, F.get(state, i - 1) * q).otherwise(0.0)),
    )
    return F.aggregate(p, zero, step, lambda s: F.get(s, F.lit(k)))


def power_two_means(effect, n1, n2, alpha: float = 0.05) -> Column:
    """Normal approximation of the power of a two-sample test of a standardised difference."""
    shift = F.abs(_c(effect)) / F.sqrt(1 / _c(n1) + 1 / _c(n2))
    z = z_value(alpha)
    return normal_cdf_col(shift - z) + normal_cdf_col(-shift - z)


def endpoints_required(ve: Column, null: float, ratio: float, power: float = 0.9, alpha: float = 0.025) -> Column:
    """Events needed to show an efficacy above ``null``: the conditional share of events in the treated arm."""
    za, zb = NORMAL.inv_cdf(1 - alpha), NORMAL.inv_cdf(power)
    share = lambda v: ratio * (1 - v) / (1 + ratio * (1 - v))
    p0, p1 = share(F.lit(null)), share(ve)
    return F.ceil(((za * F.sqrt(p0 * (1 - p0)) + zb * F.sqrt(p1 * (1 - p1))) / (p1 - p0)) ** 2)


def case_control_size(rate: Column, odds: Column, controls: float = 1.0, power: float = 0.8, alpha: float = 0.05) -> Column:
    """Cases needed to find an odds ratio given the exposure rate of controls."""
    za, zb = z_value(alpha), NORMAL.inv_cdf(power)
    p1 = odds * rate / (1 + rate * (odds - 1))
    p = (p1 + controls * rate) / (1 + controls)
    top = za * F.sqrt((1 + 1 / controls) * p * (1 - p)) + zb * F.sqrt(p1 * (1 - p1) + rate * (1 - rate) / controls)
    return F.ceil((top / (p1 - rate)) ** 2)
