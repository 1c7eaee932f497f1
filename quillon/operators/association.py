"""Correlation, association and ROC operators (CO1-CO12, RO1-RO9, ST2-ST5)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distributions import normal_cdf_col, t_p_col, z_value
from quillon.operators.aggregates import mid_rank
from quillon.operators.prefix import range_parts, running
from quillon.operators.tests import adjust, fisher_exact, wilson
from quillon.session import stage


def _long(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(F.col(row).alias("row"), F.explode(pairs).alias("s")).select("row", "s.*").where("value IS NOT NULL AND NOT isnan(value)")


def correlations(df: DataFrame, row: str, columns: list[str], others: list[str] | None = None, method: str = "pearson", min_n: int = 5, ties: str = "average") -> DataFrame:
    """(a, b, n, rho, p) of every pair of columns over the rows in which both have a value.

    pearson: one aggregation over all pairs. spearman: ranks are taken within the
    pair, after nulls are gone, so pairs are laid out long and ranked by windows;
    ``ties`` is average or ordinal. p is Student's with n - 2 degrees. Pairs of
    fewer than ``min_n`` rows have null rho.
    """
    todo = [(a, b) for a in columns for b in others if a != b] if others is not None else list(combinations(columns, 2))
    if method == "pearson":
        ok = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
        x = lambda a, b: F.when(ok(a, b), F.col(a).cast("double"))
        row_ = df.agg(*(f for i, (a, b) in enumerate(todo) for f in (F.corr(x(a, b), x(b, a)).alias(f"r{i}"), F.count_if(ok(a, b)).alias(f"n{i}"))))
        out = row_.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("rho")) for i, (a, b) in enumerate(todo)))).alias("s")).select("s.*")
    else:
        long = _long(df, row, list(dict.fromkeys([c for p in todo for c in p])))
        left = long.select("row", F.col("feature").alias("a"), F.col("value").alias("x"))
        right = long.select("row", F.col("feature").alias("b"), F.col("value").alias("y"))
        wanted = F.concat_ws("\x1f", "a", "b").isin(["\x1f".join(p) for p in todo])
        pairs = left.join(right, "row").where(wanted)
        if ties == "average":
            rx, ry = mid_rank("x", ["a", "b"]), mid_rank("y", ["a", "b"])
        else:
            rx, ry = (F.row_number().over(Window.partitionBy("a", "b").orderBy(v, "row")) for v in ("x", "y"))
        out = pairs.withColumn("rx", rx.cast("double")).withColumn("ry", ry.cast("double")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))
    out = out.withColumn("rho", F.when(F.col("n") >= min_n, F.nanvl("rho", F.lit(None).cast("double"))))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-300)))
    return out.withColumn("p", F.when(F.col("rho").isNotNull(), t_p_col(t, F.col("n") - 2)))


def kendall(df: DataFrame, row: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two columns from the counts of value pairs."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    other = cells.toDF("x2", "y2", "n2")
    sign = F.signum(F.col("x") - F.col("x2")) * F.signum(F.col("y") - F.col("y2")) * F.col("n") * F.col("n2")
    s = cells.join(other, F.col("x") < F.col("x2")).agg(F.sum(sign).alias("s"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    total = cells.agg((F.sum("n") * (F.sum("n") - 1) / 2).alias("t"))
    tx = cells.groupBy("x").agg(F.sum("n").alias("k")).agg(pairs(F.col("k")).alias("tx"))
    ty = cells.groupBy("y").agg(F.sum("n").alias("k")).agg(pairs(F.col("k")).alias("ty"))
    one = s.join(total).join(tx).join(ty)
    return one.select(F.try_divide(F.col("s"), F.sqrt((F.col("t") - F.col("tx")) * (F.col("t") - F.col("ty")))).alias("tau"))


def covariance_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete covariances over the standard deviations of each column's own values (not those of the pair)."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*(F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.col(f"c{i}"), F.col(f"s_{a}") * F.col(f"s_{b}")).alias("rho")) for i, (a, b) in enumerate(pairs)))).alias("s")).select("s.*")


def partial_correlation(df: DataFrame, x: str, y: str, adjust_for: list[str], method: str = "pearson", min_n: int = 5) -> DataFrame:
    """(n, rho, p) of x and y given the covariates, from the inverse of their correlation matrix.

    The matrix comes from one aggregation; only its few numbers are inverted on the
    driver. Covariates without variance are left out; a constant x or y gives
    (0, 1), equal ones (1, 0), fewer than ``min_n`` rows (null, 1).
    """
    import numpy as np

    columns = [x, y, *adjust_for]
    rows = df.select(*columns).na.drop()
    if method == "spearman":
        rows = rows.select(*(mid_rank(c).alias(c) for c in columns))
    spread = rows.agg(F.count(F.lit(1)).alias("n"), *(F.stddev_samp(c).alias(c) for c in columns)).first()
    spark, n = df.sparkSession, spread["n"]
    columns = [c for c in columns if spread[c]]
    if n < min_n:
        return spark.createDataFrame([(n, None, 1.0)], "n long, rho double, p double")
    if x not in columns or y not in columns:
        return spark.createDataFrame([(n, 0.0, 1.0)], "n long, rho double, p double")
    got = rows.agg(*(F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j)).first()
    m = np.eye(len(columns))
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            m[i, j] = m[j, i] = got[f"{i}_{j}"]
    if m[0, 1] > 1 - 1e-12:
        return spark.createDataFrame([(n, 1.0, 0.0)], "n long, rho double, p double")
    inv = np.linalg.pinv(m)
    rho = float(-inv[0, 1] / np.sqrt(inv[0, 0] * inv[1, 1]))
    out = spark.createDataFrame([(n, rho)], "n long, rho double")
    dof = F.col("n") - 2 - (len(columns) - 2)
    return out.withColumn("p", t_p_col(F.col("rho") * F.sqrt(dof / (1 - F.col("rho") ** 2)), dof))


def correlation_distance(rho: Column, signed: bool = False) -> tuple[Column, Column]:
    """(similarity, distance): r squared, or keeping its sign; null is similarity 0 and distance 1."""
    sim = (rho * rho * F.signum(rho) + 1) / 2 if signed else rho * rho
    dist = (1 - rho) / 2 if signed else 1 - rho * rho
    return F.coalesce(sim, F.lit(0.0)), F.coalesce(dist, F.lit(1.0))


def mutual_information(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """(h_x, h_y, h_xy, mi, normalised 2 mi / (h_x + h_y)) in bits, from counts."""
    cells = df.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("n"))

    def entropy(keys: list[str], name: str) -> DataFrame:
        c = cells.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
        p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
        return c.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias(name))

    parts = [entropy([x], "h_x"), entropy([y], "h_y"), entropy([x, y], "h_xy")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(by)) if by else out.join(p)
    mi = F.col("h_x") + F.col("h_y") - F.col("h_xy")
    return out.withColumn("mi", mi).withColumn("normalised", 2 * mi / F.nullif(F.col("h_x") + F.col("h_y"), F.lit(0.0)))


def relations(df: DataFrame, row: str, columns: list[str], min_n: int = 10) -> DataFrame:
    """All pairs of values of two columns that occur together more than ``min_n`` times: 2x2 table, odds ratio, Fisher p, BH q.

    Zero cells count as 1. One self-join on the row gives every co-count.
    """
    items = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns))
    long = df.select(F.col(row).alias("row"), F.explode(items).alias("s")).select("row", "s.*").where("v IS NOT NULL")
    total = df.count()
    margin = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("m"))
    pairs = long.toDF("row", "c1", "v1").join(long.toDF("row", "c2", "v2"), "row").where("c1 < c2").groupBy("c1", "v1", "c2", "v2").agg(F.count(F.lit(1)).alias("a")).where(F.col("a") > min_n)
    t = pairs.join(margin.toDF("c1", "v1", "m1"), ["c1", "v1"]).join(margin.toDF("c2", "v2", "m2"), ["c2", "v2"])
    cell = lambda c: F.when(c == 0, F.lit(1)).otherwise(c)
    t = t.select("c1", "v1", "c2", "v2", "a", cell(F.col("m1") - F.col("a")).alias("b"), cell(F.col("m2") - F.col("a")).alias("c"), cell(F.lit(total) - F.col("m1") - F.col("m2") + F.col("a")).alias("d"))
    t = t.withColumn("odds_ratio", F.col("a") * F.col("d") / (F.col("b") * F.col("c"))).withColumn("p", fisher_exact("a", "b", "c", "d"))
    return adjust(t, "p", "fdr_bh")


# --- classification tables and curves


def confusion(df: DataFrame, predicted: Column, observed: Column, by: list[str] = ()) -> DataFrame:
    """a true positives, b false positives, c false negatives, d true negatives."""
    d = df.withColumn("_p", predicted).withColumn("_o", observed).where("_p IS NOT NULL AND _o IS NOT NULL")
    return d.groupBy(*by).agg(F.count_if(F.expr("_p AND _o")).alias("a"), F.count_if(F.expr("_p AND NOT _o")).alias("b"), F.count_if(F.expr("NOT _p AND _o")).alias("c"), F.count_if(F.expr("NOT _p AND NOT _o")).alias("d"))


def confusion_stats(df: DataFrame) -> DataFrame:
    """Sensitivity, specificity, predictive values, accuracy, ratios and prevalences of (a, b, c, d); a zero denominator is null."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    r = lambda x, y: F.try_divide(x, y)
    ppv, other = r(a, a + b), r(c, c + d)
    return df.withColumns({
        "n": n, "sens": r(a, a + c), "spec": r(d, b + d), "ppv": ppv, "npv": r(d, c + d), "nnt": r(F.lit(1.0), ppv - other), "acc": r(a + d, n),
        "rr": r(ppv, other), "odds": r(a * d, b * c), "prev_obs": r(a + c, n), "prev_pred": r(a + b, n), "rr_corrected": ((a + 0.5) / (a + b + 1)) / ((c + 0.5) / (c + d + 1)),
    })


def roc_points(df: DataFrame, score: str, observed: Column, by: list[str] = ()) -> DataFrame:
    """Every distinct score as a threshold (predicted if score >= it): counts pre-aggregated by score, then one running sum."""
    cells = df.withColumn("_o", observed).where(F.col(score).isNotNull() & F.col("_o").isNotNull()).groupBy(*by, score).agg(F.count_if(F.col("_o")).alias("p"), F.count_if(~F.col("_o")).alias("q"))
    w = Window.partitionBy(*by)
    run = w.orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = cells.withColumn("tp", F.sum("p").over(run)).withColumn("fp", F.sum("q").over(run)).withColumn("np", F.sum("p").over(w)).withColumn("nq", F.sum("q").over(w))
    return out.select(*by, F.col(score).alias("threshold"), "tp", "fp", (F.col("np") - F.col("tp")).alias("fn"), (F.col("nq") - F.col("fp")).alias("tn"), F.try_divide("tp", "np").alias("tpr"), F.try_divide("fp", "nq").alias("fpr"))


def roc_points_with_interval(df: DataFrame, score: str, observed: Column, alpha: float = 0.05) -> DataFrame:
    out = roc_points(df, score, observed)
    lo, hi = wilson(F.col("tp"), F.col("tp") + F.col("fn"), alpha)
    flo, fhi = wilson(F.col("fp"), F.col("fp") + F.col("tn"), alpha)
    return out.withColumns({"tpr_lo": lo, "tpr_hi": hi, "fpr_lo": flo, "fpr_hi": fhi})


def roc_thresholds(df: DataFrame, score: str, observed: Column, n: int = 50) -> DataFrame:
    """Confusion counts at n - 1 evenly spaced thresholds: each score's bin is computed, never a join with thresholds."""
    edge = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    step = (edge["hi"] - edge["lo"]) / n if edge["hi"] is not None else 1.0
    k = F.least(F.lit(n - 1), F.floor((F.col(score) - edge["lo"]) / step).cast("int"))
    cells = df.withColumn("_o", observed).where(F.col("_o").isNotNull() & F.col(score).isNotNull()).groupBy(k.alias("k")).agg(F.count_if("_o").alias("p"), F.count_if(~F.col("_o")).alias("q"))
    grid = df.sparkSession.range(0, n).select(F.col("id").cast("int").alias("k")).join(cells, "k", "left").na.fill(0)
    run = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    out = grid.withColumn("a", F.sum("p").over(run)).withColumn("b", F.sum("q").over(run)).withColumn("c", F.sum("p").over(whole) - F.col("a")).withColumn("d", F.sum("q").over(whole) - F.col("b"))
    return out.where("k > 0").select((F.lit(edge["lo"]) + F.col("k") * step).alias("threshold"), "a", "b", "c", "d")


def auc(df: DataFrame, score: str, observed: Column, by: list[str] = ()) -> DataFrame:
    """Area under the curve with ties counted half (Mann and Whitney), its DeLong variance and the counts.

    Scores are pre-aggregated; the structural components follow from running sums.
    """
    cells = df.withColumn("_o", observed).where(F.col(score).isNotNull() & F.col("_o").isNotNull()).groupBy(*by, score).agg(F.count_if(F.col("_o")).alias("p"), F.count_if(~F.col("_o")).alias("q"))
    w = Window.partitionBy(*by)
    run = w.orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    c = cells.withColumn("np", F.sum("p").over(w)).withColumn("nq", F.sum("q").over(w))
    c = c.withColumn("below", F.sum("q").over(run) - F.col("q") / 2).withColumn("above", F.col("np") - F.sum("p").over(run) + F.col("p") / 2)
    v10, v01 = F.try_divide("below", "nq"), F.try_divide("above", "np")
    s = c.groupBy(*by).agg(
        F.sum(F.col("p") * v10).alias("s10"), F.sum(F.col("p") * v10 * v10).alias("q10"), F.sum(F.col("q") * v01).alias("s01"), F.sum(F.col("q") * v01 * v01).alias("q01"), F.first("np").alias("n_pos"), F.first("nq").alias("n_neg")
    )
    var = lambda q, t, n: F.try_divide(F.try_divide(F.col(q) - F.try_divide(F.col(t) ** 2, F.col(n)), F.col(n) - 1), F.col(n))
    return s.select(*by, "n_pos", "n_neg", F.try_divide("s10", "n_pos").alias("auc"), (var("q10", "s10", "n_pos") + var("q01", "s01", "n_neg")).alias("variance"))


def auc_interval(areas: DataFrame, alpha: float = 0.05) -> DataFrame:
    half = z_value(alpha) * F.sqrt("variance")
    return areas.withColumns({"lo": F.greatest(F.lit(0.0), F.col("auc") - half), "hi": F.least(F.lit(1.0), F.col("auc") + half)})


def delong_test(df: DataFrame, row: str, score_a: str, score_b: str, observed: Column) -> DataFrame:
    """Difference of two paired AUCs with its DeLong z and two-sided p.

    A row's component is its place among the rows of the other outcome: running counts of the distinct scores, by ranges of them.
    """
    d = df.withColumn("_o", observed).where(F.col("_o").isNotNull() & F.col(score_a).isNotNull() & F.col(score_b).isNotNull())
    cells = stage(d.groupBy("_o", F.col(score_a).alias("_x"), F.col(score_b).alias("_y")).agg(F.count(F.lit(1)).alias("_n")))
    size = cells.agg(F.sum(F.when(F.col("_o"), F.col("_n"))).alias("_np"), F.sum(F.when(~F.col("_o"), F.col("_n"))).alias("_nq"))  # one row

    def component(score: str, name: str) -> DataFrame:
        n = cells.groupBy(score).agg(F.sum(F.when(F.col("_o"), F.col("_n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("_o"), F.col("_n")).otherwise(0)).alias("q"))
        at = running(range_parts(n, score), [], [score], ["p", "q"]).join(F.broadcast(size))
        return at.select(score, ((F.col("run_q") - F.col("q") / 2) / F.col("_nq")).alias(f"{name}1"), (1 - (F.col("run_p") - F.col("p") / 2) / F.col("_np")).alias(f"{name}0"))

    r = cells.join(component("_x", "a"), "_x").join(component("_y", "b"), "_y")
    r = r.select("_o", "_n", *(F.when(F.col("_o"), F.col(f"{s}1")).otherwise(F.col(f"{s}0")).alias(f"v{s}") for s in "ab"))
    sums = r.withColumn("_d", F.col("va") - F.col("vb")).groupBy("_o").agg(F.sum("_n").alias("_m"), *((F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(m) for c, m in (("va", "ma"), ("vb", "mb"), ("_d", "md"))))
    off = r.join(F.broadcast(sums), "_o").withColumn("_e", F.col("va") - F.col("vb") - F.col("md"))  # two rows
    v = off.groupBy("_o", "_m", "ma", "mb").agg(F.try_divide(F.sum(F.col("_n") * F.col("_e") * F.col("_e")), (F.col("_m") - 1) * F.col("_m")).alias("v"))
    s = v.agg(F.max(F.when(F.col("_o"), F.col("ma"))).alias("auc_a"), F.max(F.when(F.col("_o"), F.col("mb"))).alias("auc_b"), F.sum("v").alias("variance"))
    s = s.withColumn("z", F.try_divide(F.col("auc_a") - F.col("auc_b"), F.sqrt("variance")))
    return s.withColumn("p", 2 * normal_cdf_col(-F.abs("z")))


def confusion_from_rates(sens: Column, spec: Column, prevalence: Column, n: float) -> dict[str, Column]:
    """The table of n rows with these rates."""
    pos, neg = prevalence * n, (1 - prevalence) * n
    return {"a": sens * pos, "b": (1 - spec) * neg, "c": (1 - sens) * pos, "d": spec * neg}
