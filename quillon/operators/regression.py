"""Likelihood fits by damped Newton steps over Spark aggregates (SV4, RO18, RO19, RS6).

``grouped_newton`` fits every group of a table at once: a step is one aggregation of each
group's log-likelihood, score and information, and numpy solves the small systems in Arrow
batches of groups. A group whose likelihood fell has its step halved; one that does not settle says so.
Cox's likelihood needs sums over risk sets, which are running sums over ranges of time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.distributions import NORMAL, normal_cdf_col, t_p_col
from quillon.operators.prefix import PART, range_parts, running
from quillon.operators.resampling import poisson_one, uniform
from quillon.session import discard, shuffle_partitions, stage

#: Half of Newton's decrement below which a likelihood is at its peak, and the step (in standard errors) below which its place is.
PEAK, STILL = 1e-14, 1e-5


#: Rows times replicates whose scores one task counts.
SCORES = 1_000_000


class NotConverged(RuntimeError):
    """A likelihood has no peak within the steps allowed: it still rises, or its peak is at infinity."""


# --- special functions as Columns


def log_gamma(x: Column) -> Column:
    """ln of the gamma function, x > 0: Stirling's series at x + 8, shifted back by the product."""
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    inv = 1 / y
    series = inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv * (1 / 1260 - inv * inv * (1 / 1680 - inv * inv / 1188))))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def digamma(x: Column) -> Column:
    """The derivative of log_gamma, x > 0."""
    y = x + 8
    shift = sum((1 / (x + k) for k in range(8)), F.lit(0.0))
    i2 = 1 / (y * y)
    return F.log(y) - 0.5 / y - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132)))) - shift


def trigamma(x: Column) -> Column:
    """The derivative of digamma, x > 0."""
    y = x + 8
    shift = sum((1 / ((x + k) * (x + k)) for k in range(8)), F.lit(0.0))
    i, i2 = 1 / y, 1 / (y * y)
    return i + i2 / 2 + i * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 * (1 / 30 - i2 * 5 / 66)))) + shift


# --- all groups at once


def _newton(state: list, ll: float, score: np.ndarray, info: np.ndarray, tol: float) -> list:
    """[b, base, base_ll, step, cov, ll, steps, done] after one evaluation at b."""
    b, base, base_ll, step, cov, _, steps, _ = state
    p = len(b)
    if not (np.isfinite(ll) and np.isfinite(score).all() and np.isfinite(info).all()) or ll < base_ll - 1e-9 * (1 + abs(base_ll)):
        if not np.isfinite(base_ll) or np.abs(step).max(initial=0) < 1e-8:
            return [base, base, base_ll, step, cov, base_ll, steps + 1, "stuck"]
        step = step / 2
        return [base + step, base, base_ll, step, cov, base_ll, steps + 1, ""]
    scale = np.sqrt(np.maximum(np.diag(info), 1e-150))
    scaled = info / np.outer(scale, scale)
    values, axes = np.linalg.eigh((scaled + scaled.T) / 2)
    peaked = values.min() > 1e-10
    values = np.maximum(np.abs(values), 1e-6 * max(np.abs(values).max(), 1e-6))
    inverse = (axes / values) @ axes.T / np.outer(scale, scale)
    move = inverse @ score
    errors = np.sqrt(np.maximum(np.diag(inverse), 1e-300))
    gain = 0.5 * float(score @ move)
    flat, still = gain < tol, (np.abs(move) / errors).max(initial=0) < STILL
    # An infinite peak: the likelihood hardly rises, yet moves do not shrink as they do before a peak.
    endless = 1e-18 < gain < 1e-6 and np.abs(move).max() > 0.3 * np.abs(step).max(initial=0) > 0
    cov = inverse.ravel() if peaked else np.full(p * p, np.nan)
    if flat and still and not endless:
        return [b, b, ll, np.zeros(p), cov, ll, steps + 1, "yes" if peaked else "flat"]
    if endless:
        return [b, b, ll, move, cov, ll, steps + 1, "infinite"]
    move = move / max(1.0, np.abs(move).max() / max(5.0, np.abs(b).max()))
    return [b + move, b, ll, move, cov, ll, steps + 1, ""]


def grouped_newton(rows: DataFrame, keys: list[str], start: Column, likelihood: Callable[[Column], tuple[list[dict[str, Column]], Column, list[Column], list[list[Column]]]], size: int, steps: int = 60, tol: float = PEAK, least: dict[int, float] | None = None, given: list[str] | None = None) -> DataFrame:
    """(keys, b, cov, ll, steps, state) of the maximum-likelihood fit of each group of ``rows``.

    ``likelihood`` maps a Column of ``size`` coefficients to layers of columns to add, one projection each, and by them a row's log-likelihood, its
    gradient and the lower triangle of its negative Hessian (or expected information). ``start`` is an aggregate of a group, an array. ``state`` is ``yes`` for a peak; ``infinite``
    where coefficients run away, ``flat`` where they are not determined, ``stuck`` where no step helps and ``steps`` where none was reached
    in time; those groups' b is where they stopped. With ``given``, ``likelihood`` is a numpy function of an Arrow batch: by the columns ``given`` (a dict) and the
    rows' coefficients (a matrix) it returns a row's log-likelihood, gradient and triangle side by side; a batch is summed by group before it is shuffled. A coefficient that falls below its ``least`` is taken to run away. Groups that have settled are not evaluated again.
    """
    kinds = dict(rows.dtypes)
    key_kinds = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    tri = [(i, j) for i in range(size) for j in range(i + 1)]
    fields = "b array<double>, base array<double>, base_ll double, step array<double>, cov array<double>, ll double, steps int, state string"

    lists, names = ("b", "base", "step", "cov"), ("b", "base", "base_ll", "step", "cov", "ll", "steps", "state")

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not r["state"]:
                    at = [np.array(r[n], float) if n in lists else r[n] for n in names]
                    info = np.full((size, size), np.nan)
                    for (i, j), v in zip(tri, r["_h"] or ()):
                        info[i, j] = info[j, i] = np.nan if v is None else v
                    score = np.array([np.nan if v is None else v for v in r["_g"] or [None] * size], float)
                    new = _newton(at, np.nan if r["_l"] is None else r["_l"], score, info, tol)
                    gone = any(new[0][k] < v for k, v in (least or {}).items())
                    new[7] = "infinite" if gone else new[7] or ("steps" if new[6] >= steps else "")
                    r |= {n: v.tolist() if n in lists else v for n, v in zip(names, new)}
                out.append({k: r[k] for k in (*keys, *names)})
            if out:
                schema = pa.schema([batch.schema.field(k) for k in (*keys, *names)])
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    if given is None:
        layers, ll, grad, hess = likelihood(F.col("_b"))
    sum_names = ["_l", *(f"_g{k}" for k in range(size)), *(f"_h{k}" for k in range(len(tri)))]

    def batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in (*keys, *given, "_b")}
            b = at["_b"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            with np.errstate(all="ignore"):
                v = likelihood({c: at[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in given}, b)
            table = pa.table({**{f"k_{k}": at[k] for k in keys}, **{n: pa.array(x) for n, x in zip(sum_names, v.T)}})
            sums = table.group_by([f"k_{k}" for k in keys], use_threads=False).aggregate([(n, "sum") for n in sum_names])
            out = pa.table({**{k: sums[f"k_{k}"] for k in keys}, **{n: sums[f"{n}_sum"] for n in sum_names}})
            yield from out.combine_chunks().to_batches()

    empty = F.array().cast("array<double>")
    never = F.lit(float("-inf"))
    state = stage(rows.groupBy(*keys).agg(start.alias("b")).select(*keys, "b", F.col("b").alias("base"), never.alias("base_ll"), empty.alias("step"), empty.alias("cov"), never.alias("ll"), F.lit(0).alias("steps"), F.lit("").alias("state")))
    while state.where("state = ''").limit(1).count():
        at = state.where("state = ''").select(*keys, F.col("b").alias("_b"))
        at_rows = rows.join(at, keys) if keys else rows.join(F.broadcast(at))
        if given is None:
            for layer in layers:
                at_rows = at_rows.withColumns(layer)
            each = {f"_g{k}": g for k, g in enumerate(grad)} | {f"_h{k}": hess[i][j] for k, (i, j) in enumerate(tri)}
            parts = at_rows.select(*keys, ll.alias("_l"), *(v.alias(n) for n, v in each.items()))
        else:
            parts = at_rows.select(*keys, *given, "_b").mapInArrow(batch_sums, f"{key_kinds}{', ' if keys else ''}{', '.join(n + ' double' for n in sum_names)}")
        sums = parts.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in sum_names))
        sums = sums.select(*keys, "_l", F.array(*(f"_g{k}" for k in range(size))).alias("_g"), F.array(*(f"_h{k}" for k in range(len(tri)))).alias("_h"))
        new = stage((state.join(sums, keys, "left") if keys else state.join(F.broadcast(sums))).mapInArrow(advance, f"{key_kinds}{', ' if keys else ''}{fields}"))
        discard(state)
        state = new
    return state.select(*keys, "b", "cov", "ll", "steps", "state")


def settled(fits: DataFrame) -> DataFrame:
    """``fits`` of grouped_newton(), if all have a peak; else raises."""
    bad = fits.where("state <> 'yes'").limit(3).collect()
    if bad:
        raise NotConverged(f"no peak of the likelihood: {[r.asDict() for r in bad]}")
    return fits


def coefficients(fits: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """(keys, term, coefficient, error, state); null numbers where there is no peak."""
    p = len(terms)
    each = F.posexplode(F.array(*map(F.lit, terms))).alias("_k", "term")
    rows = fits.select(*keys, "b", "cov", "state", each)
    good = F.col("state").isin("yes", "binomial")
    return rows.select(*keys, "term", F.when(good, F.col("b")[F.col("_k")]).alias("coefficient"), F.when(good, F.sqrt(F.col("cov")[F.col("_k") * (p + 1)])).alias("error"), "state")


def logistic(features: list[str], outcome: str, weight: Column | None = None, offset: Column | None = None, l2: float = 0.0) -> Callable:
    """The likelihood of a logistic regression, intercept first. ``l2`` is a ridge for each row of the other coefficients."""
    w = weight if weight is not None else F.lit(1.0)

    def at(b: Column):
        x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
        eta = sum((b[k] * x[k] for k in range(len(x))), offset if offset is not None else F.lit(0.0))
        layers = [{"_eta": eta}, {"_e": F.exp(-F.abs("_eta"))}, {"_p": F.when(F.col("_eta") > 0, 1 / (1 + F.col("_e"))).otherwise(F.col("_e") / (1 + F.col("_e")))}]
        y, p = F.col(outcome).cast("double"), F.col("_p")
        soft = F.greatest("_eta", F.lit(0.0)) + F.log1p("_e")
        ridge = [0.0] + [l2] * len(features)
        ll = w * (y * F.col("_eta") - soft) - sum((r / 2 * b[k] * b[k] for k, r in enumerate(ridge) if r), F.lit(0.0))
        grad = [w * (y - p) * x[k] - (ridge[k] * b[k] if ridge[k] else F.lit(0.0)) for k in range(len(x))]
        hess = [[w * p * (1 - p) * x[i] * x[j] + (ridge[i] if i == j else 0.0) for j in range(i + 1)] for i in range(len(x))]
        return layers, ll, grad, hess

    return at


def logistic_fits(df: DataFrame, keys: list[str], outcome: str, features: list[str], weight: Column | None = None, offset: Column | None = None) -> DataFrame:
    """A logistic regression in each group, over complete rows; see grouped_newton() for the columns."""
    rows = df.na.drop(subset=[outcome, *features])
    start = F.array(*[F.lit(0.0)] * (len(features) + 1))
    return grouped_newton(rows, keys, F.first(start), logistic(features, outcome, weight, offset), len(features) + 1)


def penalised_fits(rows: DataFrame, outcome: str, features: list[str], models: list[dict], steps: int = 100) -> np.ndarray:
    """Coefficients (a row for each model, intercept first) of logistic fits with penalties, of rows whose ``fold`` is not the model's ``held``.

    A model has ``held``, ``l1`` and ``l2`` (of the whole likelihood, not of a row), the features it uses (``use``, numbers) and what they are centred and divided by (``mean``,
    ``sd``); others have coefficients of 0. A step is one aggregation for all models that have not settled, and the driver sees a row of sums for
    each: Newton's step, or with ``l1`` that of the penalised square by coordinates, halved where the likelihood falls. Models without a peak stop after ``steps``.
    """
    p, spark = len(features) + 1, rows.sparkSession
    tri = [(i, j) for i in range(p) for j in range(i + 1)]
    beta, live = np.zeros((len(models), p)), list(range(len(models)))
    base, worth, moves = beta.copy(), np.full(len(models), np.inf), np.zeros_like(beta)
    z = [F.lit(1.0), *((F.col(c).cast("double") - F.get("_mean", F.lit(k))) / F.get("_sd", F.lit(k)) for k, c in enumerate(features))]
    y, w = F.col(outcome).cast("double"), F.col("_p") * (1 - F.col("_p"))
    for _ in range(steps):
        if not live:
            break
        known = [(m, models[m]["held"], *([float(v) for v in a] for a in (models[m]["mean"], models[m]["sd"], beta[m]))) for m in live]
        table = spark.createDataFrame(known, "_m int, _held int, _mean array<double>, _sd array<double>, _b array<double>")
        at = rows.join(F.broadcast(table), F.col("fold") != F.col("_held")).select("_m", y.alias("_y"), "_b", *(v.alias(f"_z{k}") for k, v in enumerate(z)))
        at = at.withColumn("_eta", sum((F.get("_b", F.lit(k)) * F.col(f"_z{k}") for k in range(p)), F.lit(0.0))).withColumn("_p", 1 / (1 + F.exp(-F.greatest(F.least("_eta", F.lit(30.0)), F.lit(-30.0)))))
        like = F.col("_y") * F.col("_eta") - F.greatest("_eta", F.lit(0.0)) - F.log1p(F.exp(-F.abs("_eta")))
        sums = {r["_m"]: r for r in at.groupBy("_m").agg(F.sum(like).alias("l"), *(F.sum((F.col("_y") - F.col("_p")) * F.col(f"_z{k}")).alias(f"g{k}") for k in range(p)), *(F.sum(w * F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"h{i}_{j}") for i, j in tri)).collect()}
        for m in list(live):
            if m not in sums:
                live.remove(m)
                continue
            l1, l2, use = models[m]["l1"], models[m]["l2"], [0, *(k + 1 for k in models[m]["use"])]
            b = beta[m, use]
            info = np.zeros((p, p))
            for i, j in tri:
                info[i, j] = info[j, i] = sums[m][f"h{i}_{j}"]
            ridge = np.array([0.0] + [l2] * (len(use) - 1))
            info = info[np.ix_(use, use)] + np.diag(ridge) + 1e-10 * np.eye(len(use))
            score = np.array([sums[m][f"g{k}"] for k in use]) - ridge * b
            if not l1:
                move = np.linalg.solve(info, score)
                beta[m, use] = b + move / max(1.0, np.max(np.abs(move)) / 5)
            else:
                cost = l1 * np.abs(b[1:]).sum() + (ridge * b * b).sum() / 2 - sums[m]["l"]
                if cost > worth[m] + 1e-12 * abs(worth[m]) and np.abs(moves[m]).max() > 1e-9:
                    moves[m] /= 2
                    beta[m] = base[m] + moves[m]
                    continue
                move = _lasso_step(info, score, b, l1) - b
                base[m], worth[m] = beta[m], cost
                moves[m, use] = move / max(1.0, np.max(np.abs(move)) / 5)
                beta[m] = base[m] + moves[m]
            if np.max(np.abs(move)) < 1e-9:
                live.remove(m)
    return beta


def _lasso_step(info: np.ndarray, score: np.ndarray, b: np.ndarray, l1: float) -> np.ndarray:
    """Where the square about ``b`` with the penalty ``l1`` of all but the first is least."""
    z = b.copy()
    for _ in range(10_000):
        before = z.copy()
        for k in range(len(z)):
            pull = score[k] - info[k] @ (z - b) + info[k, k] * z[k]
            z[k] = pull / info[k, k] if k == 0 else np.sign(pull) * max(abs(pull) - l1, 0) / info[k, k]
        if np.max(np.abs(z - before)) < 1e-13 * (1 + np.max(np.abs(z))):
            break
    return z


# --- optimism (RS6)


def optimism_bootstrap(df: DataFrame, row: str, outcome: str, features: list[str], n: int = 100, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(apparent, optimism, estimate, median, lo, hi, used): the area under the curve of a logistic fit, less its optimism.

    Replicates have Poisson(1) weights from hashes and are refitted at once. With C_b a replicate's area over its own rows
    and O_b its area over all, ``optimism`` is the mean of C_b - O_b, ``estimate`` is apparent less that; median and
    limits are of apparent - (C_b - O_b), limits by linear interpolation. A replicate whose fit has no peak, or in which
    an outcome is absent, is left out of ``used``; incomplete rows are left out of all.
    """
    rows = stage(df.select(F.col(row).alias("_row"), F.col(outcome).cast("double").alias("_y"), *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features))).na.drop())
    x = [f"_x{k}" for k in range(len(features))]
    weigh = lambda df: df.withColumn("replicate", F.explode(F.sequence(F.lit(-1), F.lit(n - 1)))).withColumn("_w", F.when(F.col("replicate") < 0, 1).otherwise(poisson_one(uniform("_row", "replicate", F.lit(seed)))))
    fits = logistic_fits(weigh(rows).where("_w > 0"), ["replicate"], "_y", x, F.col("_w").cast("double")).where("state = 'yes'")
    # A task counts the scores of at most some SCORES rows and replicates, however few files the rows are in.
    parts = max(shuffle_partitions(df.sparkSession), -(-rows.count() * (n + 1) // SCORES))
    every = weigh(rows.repartition(parts, "_row"))
    eta = sum((F.col("b")[k + 1] * F.col(c) for k, c in enumerate(x)), F.col("b")[0])
    scored = every.join(F.broadcast(fits.select("replicate", "b")), "replicate").select("replicate", eta.alias("score"), "_y", "_w")  # n + 1 rows
    # Ranges of the score: logistic units a sixteenth wide.
    cells = scored.groupBy("replicate", "score", F.floor(F.least(F.greatest(F.col("score") * 16, F.lit(-4000.0)), F.lit(4000.0))).cast("int").alias(PART)).agg(
        F.sum(F.col("_w") * F.col("_y")).alias("p"), F.sum(F.col("_w") * (1 - F.col("_y"))).alias("q"), F.sum("_y").alias("p0"), F.sum(1 - F.col("_y")).alias("q0")
    )
    run = running(stage(cells), ["replicate"], ["score"], ["q", "q0"])
    area = lambda p, q: F.sum(F.col(p) * (F.col(f"run_{q}") - F.col(q) / 2)) / F.nullif(F.sum(p) * F.sum(q), F.lit(0.0))
    each = run.groupBy("replicate").agg(area("p", "q").alias("boot"), area("p0", "q0").alias("orig"))
    found = {r["replicate"]: (r["boot"], r["orig"]) for r in each.collect() if r["boot"] is not None}  # n + 1 rows
    if -1 not in found:
        raise NotConverged("the fit of all rows has no peak, or an outcome is absent")
    apparent = found.pop(-1)[1]
    gain = np.array([b - o for b, o in found.values()])
    lo, mid, hi = np.percentile(apparent - gain, [100 * alpha / 2, 50, 100 * (1 - alpha / 2)]) if len(gain) else (None, None, None)
    mean = float(gain.mean()) if len(gain) else None
    values = (apparent, mean, None if mean is None else apparent - mean, *(None if v is None else float(v) for v in (mid, lo, hi)), len(gain))
    return df.sparkSession.createDataFrame([values], "apparent double, optimism double, estimate double, median double, lo double, hi double, used int")


# --- beta-binomial (RO18)


#: Counts up to which differences of gamma functions are sums of as many terms.
TERMS = 32


def _gammas(x: np.ndarray) -> np.ndarray:
    """log_gamma(), digamma() and trigamma() of an array."""
    y, k = x + 8, np.arange(8)[:, None]
    i, i2 = 1 / y, 1 / (y * y)
    terms = 1 / (x + k)
    first = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188)))) - np.log(x + k).sum(0)
    second = np.log(y) - 0.5 * i - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132)))) - terms.sum(0)
    third = i + i2 / 2 + i * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 * (1 / 30 - i2 * 5 / 66)))) + (terms * terms).sum(0)
    return np.stack([first, second, third])


def _rises(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What log_gamma(), digamma() and trigamma() rise by from x to x + n: for small whole n a sum without cancellation."""
    out = np.zeros((3, len(x)))
    few = (n >= 0) & (n <= TERMS) & (n == np.floor(n))
    for k in range(int(n[few].max(initial=0))):
        at = x + k
        more = few & (n > k)
        out[0] += np.where(more, np.log(at), 0.0)
        at = np.where(more, 1 / at, 0.0)
        out[1] += at
        out[2] -= at * at
    rest = ~few
    if rest.any():
        out[:, rest] = np.where(n[rest] >= 0, _gammas(x[rest] + n[rest]) - _gammas(x[rest]), np.nan)
    return out


def beta_binomial(df: DataFrame, keys: list[str], count: str, total: str, features: list[str]) -> DataFrame:
    """Beta-binomial regression of each group: logit of the mean on the features, and one logit of the dispersion (last coefficient).

    With mean m and dispersion f, counts are binomial of a Beta(m (1 - f) / f, (1 - m) (1 - f) / f) share. Rows with a null, or a total of 0, say nothing. Where
    counts vary no more than binomial ones the dispersion's logit runs to minus infinity: then ``state`` is ``binomial``, the means are the binomial fit's and the dispersion is null. ``n`` is a group's rows.
    A step is one pass of numpy over Arrow batches, whose sums by group are all that is shuffled.
    """
    rows = df.na.drop(subset=[count, total, *features]).where(F.col(total) > 0)
    number = lambda c: F.col(c).cast("double")
    rows = stage(rows.select(*keys, number(count).alias("_y"), number(total).alias("_m"), *(number(c).alias(f"_x{k}") for k, c in enumerate(features))))  # each step reads them
    p = len(features) + 1
    columns = ["_y", "_m", *(f"_x{k}" for k in range(p - 1))]

    def at(given: dict[str, np.ndarray], b: np.ndarray) -> np.ndarray:
        y, m = given["_y"], given["_m"]
        x = np.stack([np.ones(len(y)), *(given[f"_x{k}"] for k in range(p - 1))])
        mu, s = 1 / (1 + np.exp(-(b[:, :p].T * x).sum(0))), np.exp(-b[:, p])  # s = (1 - f) / f
        a1, a2, z = mu * s, (1 - mu) * s, m - y
        (l1, d1, t1), (l2, d2, t2), (l0, d0, t0) = _rises(a1, y), _rises(a2, z), _rises(s, m)
        one = np.ones(len(y))
        choose = _rises(one, m)[0] - _rises(one, y)[0] - _rises(one, z)[0]
        gm, gs = s * (d1 - d2), mu * d1 + (1 - mu) * d2 - d0
        hm, hx = s * s * (t1 + t2), (d1 - d2) + s * (mu * t1 - (1 - mu) * t2)
        hs = mu * mu * t1 + (1 - mu) ** 2 * t2 - t0
        dm = mu * (1 - mu)  # d mu / d eta
        # second derivatives in eta and in the dispersion's logit, of which s is exp(-.)
        he, hc, hf = hm * dm * dm + gm * dm * (1 - 2 * mu), -hx * dm * s, hs * s * s + gs * s
        second = [-he * x[i] * x[j] for i in range(p) for j in range(i + 1)] + [-hc * x[j] for j in range(p)] + [-hf]
        return np.stack([choose + l1 + l2 - l0, *(gm * dm * x[k] for k in range(p)), -gs * s, *second], 1)

    share = (F.sum("_y") + 0.5) / (F.sum("_m") + 1)
    start = F.array(F.log(share / (1 - share)), *[F.lit(0.0)] * len(features), F.lit(-2.0))
    fits = grouped_newton(rows, keys, start, at, p + 1, least={p: -12.0}, given=columns)  # below, the counts are binomial but for rounding
    gone = stage(fits.where("state = 'infinite'").select(*keys))
    if gone.count():
        # what is left of the likelihood is the binomial one of the means
        def binomial(given: dict[str, np.ndarray], b: np.ndarray) -> np.ndarray:
            y, m = given["_y"], given["_m"]
            x = np.stack([np.ones(len(y)), *(given[f"_x{k}"] for k in range(p - 1))])
            eta = (b.T * x).sum(0)
            mu, one = 1 / (1 + np.exp(-eta)), np.ones(len(y))
            choose = _rises(one, m)[0] - _rises(one, y)[0] - _rises(one, m - y)[0]
            second = [m * mu * (1 - mu) * x[i] * x[j] for i in range(p) for j in range(i + 1)]
            return np.stack([choose + y * eta - m * np.logaddexp(0.0, eta), *((y - m * mu) * x), *second], 1)

        rest = rows.join(F.broadcast(gone), keys, "left_semi") if keys else rows
        plain = grouped_newton(rest, keys, F.slice(start, 1, p), binomial, p, given=columns).where("state = 'yes'")
        none = F.lit(None).cast("double")
        wide = F.concat(*(F.concat(F.slice("cov", k * p + 1, p), F.array(none)) for k in range(p)), F.array_repeat(none, p + 1))
        plain = stage(plain.select(*keys, F.concat("b", F.array(none)).alias("b"), wide.alias("cov"), "ll", "steps", F.lit("binomial").alias("state")))
        fits = (fits.join(F.broadcast(plain.select(*keys)), keys, "left_anti") if keys else fits.crossJoin(plain.agg(F.count(F.lit(1)).alias("_n"))).where("_n = 0").drop("_n")).unionByName(plain)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return fits.join(F.broadcast(sizes), keys) if keys else fits.join(F.broadcast(sizes))


def wald_tests(fits: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """coefficients() of fits with their rows ``n``, with ``t`` and its two-sided ``p`` of Student's t with n less the terms degrees of freedom."""
    out = coefficients(fits, keys, terms).join(F.broadcast(fits.select(*keys, "n")), keys)
    t = F.col("coefficient") / F.nullif("error", F.lit(0.0))
    freedom = F.col("n") - len(terms)
    out = out.withColumn("t", t).withColumn("p", t_p_col(F.col("t"), F.when(freedom > 0, freedom)))
    return out.select(*keys, "term", "coefficient", "error", "t", "p", "state")


# --- Cox (SV4, RO19)


def _cox_rows(df: DataFrame, time: str, event: Column, features: list[str], weight: Column | None, stratum: str | None, cluster: str | None) -> DataFrame:
    kept = df.select(
        F.col(time).cast("double").alias("time"), F.coalesce(event.cast("int"), F.lit(0)).alias("e"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"),
        (F.col(stratum) if stratum else F.lit(0)).alias("stratum"), (F.col(cluster) if cluster else F.monotonically_increasing_id()).alias("cluster"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)),
    )
    return kept.na.drop(subset=["time", "w", *(f"x{k}" for k in range(len(features)))]).where("w > 0")


def _risk(rows: DataFrame, beta: np.ndarray, centre: np.ndarray, p: int) -> DataFrame:
    """One row for each (stratum, time): sums over the risk set (run_s0, run_s1_k, run_s2_ij) and over the events at it."""
    b = rows.sparkSession.range(1).select(F.array(*(F.lit(float(v)) for v in beta)).alias("_b"))
    eta = sum(((F.col(f"x{k}") - float(centre[k])) * F.col("_b")[k] for k in range(p)), F.lit(0.0))
    r = F.col("w") * F.exp("_eta")
    x = lambda k: F.col(f"x{k}") - float(centre[k])
    tri = [(i, j) for i in range(p) for j in range(i + 1)]
    d = F.col("w") * F.col("e")
    sums = {"s0": r} | {f"s1_{k}": r * x(k) for k in range(p)} | {f"s2_{i}_{j}": r * x(i) * x(j) for i, j in tri}
    events = {"d": d, "d_eta": d * F.col("_eta")} | {f"dx_{k}": d * x(k) for k in range(p)}
    cells = rows.join(F.broadcast(b)).withColumn("_eta", eta).groupBy("stratum", PART, "time").agg(*(F.sum(v).alias(c) for c, v in (sums | events).items()))
    return running(cells, ["stratum"], ["time"], list(sums), descending=True)


def _cox_sums(rows: DataFrame, beta: np.ndarray, centre: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, score and information."""
    p = len(beta)
    tri = [(i, j) for i in range(p) for j in range(i + 1)]
    risk = _risk(rows, beta, centre, p).where("d > 0")
    mean = lambda k: F.col(f"run_s1_{k}") / F.col("run_s0")
    total = risk.agg(
        F.sum(F.col("d_eta") - F.col("d") * F.log("run_s0")).alias("ll"),
        *(F.sum(F.col(f"dx_{k}") - F.col("d") * mean(k)).alias(f"u{k}") for k in range(p)),
        *(F.sum(F.col("d") * (F.col(f"run_s2_{i}_{j}") / F.col("run_s0") - mean(i) * mean(j))).alias(f"i{i}_{j}") for i, j in tri),
    ).first()
    if total["ll"] is None:
        raise NotConverged("no events")
    info = np.zeros((p, p))
    for i, j in tri:
        info[i, j] = info[j, i] = total[f"i{i}_{j}"]
    return total["ll"], np.array([total[f"u{k}"] for k in range(p)]), info


def _cox_peak(rows: DataFrame, p: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(coefficients, inverse information, centre, log-likelihood); raises where there is no peak."""
    m = rows.agg(*(F.avg(f"x{k}").alias(f"x{k}") for k in range(p))).first()
    if m is None or m["x0"] is None:
        raise NotConverged("no complete rows")
    centre = np.array([m[f"x{k}"] for k in range(p)])
    state = [np.zeros(p), np.zeros(p), -np.inf, np.zeros(p), np.zeros(p * p), -np.inf, 0, ""]
    for _ in range(steps):
        state = _newton(state, *_cox_sums(rows, state[0], centre), PEAK)
        if state[7]:
            break
    if state[7] != "yes":
        raise NotConverged(f"Cox's likelihood has no peak: {state[7] or 'steps'} at {state[0]}")
    return state[0], state[4].reshape(p, p), centre, state[5]


def _score_residuals(rows: DataFrame, beta: np.ndarray, centre: np.ndarray) -> DataFrame:
    """``rows`` with u0, u1, ...: each row's own part of the score, of weight 1."""
    p = len(beta)
    risk = _risk(rows, beta, centre, p)
    mean = lambda k: F.col(f"run_s1_{k}") / F.col("run_s0")
    hazard = risk.select("stratum", PART, "time", (F.col("d") / F.col("run_s0")).alias("a"), *((F.col("d") / F.col("run_s0") * mean(k)).alias(f"b{k}") for k in range(p)), *(mean(k).alias(f"m{k}") for k in range(p)))
    upto = running(hazard, ["stratum"], ["time"], ["a", *(f"b{k}" for k in range(p))]).select("stratum", "time", "run_a", *(f"run_b{k}" for k in range(p)), *(f"m{k}" for k in range(p)))
    both = rows.join(upto.withColumnsRenamed({"stratum": "_s", "time": "_t"}), F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("time") == F.col("_t")))
    x = [F.col(f"x{k}") - float(centre[k]) for k in range(p)]
    relative = F.exp(sum((float(beta[k]) * x[k] for k in range(p)), F.lit(0.0)))
    return both.select(*rows.columns, *((F.col("e") * (x[k] - F.col(f"m{k}")) - relative * (x[k] * F.col("run_a") - F.col(f"run_b{k}"))).alias(f"u{k}") for k in range(p)))


def _products(df: DataFrame, names: list[str]) -> np.ndarray:
    tri = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    row = df.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in tri)).first()
    out = np.zeros((len(names), len(names)))
    for i, j in tri:
        out[i, j] = out[j, i] = row[f"m{i}_{j}"] or 0.0
    return out


def _table(spark, terms: list[str], beta: np.ndarray, cov: np.ndarray, robust: np.ndarray | None, alpha: float) -> DataFrame:
    z = NORMAL.inv_cdf(1 - alpha / 2)
    naive = np.sqrt(np.diag(cov))
    used = np.sqrt(np.diag(robust)) if robust is not None else naive
    rows = [(t, float(b), float(s), float(r)) for t, b, s, r in zip(terms, beta, naive, used)]
    out = spark.createDataFrame(rows, "term string, log_ratio double, naive_se double, se double")
    b, s = F.col("log_ratio"), F.col("se")
    return out.select("term", b, "naive_se", s, F.exp(b).alias("ratio"), F.exp(b - z * s).alias("lo"), F.exp(b + z * s).alias("hi"), (2 * normal_cdf_col(-F.abs(b / s))).alias("p"))


def cox_regression(df: DataFrame, time: str, event: Column, features: list[str], weight: Column | None = None, stratum: str | None = None, cluster: str | None = None, robust: bool = False, alpha: float = 0.05, steps: int = 60) -> DataFrame:
    """(term, log_ratio, naive_se, se, ratio, lo, hi, p) by Cox's partial likelihood (Breslow's ties).

    ``robust``: sandwich errors, of sums of score residuals by ``cluster`` if one is named. Strata have baselines of their own. Rows with a null time, weight
    or feature are left out, a null event is none. Raises NotConverged where the likelihood has no peak (no events, a feature that does not vary, a feature that
    orders the events perfectly).
    """
    rows = range_parts(_cox_rows(df, time, event, features, weight, stratum, cluster), "time")
    beta, cov, centre, _ = _cox_peak(rows, len(features), steps)
    meat = None
    if robust:
        names = [f"u{k}" for k in range(len(features))]
        own = _score_residuals(rows, beta, centre).groupBy("cluster").agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))
        meat = cov @ _products(own, names) @ cov
    discard(rows)
    return _table(df.sparkSession, features, beta, cov, meat, alpha)


def case_cohort(df: DataFrame, time: str, event: Column, features: list[str], stratum: str, sizes: DataFrame, alpha: float = 0.05, steps: int = 60) -> DataFrame:
    """Cox regression of a case-cohort sample with a stratified subcohort, cases weighted 1 and the others by what they stand for.

    ``df`` holds all cases, and the subcohort's others; ``sizes(stratum, n)`` the cohort's rows that are no cases. To the inverse
    information comes the sampling's part: by strata N (N - n) / n times the covariance of the score residuals of those sampled. A
    stratum with one of them has no covariance and adds nothing; a stratum without a size raises.
    """
    case = F.coalesce(event.cast("boolean"), F.lit(False))
    sampled = df.where(~case).groupBy(F.col(stratum).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    frame = sampled.join(sizes.select(F.col(stratum).alias("_k"), F.col("n").cast("double").alias("_big")), "_k", "left")
    odd = frame.where("_big IS NULL OR _big < _n").limit(1).collect()
    if odd:
        raise ValueError(f"a stratum has fewer in the cohort than in the sample, or no size: {odd[0].asDict()}")
    weighted = df.withColumn("_case", case).join(frame.withColumn("_wt", F.col("_big") / F.col("_n")), F.col(stratum) == F.col("_k"), "left")
    rows = _cox_rows(weighted, time, F.col("_case"), features, F.when(F.col("_case"), 1.0).otherwise(F.col("_wt")), None, stratum)
    rows = range_parts(rows, "time")
    beta, cov, centre, _ = _cox_peak(rows, len(features), steps)
    p, names = len(features), [f"u{k}" for k in range(len(features))]
    tri = [(i, j) for i in range(p) for j in range(i + 1)]
    own = _score_residuals(rows, beta, centre).where("e = 0").groupBy(F.col("cluster").alias("_k")).agg(*(F.covar_samp(names[i], names[j]).alias(f"c{i}_{j}") for i, j in tri))
    factor = F.col("_big") * (F.col("_big") - F.col("_n")) / F.col("_n")
    parts = own.join(frame, "_k").agg(*(F.sum(factor * F.coalesce(F.col(f"c{i}_{j}"), F.lit(0.0))).alias(f"c{i}_{j}") for i, j in tri)).first()
    delta = np.zeros((p, p))
    for i, j in tri:
        delta[i, j] = delta[j, i] = parts[f"c{i}_{j}"] or 0.0
    discard(rows)
    return _table(df.sparkSession, features, beta, cov, cov + cov @ delta @ cov, alpha)


def two_phase_logistic(df: DataFrame, outcome: str, features: list[str], stratum: str, sizes: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Logistic regression of a two-phase sample: rows weighted by phase one's over phase two's rows of their (stratum, outcome).

    ``sizes(stratum, outcome, n)`` counts phase one. Errors: the weighted sandwich, plus by cells N (N - n) / n times the covariance of the scores.
    """
    rows = df.na.drop(subset=[outcome, stratum, *features]).select(F.col(stratum).alias("_s"), F.col(outcome).cast("int").alias("_y"), *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)))
    cells = rows.groupBy("_s", "_y").agg(F.count(F.lit(1)).alias("_n")).join(sizes.select(F.col(stratum).alias("_s"), F.col(outcome).cast("int").alias("_y"), F.col("n").cast("double").alias("_big")), ["_s", "_y"], "left")
    if cells.where("_big IS NULL OR _big < _n").limit(1).count():
        raise ValueError("a cell has fewer rows in phase one than in phase two, or no size")
    rows = stage(rows.join(cells, ["_s", "_y"]).withColumn("_w", F.col("_big") / F.col("_n")))
    x = [f"_x{k}" for k in range(len(features))]
    fit = settled(logistic_fits(rows, [], "_y", x, F.col("_w"))).first()
    p = len(features) + 1
    b, cov = np.array(fit["b"]), np.array(fit["cov"]).reshape(p, p)
    eta = sum((float(b[k + 1]) * F.col(c) for k, c in enumerate(x)), F.lit(float(b[0])))
    off = F.col("_y") - 1 / (1 + F.exp(-eta))
    scores = rows.select("_s", "_y", "_w", "_n", "_big", off.alias("u0"), *((off * F.col(c)).alias(f"u{k + 1}") for k, c in enumerate(x)))
    names, tri = [f"u{k}" for k in range(p)], [(i, j) for i in range(p) for j in range(i + 1)]
    first = scores.agg(*(F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])).alias(f"c{i}_{j}") for i, j in tri)).first()
    factor = F.first("_big") * (F.first("_big") - F.first("_n")) / F.first("_n")
    second = scores.groupBy("_s", "_y").agg(*((factor * F.coalesce(F.covar_samp(names[i], names[j]), F.lit(0.0))).alias(f"c{i}_{j}") for i, j in tri)).agg(*(F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in tri)).first()
    meat = np.zeros((p, p))
    for i, j in tri:
        meat[i, j] = meat[j, i] = first[f"c{i}_{j}"] + second[f"c{i}_{j}"]
    return _table(df.sparkSession, ["intercept", *features], b, cov, cov @ meat @ cov, alpha)
