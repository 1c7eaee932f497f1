"""Mixing to target weights by soft membership and projected-gradient least squares.

Only DataFrame expressions touch the rows. A naive Bayes classifier over hashed
words, trained on a bounded sample of the labelled table, gives every document
its posterior of each domain. Every document then gets a rate, not below a floor
(0 unless set), so that the expected tokens of each domain meet their targets:

    minimise  sum_k (sum_d rate_d tokens_d p_dk - target_k)^2   over  rate_d >= floor

Documents whose posteriors fall into one cell of a fine grid share a rate, so the
sums over documents are taken once, as sums of tokens and posteriors by cell. A
cell is a hundredth wide, so there are a few thousand of them at most, whatever the
input; no other figures reach the driver. There the projected gradient (with momentum
and restarts, in the metric of tokens, from equal rates) runs until the projected gradient vanishes.
A document's rate is its cell's.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import stage

DOMAINS = ("high", "low", "toxic")
BUCKETS = 4096
GRID = 100  # cells of a posterior
TARGETS = {"high": 0.75, "low": 0.22, "toxic": 0.03}


def domain(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row; null without labels."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


def _buckets(text: Column) -> Column:
    """Hash buckets of a text's lower-cased words, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))


def classifier(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[float], list[list[float]]]:
    """Log priors of DOMAINS, and for each but the first the log ratios of its bucket rates to the first's.

    Trained on at most ``sample`` labelled rows by hash order; the driver gets
    BUCKETS rows at most.
    """
    known = labels.where("doc_id IS NOT NULL").select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("d")).where("d IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("d").alias("d"))
    shares = {r["d"]: r["n"] for r in known.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    words = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("d", F.explode(_buckets(F.col("text"))).alias("b"))
    counts = words.groupBy("b").agg(*(F.count(F.when(F.col("d") == d, 1)).alias(d) for d in DOMAINS)).collect()
    total = sum(shares.values())
    priors = [math.log((shares.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS]
    rates = []
    for d in DOMAINS:
        seen = {r["b"]: r[d] for r in counts}
        all_ = sum(seen.values()) + BUCKETS
        rates.append([math.log((seen.get(b, 0) + 1) / all_) for b in range(BUCKETS)])
    return priors, [[x - y for x, y in zip(r, rates[0])] for r in rates[1:]]


def posteriors(docs: DataFrame, priors: list[float], ratios: list[list[float]]) -> DataFrame:
    """(all columns of docs, tokens, p_<domain>...). Soft: a text's evidence is its mean word's, times the root of its words."""
    with_b = docs.withColumn("_b", _buckets(F.col("text")))
    tokens = F.size("_b").cast("double")
    logits = [F.lit(priors[0])]
    for prior, ratio in zip(priors[1:], ratios):
        table = F.split(F.lit(",".join(f"{x:.7g}" for x in ratio)), ",").cast("array<double>")  # folded to one constant
        total = F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(table, b))
        logits.append(F.lit(prior) + total / F.sqrt(F.greatest(tokens, F.lit(1.0))))
    out = with_b.withColumn("tokens", F.size("_b").cast("long")).withColumn("_z", F.array(*logits)).drop("_b")
    out = out.withColumn("_z", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    whole = F.aggregate("_z", F.lit(0.0), lambda a, z: a + z)
    for k, d in enumerate(DOMAINS):
        out = out.withColumn(f"p_{d}", F.get("_z", F.lit(k)) / whole)
    return out.drop("_z")


def _cell() -> Column:
    """Number of a document's cell, from all its posteriors but the last."""
    at = [F.least(F.floor(F.col(f"p_{d}") * GRID), F.lit(GRID - 1)) for d in DOMAINS[:-1]]
    return sum((x * GRID**k for k, x in enumerate(at)), F.lit(0)).cast("int")


def descend(p: np.ndarray, w: np.ndarray, goal: np.ndarray, floor: float, start: float, close: float = 1e-7, most: int = 200_000) -> np.ndarray:
    """Rates r >= floor that minimise |sum_c w_c r_c p_c - goal|^2, for cells of mean posteriors ``p`` and shares ``w`` of the tokens.

    Raises where the projected gradient (root mean square over tokens) does not come
    below ``close`` in ``most`` steps.
    """
    r = y = np.full(len(w), start)
    step = 1 / max(1e-12, float(np.linalg.eigvalsh((p * w[:, None]).T @ p)[-1]))
    momentum = 1.0
    for _ in range(most):
        gap = (w * r) @ p - goal
        if np.sqrt((w * (r - np.maximum(floor, r - p @ gap)) ** 2).sum()) <= close:
            return r
        new = np.maximum(floor, y - step * (p @ ((w * y) @ p - goal)))
        if (w * (y - new) * (new - r)).sum() > 0:  # the momentum points uphill
            y, momentum = r, 1.0
            new = np.maximum(floor, y - step * (p @ gap))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y, r, momentum = new + (momentum - 1) / after * (new - r), new, after
    raise RuntimeError(f"rates did not settle in {most} steps")


def solve(members: DataFrame, targets: dict[str, float], budget: float, floor: float) -> Column:
    """The rate as an expression of p_<domain>; documents of cells without tokens get the first rate."""
    sums = members.where("tokens > 0").groupBy(_cell().alias("cell"))
    rows = sums.agg(F.sum("tokens").alias("n"), *(F.sum(F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS)).orderBy("cell").collect()  # GRID ** 2 at most
    start = max(float(budget), float(floor))
    if not rows:
        return F.lit(start)
    n = np.array([float(r["n"]) for r in rows])
    p = np.array([[r[d] for d in DOMAINS] for r in rows], float) / n[:, None]
    goal = np.array([targets.get(d, 0.0) for d in DOMAINS]) / sum(targets.values()) * budget
    rates = dict(zip((r["cell"] for r in rows), descend(p, n / n.sum(), goal, floor, start).tolist()))
    table = F.split(F.lit(",".join(f"{rates.get(c, start):.9g}" for c in range(GRID ** (len(DOMAINS) - 1)))), ",").cast("array<double>")  # folded to one constant
    return F.get(table, _cell())


def shares(rated: DataFrame) -> dict[str, float]:
    """Expected tokens of each domain as multiples of all tokens given, of a table with tokens, p_<domain> and rate."""
    row = rated.agg(F.sum("tokens"), *(F.sum(F.col("tokens") * F.col("rate") * F.col(f"p_{d}")) for d in DOMAINS)).first()
    return {d: float(row[k + 1] or 0) / float(row[0] or 1) for k, d in enumerate(DOMAINS)}


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0, floor: float = 0.0, sample: int = 3000) -> DataFrame:
    """(doc_id, tokens, p_<domain>, rate) per row of ``docs``.

    ``budget`` is the wanted total of expected tokens as a multiple of the given
    one. Null and empty texts have no tokens, posteriors equal to the priors, and
    a rate like any other. Rows that repeat a doc_id count each; a null doc_id
    stays null. Without labelled rows all posteriors are equal. If the targets cannot
    be met the rates come closest in least squares (shares() tells what is reached).
    An empty table gives an empty result. Other columns are not read.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = stage(posteriors(given, *classifier(given, labels, sample)).drop("text"))
    rate = solve(members, targets or TARGETS, budget, floor)
    return members.withColumn("rate", F.round(rate, 9))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float, floor: float = 1.0, sample: int = 3000) -> DataFrame:
    """``docs`` with every row repeated as its rate says; all columns stay.

    A row appears floor(rate + u) times, u uniform in [0, 1) by a hash of the
    doc_id and text, so the expected number is the rate; with a floor of 1 none goes.
    Null and empty texts have no tokens and the first rate (the budget or the floor).
    Rows that repeat a doc_id count each. An empty table stays empty.
    """
    given = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("text"))
    model = classifier(docs, labels, sample)
    rate = solve(posteriors(docs.select("text"), *model), targets, budget, floor)
    # The posteriors are made once for the sums by cell and once for the copies, and no text is
    # written. The row number keeps the optimizer from making them again for the filter on the copies.
    scored = posteriors(given, *model).drop("text").withColumn("_row", F.monotonically_increasing_id())
    u = F.pmod(F.xxhash64("_doc.doc_id", "_doc.text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = scored.select("_doc", F.floor(rate + u).cast("int").alias("_n"), "_row")
    return copies.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).select("_doc.*")
