"""What a plan moves or holds must not grow past its input: shapes of plans, and results on odd rows beside them."""

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import aggregates, association, comparisons, joins, models, regression, resampling, sequences
from quillon.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_permuted_correlation_broadcasts_no_replicates(spark):
    df = spark.range(60).select("id", (F.col("id") * 7 % 11).alias("x"), (F.col("id") * 5 % 13).alias("y"))
    got = resampling.permuted_correlation(df, "id", "x", "y", 20, seed=3)
    assert "SortMergeJoin" in plan(got)
    keys = [spark.range(60).select("id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("r")).select("id", "r", F.xxhash64("id", "r", F.lit(s)).alias("h")).collect() for s in (3, 4)]
    values, rho = {r["id"]: (r["x"], r["y"]) for r in df.collect()}, []
    for rep in range(20):
        a, b = ([i for _, i in sorted((k["h"], k["id"]) for k in side if k["r"] == rep)] for side in keys)
        rho.append(np.corrcoef([values[i][0] for i in a], [values[i][1] for i in b])[0, 1])
    seen = np.corrcoef(*zip(*values.values()))[0, 1]
    row = got.first()
    assert abs(row["rho"] - seen) < 1e-12 and abs(row["p"] - (sum(abs(v) >= abs(seen) for v in rho) + 1) / 21) < 1e-12


def test_kernels_shuffle_no_pairs(spark):
    """Pairs meet what has one value for each object by broadcast: no exchange below holds the table of pairs."""
    s = spark.range(40).select(F.col("id").alias("i"), (F.col("id") * 7 % 11).cast("double").alias("x"))
    pairs = s.crossJoin(F.broadcast(s.toDF("j", "y"))).select("i", "j", F.abs(F.col("x") - F.col("y")).alias("d"))
    kernel = models.gower_kernel(pairs)
    for df in (kernel, models.kernel_distance(kernel), models.kernel_score(kernel, s.select("i", F.col("x").alias("r")))):
        assert "SortMergeJoin" not in plan(df) and "hashpartitioning" not in plan(df)
    d = np.abs(np.subtract.outer(*[np.arange(40) * 7 % 11] * 2)).astype(float)
    centre = np.eye(40) - 1 / 40
    want = -0.5 * centre @ d**2 @ centre
    assert all(abs(r["k"] - want[r["i"], r["j"]]) < 1e-9 for r in kernel.collect())
    r = np.arange(40) * 7 % 11 - np.mean(np.arange(40) * 7 % 11)
    got = comparisons.kernel_permutation_test(kernel, spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "i long, r double"), 40).first()
    assert abs(got["q"] - r @ want @ r / r.var(ddof=1)) < 1e-6 and got["p"] == 1 / 41


def test_alignments_and_hypercubes_of_a_batch_equal_the_single_ones(spark):
    rng = np.random.default_rng(1)
    text = lambda: "".join(rng.choice(list("ACDX-"), rng.integers(0, 9)))
    score = lambda x, y: 4.0 if x == y else 1.0 if "A" in (x, y) else -1.0
    a, b = [text() for _ in range(200)], [text() for _ in range(200)]
    assert sequences.alignment_scores(a, b, score).tolist() == [sequences.needleman_wunsch(x, y, score) for x, y in zip(a, b)]
    for k in (1, 2, 3):
        x, y = rng.integers(0, 9, (2, 60, 2**k))
        x[0] = 0  # without mass
        df = spark.createDataFrame([(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(x, y))], "i long, p array<long>, q array<long>")
        got = {r["i"]: r["distance"] for r in models.hypercube_distances(df, "p", "q", ["i"]).collect()}
        assert np.array_equal(np.array([got[i] for i in range(60)], float), [models.hypercube_distance(p, q) for p, q in zip(x, y)], equal_nan=True)
    assert len(models._extreme_potentials(3)) < len(models._potentials(3)) / 10


def test_similarity_of_a_batch(spark):
    scores = {("A", "A"): 4.0, ("A", "C"): 1.0, ("C", "A"): 1.0, ("C", "C"): 4.0}
    rows = [(1, "AC-A", "CC"), (2, "", "A"), (3, "xx", "yy"), (4, None, "A"), (5, "A\U0001f600C", "AAC")]
    got = {r["k"]: r["similarity"] for r in sequences.substitution_similarity(spark.createDataFrame(rows, "k long, a string, b string"), ["k"], "a", "b", scores).collect()}
    assert got == {1: 2 * 5 / (12 + 8), 2: 0.0, 3: None, 4: None, 5: 2 * 8 / (8 + 12)}


def test_percentiles_where_no_weight_is_left(spark):
    df = spark.createDataFrame([(float(k), 1) for k in range(100)], "v double, w int")
    got = comparisons.replicated_percentiles(df, "v", "w", [0.25, 0.9], 10).orderBy("share").collect()
    assert [tuple(r) for r in got] == [(0.25, None), (0.9, None)]


def test_delong_without_a_window_over_all_rows(spark):
    rng = np.random.default_rng(2)
    o, x, y = rng.random(80) < 0.4, rng.integers(0, 9, 80), rng.integers(0, 5, 80)
    df = spark.createDataFrame([(i, float(a), float(b), bool(c)) for i, (a, b, c) in enumerate(zip(x, y, o))], "i long, x double, y double, o boolean")
    got = association.delong_test(df, "i", "x", "y", F.col("o"))
    assert "mid_rank" not in association.delong_test.__code__.co_names and "rank(" not in plan(got)
    row, var, mean = got.first(), 0.0, []
    parts = [(np.sign(np.subtract.outer(s[o], s[~o])) + 1) / 2 for s in (x, y)]
    for axis in (1, 0):
        gap = parts[0].mean(axis) - parts[1].mean(axis)
        var += gap.var(ddof=1) / len(gap)
    mean = [p.mean() for p in parts]
    assert np.allclose([row["auc_a"], row["auc_b"], row["variance"]], [*mean, var], atol=1e-12)


def test_substring_matches_are_an_equal_join(spark):
    names = ["ab", "b", "zz", "zz", "xyz", None, "q1"]
    paths = ["run/ab.p", "run/zz", "run/xyz.p", "q1", "q1", None, "n"]
    files = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, k int")
    samples = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, s int")
    got = joins.match_substring(files, samples, "path", "name")
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [("run/xyz.p", 2, "xyz", 4)]


def test_kmers_and_sites_are_not_sorted(spark):
    df = spark.createDataFrame([(1, "AACA", 0), (2, "ACAA", 1), (3, "CAAC", 1)], "id long, seq string, st int").repartition(3)
    got = sequences.tracked_kmers(df, "id", "seq", 2)
    assert sorted(tuple(r) for r in got.collect()) == [("AA", 3, 0, 1), ("AC", 3, 0, 2), ("CA", 3, 0, 3)]
    for out in (got, sequences.assemble(df.withColumn("g", F.lit(1)), "g", "st", "seq")):
        below = plan(out).split("Generate")[0]  # what lies above the rows that are laid out
        assert "HashAggregate" in below.rsplit("Exchange", 1)[1]


def test_nearness_of_numbers_needs_no_pairs_of_items(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(g), None if i == 7 else float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 4, 60), rng.uniform(-50, 50, 60).round(1)))]
    df = spark.createDataFrame(rows, "i long, g int, v double")
    near = joins.near_pairs(df, "i", "v", 3).select("i", F.col("i_b").alias("j"), "d")
    want = aggregates.radius_shared(df, "i", "g", near, 3)
    assert sorted(map(tuple, aggregates.radius_shared_values(df, "i", "g", "v", 3).collect())) == sorted(map(tuple, want.collect()))


def test_coverage_of_one_mismatch(spark):
    rng = np.random.default_rng(5)
    t, p = (["".join(rng.choice(list("AC"), rng.integers(0, 7))) for _ in range(n)] for n in (60, 6))
    got = sequences.coverage(*(spark.createDataFrame([(s,) for s in x], "seq string") for x in (p, t)), "seq", 1, 3).first()
    close = [any(len(s) == len(q) and sum(c != d for c, d in zip(s, q)) <= 1 for q in p) for s in sorted(set(t))]
    assert got["n"] == len(close) and abs(got["coverage"] - np.mean(close)) < 1e-12


def test_pairs_meet_in_blocks(spark, monkeypatch):
    """No task gets a whole group, and few rows are spread over all tasks."""
    monkeypatch.setattr(joins, "BLOCK", 8)
    rng = np.random.default_rng(6)
    rows = [(i, int(g), "".join(rng.choice(list("ACD-"), rng.integers(0, 17)))) for i, g in enumerate(rng.integers(0, 3, 120))]
    rows += [(200, 0, None), (201, None, "AC"), (202, None, "A")]
    df = spark.createDataFrame(rows, "id long, g int, seq string").repartition(3)
    want = sorted((a[1], a[0], b[0], sum(x != y for x, y in zip(a[2], b[2]))) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and a[2] is not None and b[2] is not None)
    out = sequences.hamming_table(df, "id", "seq", ["g"])
    assert sorted(map(tuple, out.collect())) == want
    assert "distinct" not in plan(out).lower() and "_p" in plan(out)
    odd = df.withColumn("seq", F.regexp_replace("seq", "C", "é"))
    assert sorted(map(tuple, sequences.hamming_table(odd, "id", "seq", ["g"]).collect())) == want
    ones = joins.all_pairs(df.where("g = 1").select("id", "seq"), "id", [])
    assert sorted((r["id"], r["id_b"], r["seq"], r["seq_b"]) for r in ones.collect()) == sorted((a[0], b[0], a[2], b[2]) for a in rows for b in rows if a[1] == b[1] == 1 and a[0] < b[0])
    sizes = [r["n"] for r in joins.block_pairs(df, "id", ["g"]).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4


def test_components_shrink_a_round(spark, monkeypatch):
    """On a path half of the ids go on, so that all rounds together write a few times the edges."""
    sizes = []

    def stage(df, plain=models.stage):
        sizes.append((out := plain(df)).count())
        return out

    monkeypatch.setattr(models, "stage", stage)
    edges = [(k, k + 1) for k in range(1, 300)] + [(400 + k, 999) for k in range(60)] + [(2000, 2000), (5, 5), (7, None)]
    got = {r["id"]: r["component"] for r in models.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 301)} | {400 + k: 400 for k in range(60)} | {999: 400, 2000: 2000}
    assert min(sizes) == 0 and sum(sizes) < 9 * len(edges)
    assert [tuple(r) for r in models.components(spark.createDataFrame([(3, 3)], "u long, v long")).collect()] == [(3, 3)]


def test_linkage_of_numbers_needs_no_pairs(spark):
    rng = np.random.default_rng(7)
    for n in (1, 2, 9, 30):
        for v in (rng.integers(0, 12, n) / 4, rng.normal(size=n)):
            for k in (1, 3, 40):
                assert models.value_labels(v, k).tolist() == models.linkage_labels(np.abs(np.subtract.outer(v, v)), k).tolist()
    rows = [(i, int(g), None if i == 5 else float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 50), rng.uniform(0, 9, 50).round(1)))] + [(70, 9, 1.0)]
    df = spark.createDataFrame(rows, "i long, g int, v double")
    known = df.where("v IS NOT NULL")
    pairs = known.alias("a").join(known.alias("b"), "g").where("a.i < b.i").selectExpr("g", "a.i AS i", "b.i AS j", "abs(a.v - b.v) AS d")
    got = models.cluster_values(df, ["g"], "i", "v", 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, models.cluster_groups(pairs, ["g"], 3).collect()))
    registry.load_all()
    assert "Join" not in plan(registry.QUERIES["clu1_linkage"](spark, "/root/testdata/sf0.001"))


def test_like_responses_come_to_their_island_once(spark):
    text = "ACDEFGHIKLMNPQRSTVWYAC"
    given = [(k, s, s + 10) for k, s in enumerate([0, 1, 12, 0, 1, 1, 12] * 30)]
    rows = spark.createDataFrame([(1, 0, k, a, b, text[a:b]) for k, a, b in given], "u int, island int, id int, start int, end int, seq string")
    got = sequences.epitopes(rows, "u", "island", "id", "start", "end", "seq")
    assert "Aggregate" in plan(got).split("FlatMapGroupsInPandas")[1]
    assert sorted(map(tuple, got.collect())) == sorted((1, 0, k, int(s == 12), 12 if s == 12 else 1, 22 if s == 12 else 10, 0) for k, s, _ in given)


def test_whole_ranges_of_responses_are_not_taken_apart():
    """All 2^24 sets of responses that share enough are parts of one."""
    import pandas as pd

    class Responses:
        dtypes = [("u", "int"), ("island", "int"), ("id", "int"), ("start", "int"), ("end", "int"), ("seq", "string")]
        groupBy = lambda self, *by: self
        applyInPandas = lambda self, solve, schema: solve

    rows = [(1, 0, k, k, 40 + k, "ACDEF"[k % 5 :] + "ACDEF" * 7 + "ACDEF"[: k % 5]) for k in range(24)]
    solve = sequences.epitopes(Responses(), "u", "island", "id", "start", "end", "seq", reduce=False)
    got = solve(pd.DataFrame(rows, columns=[c for c, _ in Responses.dtypes]))
    assert got["id"].tolist() == list(range(24)) and set(got["start"]) == {23} and set(got["end"]) == {40} and not got["epitope"].any()


def test_dilutions_are_fitted_together(spark):
    rng = np.random.default_rng(8)
    x = 2.0 ** np.arange(10)
    curves = [(x[: 10 - k % 3], models.dilution_curve(x[: 10 - k % 3], 20.0 + k, 1.2, 10.0 + k % 3, 0.5) + (k % 2) * rng.normal(size=10 - k % 3) * 0.2) for k in range(30)]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, c in enumerate(curves) for a, b in zip(*c)] + [(0, 0.0, 5.0), (1, 2.0, None)], "k int, dose double, y double")
    for parameters in (3, 4):
        got = models.fit_dilutions(df, ["k"], "dose", "y", parameters)
        assert "FlatMapGroups" not in plan(got)
        found = {r[0]: r[1:] for r in got.collect()}
        assert len(found) == 30
        for k, c in enumerate(curves):
            want = models.dilution_fit(*c, parameters)
            error = lambda t: ((c[1] - models.dilution_curve(c[0], *t)) ** 2).sum()
            assert error(found[k]) <= error(want) * (1 + 1e-6) + 1e-9
            assert parameters == 3 or np.allclose(found[k], want, rtol=1e-3)


def _folded(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 20, (240, 2)) / 10
    y = (x[:, 0] + rng.normal(size=240) > 1).astype(int)
    df = spark.createDataFrame([(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, x))] + [(999, 1, None, 0.0)], "id long, y int, a double, b double")
    fold = {r["id"]: r["fold"] for r in models.add_folds(df.na.drop(), "id", "y", 4).collect()}
    order = {i: h for i, h in df.na.drop().select("id", F.xxhash64("id", F.lit(0))).collect()}
    for c in (0, 1):
        own = sorted((order[i], i) for i in range(240) if y[i] == c)
        assert [fold[i] for _, i in own] == [k % 4 for k in range(len(own))]
    return df, x, y, np.array([fold[i] for i in range(240)])


def test_stacks_are_fitted_by_sums(spark):
    df, x, y, fold = _folded(spark)
    out = models.stacked_scores(df, "id", "y", {"p": ["a"], "q": ["b", "a"]}, 4)
    assert "InPandas" not in plan(out) and "Window" not in plan(out)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 240
    for h in range(4):
        for name, use in (("p", [0]), ("q", [0, 1])):
            beta = models.logistic_fit(x[fold != h][:, use], y[fold != h], l2=1e-3)[0]
            want = models.logistic_predict(beta, x[:, use])
            assert all(abs(got[i][name] - want[i]) < 1e-9 for i in range(240) if fold[i] == h)


def test_cross_validation_by_sums(spark):
    df, x, y, fold = _folded(spark)
    out = models.cross_validate(df, "id", "y", ["a", "b"], 4, [0.0, 3.0, 1000.0])
    assert "InPandas" not in plan(out)
    got = {(r["penalty"], r["fold"]): r for r in out.collect()}
    assert len(got) == 12
    for (penalty, h), r in got.items():
        z = (x - x[fold != h].mean(0)) / (x[fold != h].std(0) + 1e-12)
        beta = models.logistic_fit(z[fold != h], y[fold != h], l1=penalty)[0]
        p = models.logistic_predict(beta, z[fold == h])
        assert abs(r["auc"] - models.auc(y[fold == h] > 0.5, p)) < 1e-9 and abs(r["accuracy"] - ((p > 0.5) == (y[fold == h] > 0.5)).mean()) < 1e-9


def test_scores_of_replicates_are_counted_in_many_tasks(spark, monkeypatch):
    """A task explodes SCORES rows and replicates, not all of the one file that holds the rows."""
    monkeypatch.setattr(regression, "SCORES", 200)
    seen = []

    def stage(df, plain=regression.stage):
        seen.append(plan(df))
        return plain(df)

    monkeypatch.setattr(regression, "stage", stage)
    rng = np.random.default_rng(10)
    rows = [(i, int(rng.random() < 0.3 + 0.4 * (i % 2)), float(rng.normal() + i % 2)) for i in range(80)]
    got = regression.optimism_bootstrap(spark.createDataFrame(rows, "id long, y int, x double").coalesce(1), "id", "y", ["x"], n=9).first()
    assert got["used"] == 9 and any("_row" in p and ", 4), REPARTITION_BY_NUM" in p for p in seen)
