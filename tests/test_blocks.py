"""Pairs in blocks against plain numpy, and plans in which no pair is a row before its result is known."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, comparisons, joins, models, reduce, sequences
from quillon.plans import registry

registry.load_all()
SF = "/root/testdata/sf0.01"


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of some seven rows, so that small tables make many."""
    monkeypatch.setattr(blocks.paired_blocks, "__defaults__", (7, None))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["poly2_decomposed", "poly2_by_order"])
def test_pairs_of_samples_are_not_joined_row_by_row(spark, query):
    text = plan(registry.QUERIES[query](spark, SF))
    above = text[: text.index("MapInArrow")]
    assert "Aggregate" not in above and "Exchange" not in above and "Generate" not in above


def test_all_decomposed_distances(spark, small_blocks):
    rng = np.random.default_rng(9)
    rows = [(s, int(c), 1) for s in range(20) for c in rng.integers(0, 16, 9)] + [(99, 3, 0)]
    cells = spark.createDataFrame(rows, "s long, cell int, v int")
    pairs = spark.createDataFrame([*combinations([*range(20), 99], 2)], "s long, s_b long")
    for ways in (2, 3, 4):
        given = models.decomposed_distances(cells, pairs, "s", "s_b", "s", "cell", "v", list("ABCD"), ways)
        want = {(r.s, r.s_b, r.markers, r.nmarkers): r.distance for r in given.collect()}
        got = {(r.s, r.s_b, r.markers, r.nmarkers): r.distance for r in models.all_decomposed_distances(cells, "s", "cell", "v", list("ABCD"), ways).collect()}
        assert got == {k: v if v is None else pytest.approx(v, abs=1e-9) for k, v in want.items()}
        totals = {(r.s, r.s_b, r.nmarkers): r.distance for r in models.all_decomposed_distances(cells, "s", "cell", "v", list("ABCD"), ways, by_order=True).collect()}
        for (a, b, k), v in totals.items():
            every = [x for key, x in want.items() if key[:2] == (a, b) and key[3] == k]
            assert (v is None and None in every) or v == pytest.approx(sum(every), abs=1e-9)
        assert len(totals) == 21 * 20 // 2 * ways


@pytest.mark.parametrize("markers", [1, 2, 3, 4])
def test_all_hypercube_distances(spark, small_blocks, markers):
    rng = np.random.default_rng(markers)
    h = rng.integers(1, 9, (16, 2**markers))
    df = spark.createDataFrame([(f"s{k:02}", x.tolist()) for k, x in enumerate(h)], "s string, h array<long>")
    got = {(r.s, r.s_b): r.distance for r in models.all_hypercube_distances(df, "s", "h").collect()}
    assert got == {(f"s{i:02}", f"s{j:02}"): pytest.approx(models.hypercube_distance(h[i], h[j]), abs=1e-12) for i, j in combinations(range(16), 2)}


def test_poly1_pairs_meet_in_blocks(spark):
    text = plan(registry.QUERIES["poly1_hypercube"](spark, SF))
    assert "MapInPandas" not in text and "MapInArrow" in text


def test_pair_tables(spark):
    rng = np.random.default_rng(3)
    xy = rng.normal(size=(30, 2)).round(1)
    xy[5] = xy[6]
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(xy)], "id long, x double, y double")
    table = blocks.PairTable(blocks.points(df, "id", F.col("x"), F.col("y")), blocks.plane_distance, 7)
    d = np.sqrt(((xy[:, None] - xy) ** 2).sum(2))
    full = lambda t: np.array(sorted((r.i, r.j, r.v) for r in t.pairs("v").collect())).reshape(30, 30, 3)
    assert np.allclose(full(table)[..., 2], d) and (full(table)[..., 0] == np.arange(30)[:, None]).all()
    centre = np.eye(30) - 1 / 30
    want = -0.5 * centre @ d**2 @ centre
    kernel = models.gower_kernel(table)
    assert np.allclose(full(kernel)[..., 2], want) and np.allclose(full(models.kernel_distance(kernel))[..., 2], d, atol=1e-7)
    assert kernel.trace() == pytest.approx(np.trace(want))
    w = rng.normal(size=(30, 3))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(w)], "i long, w array<double>")
    assert np.allclose([r.w for r in kernel.image(vectors, 3).orderBy("i").collect()], want @ w)
    assert np.allclose([r.s for r in kernel.forms(vectors, 3).orderBy("n").collect()], np.diag(w.T @ want @ w))
    scores, values, trace = reduce.classical_scaling(table, 2)
    got = np.array([(r.kpc1, r.kpc2) for r in scores.orderBy("i").collect()])
    assert np.allclose(np.sqrt(((got[:, None] - got) ** 2).sum(2)), d, atol=1e-6) and sum(values) == pytest.approx(trace)


def test_kernel_tests_of_a_table_and_of_its_rows(spark):
    s = spark.range(40).select("id", (F.col("id") * 7 % 11).cast("double").alias("x"))
    r = s.select(F.col("id").alias("i"), ((F.col("id") * 5 % 13) - 5.8).alias("r"))
    kernel = models.gower_kernel(blocks.PairTable(blocks.points(s, "id", F.col("x")), blocks.line_distance, 9))
    rows = kernel.pairs("k")
    one, two = (comparisons.kernel_permutation_test(k, r, 150).first() for k in (kernel, rows))
    assert one.q == pytest.approx(two.q) and one.p == two.p
    one, two = (comparisons.kernel_omnibus_test(k, "kernel", r, 20).first() for k in ({"a": kernel}, rows.withColumn("kernel", F.lit("a"))))
    assert one.q == pytest.approx(two.q) and one[2:] == two[2:] and one.kernel == "a"


def test_pairs_of_like_points_are_written_together(spark):
    """Two of three neighbouring rows of a table of few distinct coordinates are alike, whatever the order of the keys."""
    s = spark.range(600).select("id", (F.col("id") * 7 % 11).cast("double").alias("x"))
    d = [r.d for r in blocks.PairTable(blocks.points(s, "id", F.col("x")), blocks.line_distance).pairs("d").collect()]
    assert np.mean(np.diff(d) == 0) > 2 / 3


@pytest.mark.parametrize("query", ["ro16_kernel_permutation", "ro16_omnibus", "em1_classical_scaling"])
def test_kernels_are_not_rows(spark, query, monkeypatch):
    """No stage of the query reads or aggregates a row for each pair."""
    monkeypatch.setattr(blocks.PairTable, "pairs", None)
    monkeypatch.setattr(reduce, "double_centred", None)
    monkeypatch.setattr(models, "double_centred", None)
    assert registry.QUERIES[query](spark, SF).count()


SCORE = lambda x, y: 4.0 if x == y else 1.0 if {x, y} <= set("AC") else -1.0


@pytest.mark.parametrize("gaps", [(3, 3), (0, 0), (4, 1), (2.5, 2.5)])
def test_every_alignment_of_two_blocks(gaps):
    rng = np.random.default_rng(4)
    text = lambda: "".join(rng.choice(list("ACDX-"), rng.integers(0, 9)))
    a, b = [text() for _ in range(25)], [text() for _ in range(30)]
    got = sequences.cross_alignment_scores(a, b, SCORE, *gaps)
    assert got.tolist() == [[sequences.needleman_wunsch(x, y, SCORE, *gaps) for y in b] for x in a]
    assert sequences.cross_alignment_scores(a, [], SCORE).shape == (25, 0) and sequences.cross_alignment_scores([], b, SCORE).shape == (0, 30)


def test_tables_of_pairs_of_sequences(spark, small_blocks):
    rng = np.random.default_rng(5)
    text = lambda: "".join(rng.choice(list("ACDX-"), rng.integers(0, 9)))
    given = [(k, "uvw"[k % 3], text()) for k in range(50)] + [(50, "u", None), (51, "one", "ACD"), (52, "none", None), (53, "none", "")]
    df = spark.createDataFrame(given, "id long, g string, seq string")
    known = {k: (g, t) for k, g, t in given}
    want = {(i, j) for i, j in combinations(known, 2) if known[i][0] == known[j][0]}
    own = lambda t: sequences.needleman_wunsch(t, t, SCORE)
    got = {(r.id, r.id_b): r.distance for r in sequences.alignment_table(df, "id", "seq", SCORE, ["g"]).collect()}
    assert got.keys() == want
    for (i, j), v in got.items():
        s, t = known[i][1], known[j][1]
        assert v == (None if s is None or t is None else own(s) + own(t) - 2 * sequences.needleman_wunsch(s, t, SCORE))
    scores = {(x, y): SCORE(x, y) for x in "ACD" for y in "ACD"}
    for table in (scores, {k: v / 3 for k, v in scores.items()}, scores | {("A", "D"): 2.0}):
        pairs = joins.block_pairs(df, "id", ["g"])
        plain = {(r.id, r.id_b): r.similarity for r in sequences.substitution_similarity(pairs, ["id", "id_b"], "seq", "seq_b", table).collect()}
        seen = {(r.id, r.id_b): r.similarity for r in sequences.similarity_table(df, "id", "seq", table, ["g"]).collect()}
        assert seen == {k: v if v is None else pytest.approx(v) for k, v in plain.items()} and seen.keys() == want


@pytest.mark.parametrize("query", ["sq11_similarity", "sq13_alignment"])
def test_pairs_of_sequences_meet_in_blocks(spark, query):
    text = plan(registry.QUERIES[query](spark, SF))
    assert "MapInPandas" not in text and "MapInArrow" in text


def test_nearest_rounds_as_duckdb():
    import duckdb

    con = duckdb.connect()
    x = [1 / 128, -1 / 128, 0.1234565, -2.5e-7, 0.0, 1e300, float("inf")]
    assert blocks.nearest(np.array(x), 6).tolist() == [con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in x]
    assert np.isnan(blocks.nearest(np.array([np.nan]), 6)[0]) and blocks.nearest(np.array(x), None).tolist() == x
