"""Assembly by overlaps against one sorted pass in plain Python."""

import random

import pytest

from quillon.operators.assembly import assemble_overlapping, placements

SCHEMA = "g string, k long, s string"


def plain(peptides, least):
    """(key, contig, start) of each peptide of one group."""
    one = {}
    for k, s in sorted(peptides):
        one.setdefault(s, k)
    inner = {s for s in one if len(s) >= least and any(s != t and s in t for t in one)}
    tops = [s for s in one if s not in inner]
    edges = []
    for a in tops:
        for b in tops:
            common = [n for n in range(least, min(len(a), len(b))) if a.endswith(b[:n])]
            if a != b and common:
                edges.append((-max(common), one[a], one[b], len(a) - max(common)))
    after, before = {}, {}
    for o, a, b, at in sorted(edges):
        if a not in after and b not in before:
            after[a], before[b] = (o, b), (o, a, at)
    for k in list(before):  # rings
        ring, x = [k], before.get(k, (0, None))[1]
        while x is not None and x != k and x not in ring:
            ring.append(x)
            x = before[x][1] if x in before else None
        if x == k:
            _, a, b = max((before[y][0], before[y][1], y) for y in ring)
            del before[b]
    place = {}
    for s in tops:
        k, start = one[s], 0
        while k in before:
            start, k = start + before[k][2], before[k][1]
        place[s] = k, start
    for s in inner:
        t = min((t for t in tops if s in t), key=lambda t: (-len(t), one[t]))
        place[s] = place[t][0], place[t][1] + t.index(s)
    return {(k, *place[s]) for k, s in peptides}


def test_fragments_of_long_sequences(spark):
    rng = random.Random(1)
    rows, wholes = [], {}
    for g in "uv":
        wholes[g] = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(400))
        cuts = [wholes[g][i : i + 15] for i in range(0, 386, 5)] + [wholes[g][390 - 15 + 10 :]]
        cuts += [wholes[g][30:42], wholes[g][0:15]]  # one inside another, one twice
        rng.shuffle(cuts)
        rows += [(g, n, s) for n, s in enumerate(cuts)]
    got = assemble_overlapping(spark.createDataFrame(rows, SCHEMA).repartition(4), "g", "k", "s", 8).collect()
    assert {(r.g, r.seq) for r in got} == set(wholes.items())
    assert {r.peptides for r in got} == {len(rows) // 2}


@pytest.mark.parametrize("letters,size", [("AB", 7), ("ABCD", 6)])
def test_ties_repeats_and_rings_against_a_sorted_pass(spark, letters, size):
    rng = random.Random(2)
    groups = {g: [(n, "".join(rng.choice(letters) for _ in range(rng.randint(2, size)))) for n in range(30)] for g in "uvw"}
    groups["ring"] = [(0, "abcde"), (1, "defgh"), (2, "ghiab")]
    groups["alone"] = [(5, "x")]
    rows = [(g, n, s) for g, given in groups.items() for n, s in given]
    odd = [("u", 99, None), ("u", 98, ""), ("u", None, "AAAA"), (None, 97, "AAAA")]
    df = spark.createDataFrame([*rows, *odd], SCHEMA)
    got = {}
    for r in placements(df, "g", "k", "s", 2).collect():
        got.setdefault(r.g, set()).add((r.k, r.contig, r.start))
    for g, given in groups.items():
        assert got.pop(g) == plain(given, 2), g
    assert not got


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert assemble_overlapping(empty, "g", "k", "s").count() == 0
    with pytest.raises(ValueError):
        placements(empty, "g", "k", "s", 0)


def test_query_and_sql_where_texts_meet(spark, tmp_path):
    """Equal texts, overlaps by chance and rings, of which the SQL once knew nothing."""
    import duckdb
    from compare import plain as common
    from compare import spark_rows

    from quillon.plans import registry

    registry.load_all()
    sql = registry.ORACLES["sq16_overlaps"]
    assert "md5(p_name || p_partkey)" in sql

    def rows_of_sql(text, path):
        c = duckdb.connect()
        c.execute(f"CREATE VIEW part AS SELECT * FROM '{path}/part.parquet/*.parquet'")
        return sorted(tuple(map(common, r)) for r in c.execute(f"SELECT contig, g, peptides, seq FROM ({sql.replace('md5(p_name || p_partkey)', text)})").fetchall())

    names = "p_brand string, p_partkey long, p_name string"
    spark.createDataFrame([("u", 2, "x1"), ("u", 12, "x"), ("u", 3, "y"), ("v", 2, "x1"), ("v", 4, None)], names).write.parquet(f"{tmp_path}/a/part.parquet")
    got = spark_rows(registry.QUERIES["sq16_overlaps"](spark, f"{tmp_path}/a"))[1]
    assert sorted(got) == rows_of_sql("md5(p_name || p_partkey)", tmp_path / "a") and sorted(r[2] for r in got) == [6, 6, 12]
    rng = random.Random(3)
    texts = ["ABCDEFGHIJKLMNOP" * 2, "HIJKLMNOPABCDEFG" * 2, "CDEFGHIJKLMNOPAB" * 2, *("".join(rng.choice("ABC") for _ in range(32)) for _ in range(20)), *("".join(rng.choice("AB") for _ in range(8)) * 4 for _ in range(6))]
    spark.createDataFrame([("uv"[k % 2], k, t) for k, t in enumerate(texts)], names).write.parquet(f"{tmp_path}/b/part.parquet")
    pieces = spark.read.parquet(f"{tmp_path}/b/part.parquet").selectExpr("p_brand AS g", "p_name AS t", "p_partkey", "explode(sequence(0, 20, 4)) AS at").selectExpr("g", "p_partkey * 100 + at AS k", "substring(t, at + 1, 12) AS s")
    got = spark_rows(assemble_overlapping(pieces, "g", "k", "s", 8))[1]
    assert sorted(got) == rows_of_sql("p_name", tmp_path / "b") and len(got) < len(texts)
