"""Queries of sequence, alignment, island and hot-spot operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import sequences as Q
from quillon.plans.registry import query
from quillon.plans.statistics import rounded
from quillon.session import load

_S = "s AS (SELECT p_partkey AS id, translate(substr(md5(p_name || p_partkey), 1, 16), '0123456789abcdef', 'AACDEFGHIKAACC-A') AS seq, p_brand || '/' || p_size AS g FROM part)"


def _seqs(spark, d):
    p = load(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.translate(F.substring(F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))), 1, 16), "0123456789abcdef", "AACDEFGHIKAACC-A").alias("seq"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("g"))


@query("sq1_kmers", f"WITH {_S} SELECT id, i::INT AS start, substr(seq, i::INT + 1, 9) AS kmer FROM s, range(0, 8) r(i)")
def sq1(spark, d):
    return Q.kmers(_seqs(spark, d), "id", "seq", 9)


@query("sq1_stepped", f"WITH {_S} SELECT id, i::INT AS start, substr(seq, i::INT + 1, 9) AS kmer FROM s, (VALUES (0), (4), (7)) r(i)")
def sq1_step(spark, d):
    return Q.kmers(_seqs(spark, d), "id", "seq", 9, 4, final=True)


@query("sq1_tracked", f"WITH {_S}, k AS (SELECT id, i::INT AS start, substr(seq, i::INT + 1, 3) AS kmer FROM s, range(0, 14) r(i)) SELECT kmer, count(*) AS n, min(start) AS start, arg_min(id, start * 100000 + id) AS id FROM k GROUP BY 1")
def sq1_tracked(spark, d):
    return Q.tracked_kmers(_seqs(spark, d), "id", "seq", 3)


@query("sq2_pad", f"WITH {_S} SELECT id, rpad(substr(seq, 1, (id % 16 + 1)::INT), 16, '-') AS seq FROM s")
def sq2(spark, d):
    return Q.pad_alignment(_seqs(spark, d).withColumn("seq", F.substring(F.col("seq"), F.lit(1), (F.col("id") % 16 + 1).cast("int"))), "seq").select("id", "seq")


@query("sq2_sites", f"WITH {_S} SELECT id, (i - 1)::INT AS site, substr(seq, i::INT, 1) AS residue FROM s, range(1, 17) r(i)")
def sq2_sites(spark, d):
    return Q.sites(_seqs(spark, d), "id", "seq")


@query("sq2_slice", f"WITH {_S} SELECT id, substr(seq, 1, 1) || substr(seq, 6, 1) || substr(seq, 3, 1) AS seq FROM s")
def sq2_slice(spark, d):
    return Q.site_slice(_seqs(spark, d), "seq", [0, 5, 2]).select("id", "seq")


@query("sq3_consensus", f"WITH {_S}, c AS (SELECT i, substr(seq, i::INT, 1) AS r, count(*) AS n FROM s, range(1, 17) t(i) GROUP BY 1, 2), b AS (SELECT i, r FROM c QUALIFY row_number() OVER (PARTITION BY i ORDER BY (r <> '-')::INT DESC, n DESC, r) = 1) SELECT string_agg(r, '' ORDER BY i) AS seq FROM b")
def sq3(spark, d):
    return Q.consensus(_seqs(spark, d), "id", "seq")


@query(
    "sq3_kmer_consensus",
    f"WITH {_S}, k AS (SELECT i, substr(seq, i::INT + 1, 4) AS m, count(*) AS n FROM s, range(0, 13) t(i) GROUP BY 1, 2), b AS (SELECT i, m FROM k QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, m) = 1), v AS (SELECT i + j AS site, substr(m, j::INT + 1, 1) AS r, count(*) AS n FROM b, range(0, 4) t(j) GROUP BY 1, 2), w AS (SELECT site, r FROM v QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, r) = 1) SELECT string_agg(r, '' ORDER BY site) AS seq FROM w",
)
def sq3_kmer(spark, d):
    return Q.kmer_consensus(_seqs(spark, d), "id", "seq", 4)


@query("sq4_entropy", f"WITH {_S}, c AS (SELECT i::INT AS start, substr(seq, i::INT + 1, 2) AS m, count(*) AS n FROM s, range(0, 15) t(i) WHERE NOT contains(substr(seq, i::INT + 1, 2), '-') GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY start) AS p FROM c) SELECT start, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS \"unique\" FROM p GROUP BY 1")
def sq4(spark, d):
    return rounded(Q.site_entropy(_seqs(spark, d), "id", "seq", True, 2), 6)


@query("sq5_logo", f"WITH {_S}, c AS (SELECT (i - 1)::INT AS site, substr(seq, i::INT, 1) AS residue, count(*) AS n FROM s, range(1, 17) t(i) GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY site) AS p FROM c) SELECT site, residue, round(p * (log2(20) + sum(p * log2(p)) OVER (PARTITION BY site)), 6) AS height FROM p")
def sq5(spark, d):
    return rounded(Q.logo_heights(_seqs(spark, d), "id", "seq"), 6)


@query("sq6_diversity", f"WITH {_S}, x AS (SELECT id, g, i, substr(seq, i::INT, 1) AS r FROM s, range(1, 17) t(i)), m AS (SELECT a.g, a.i, avg((a.r <> b.r)::INT) AS m FROM x a JOIN x b ON a.g = b.g AND a.i = b.i AND a.id < b.id WHERE a.r <> '-' AND b.r <> '-' GROUP BY 1, 2) SELECT g, round(avg(m), 6) AS diversity FROM m GROUP BY 1")
def sq6(spark, d):
    return rounded(Q.pairwise_diversity(_seqs(spark, d), "id", "seq", ["g"]), 6)


@query("sq7_condense", f"WITH {_S}, x AS (SELECT id, i, substr(seq, i::INT, 1) AS r FROM s, range(1, 17) t(i)), gp AS (SELECT i FROM x GROUP BY 1 HAVING avg((r = '-')::INT) >= 0.0725) SELECT id, string_agg(r, '' ORDER BY i) AS seq FROM x WHERE i NOT IN (FROM gp) AND id NOT IN (SELECT id FROM x WHERE i IN (FROM gp) AND r <> '-') GROUP BY 1")
def sq7(spark, d):
    return Q.condense(_seqs(spark, d), "id", "seq", 0.0725)


@query("sq10_hamming", f"WITH {_S} SELECT a.id, b.id AS id_b, hamming(a.seq, b.seq)::INT AS d FROM s a JOIN s b ON a.g = b.g AND a.id < b.id")
def sq10(spark, d):
    return Q.hamming_table(_seqs(spark, d), "id", "seq", ["g"]).select("id", "id_b", "d")


@query("sq9_coverage", f"WITH {_S}, t AS (SELECT DISTINCT substr(seq, 1, 6) AS seq FROM s), p AS (SELECT DISTINCT substr(seq, 11, 6) AS seq FROM s WHERE id % 2 = 0) SELECT avg((EXISTS (SELECT 1 FROM p WHERE hamming(p.seq, t.seq) <= 1))::INT) AS coverage, count(*) AS n FROM t")
def sq9(spark, d):
    s = _seqs(spark, d)
    return Q.coverage(s.where("id % 2 = 0").select(F.substring("seq", 11, 6).alias("seq")), s.select(F.substring("seq", 1, 6).alias("seq")), "seq", 1, 3)


SCORES = {(a, b): (4.0 if a == b else 1.0 if {a, b} <= set("ACD") else -1.0) for a in "ACDEFGHIK" for b in "ACDEFGHIK"}


@query("sq11_similarity", f"WITH {_S}, x AS (SELECT id, g, i, substr(seq, i::INT, 1) AS r FROM s, range(1, 17) t(i)), c AS (SELECT a.id, b.id AS id_b, sum(CASE WHEN a.r = '-' OR b.r = '-' THEN 0 WHEN a.r = b.r THEN 4 WHEN a.r IN ('A', 'C', 'D') AND b.r IN ('A', 'C', 'D') THEN 1 ELSE -1 END) AS ab, sum(CASE WHEN a.r <> '-' THEN 4 ELSE 0 END) AS aa, sum(CASE WHEN b.r <> '-' THEN 4 ELSE 0 END) AS bb FROM x a JOIN x b ON a.g = b.g AND a.i = b.i AND a.id < b.id GROUP BY 1, 2) SELECT id, id_b, round(2 * ab / (aa + bb), 6) AS similarity FROM c")
def sq11(spark, d):
    return Q.similarity_table(_seqs(spark, d), "id", "seq", SCORES, ["g"], digits=6)


@query("sq13_alignment")
def sq13(spark, d):
    return Q.alignment_table(_seqs(spark, d), "id", "seq", lambda x, y: SCORES.get((x, y), -1.0), ["g"])


@query("sq15_find_peptide", f"WITH {_S}, f AS (SELECT id, seq, substr(replace(seq, '-', ''), 3, 4) AS p, instr(replace(seq, '-', ''), substr(replace(seq, '-', ''), 3, 4)) AS pos FROM s), m AS (SELECT f.*, list_filter(list_transform(range(0, 16), lambda i: CASE WHEN substr(seq, i::INT + 1, 1) <> '-' THEN i END), lambda x: x IS NOT NULL) AS places FROM f) SELECT id, places[pos]::INT AS start, (places[pos + 3] + 1)::INT AS \"end\" FROM m WHERE pos > 0 AND length(p) = 4")
def sq15(spark, d):
    pep = F.substring(F.replace("seq", F.lit("-"), F.lit("")), 3, 4)
    out = _seqs(spark, d).withColumn("p", pep).where("length(p) = 4").select("id", Q.find_peptide(F.col("p"), F.col("seq")).alias("f"))
    return out.where("f.start >= 0").select("id", "f.start", "f.end")


@query("sq16_assemble", f"WITH {_S}, x AS (SELECT g, (id % 9 + j)::INT AS site, substr(seq, j::INT + 1, 1) AS r FROM s, range(0, 16) t(j)), c AS (SELECT g, site, min(r) AS r, count(DISTINCT r) AS k FROM x GROUP BY 1, 2) SELECT g, string_agg(r, '' ORDER BY site) AS seq, count(*) FILTER (k > 1) AS conflicts FROM c GROUP BY 1")
def sq16(spark, d):
    return Q.assemble(_seqs(spark, d).withColumn("start", F.col("id") % 9), "g", "start", "seq")


@query("sq17_compare", f"WITH {_S} SELECT a.id, string_agg(CASE WHEN substr(a.seq, i::INT, 1) = substr(b.seq, i::INT, 1) THEN '.' ELSE substr(b.seq, i::INT, 1) END, '' ORDER BY i) AS diff FROM s a JOIN s b ON b.id = a.id + 1, range(1, 17) t(i) GROUP BY 1")
def sq17(spark, d):
    s = _seqs(spark, d)
    return s.join(s.select((F.col("id") - 1).alias("id"), F.col("seq").alias("seq_b")), "id").select("id", Q.compare_sequences("seq", "seq_b").alias("diff"))


_I = "i AS (SELECT p_partkey AS id, p_size AS u, (p_partkey * 7919 % 2000)::INT AS start, (p_partkey * 7919 % 2000)::INT + 8 + p_size % 8 AS \"end\" FROM part)"


def _responses(spark, d):
    start = (F.col("p_partkey") * 7919 % 2000).cast("int")
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("u"), start.alias("start"), (start + 8 + F.col("p_size") % 8).alias("end"))


@query("ep1_islands", f"WITH {_I}, r AS (SELECT *, max(\"end\") OVER (PARTITION BY u ORDER BY start, \"end\", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i) SELECT id, u, (sum(coalesce((start >= r)::INT, 1)) OVER (PARTITION BY u ORDER BY start, \"end\", id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS island FROM r")
def ep1(spark, d):
    return Q.islands(_responses(spark, d), ["u"], "start", "end", "id").select("id", "u", "island")


@query("ep2_epitopes")
def ep2(spark, d):
    r = Q.islands(_responses(spark, d), ["u"], "start", "end", "id")
    seq = F.array_join(F.transform(F.sequence(F.col("start"), F.col("end") - 1), lambda p: F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (p * 7 % 20 + 1).cast("int"), F.lit(1))), "")
    return Q.epitopes(r.withColumn("seq", seq), "u", "island", "id", "start", "end", "seq")


@query("set3_shared_coordinates", f"WITH {_I}, g AS (SELECT u, start // 16 AS b, max(start) AS s, min(\"end\") AS e FROM i GROUP BY 1, 2), n AS (SELECT u, b, count(DISTINCT p) AS n FROM (SELECT u, start // 16 AS b, unnest(range(start, \"end\")) AS p FROM i) GROUP BY 1, 2) SELECT u, b, CASE WHEN s < e THEN s END AS start, CASE WHEN s < e THEN e END AS \"end\", n AS union_size FROM g JOIN n USING (u, b)")
def set3(spark, d):
    return Q.shared_coordinates(_responses(spark, d).withColumn("b", F.floor(F.col("start") / 16)), ["u", "b"], "start", "end")


@query("hs2_hotspots", f"WITH {_S}, k AS (SELECT g, i::INT AS start, sum(CASE WHEN substr(seq, i::INT + 1, 1) = 'A' THEN 1.5 ELSE 0.25 END)::DOUBLE AS v FROM s, range(0, 8) r(i) GROUP BY 1, 2) SELECT g, (start + j)::INT AS site, round(sum(v), 4) AS score FROM k, range(0, 9) t(j) GROUP BY 1, 2")
def hs2(spark, d):
    k = Q.kmers(_seqs(spark, d), "id", "seq", 9, keep=["g"]).groupBy("g", "start").agg(F.sum(F.when(F.substring("kmer", 1, 1) == "A", 1.5).otherwise(0.25)).alias("v"))
    return rounded(Q.hotspots(k, "g", "start", "v", 9), 4)


@query("hs2_population", "WITH b AS (SELECT p_brand AS mer, p_type AS allele, avg(p_retailprice) AS ic50 FROM part GROUP BY 1, 2), f AS (SELECT p_type AS allele, count(*) / (SELECT count(*) FROM part) AS freq FROM part GROUP BY 1), h AS (SELECT mer, 1 - exp(2 * sum(ln(1 - freq))) AS share, count(*) AS alleles FROM b JOIN f USING (allele) WHERE ic50 < 1400 GROUP BY 1) SELECT mer, round(coalesce(share, 0), 6) AS share, coalesce(alleles, 0) AS alleles FROM (SELECT DISTINCT mer FROM b) LEFT JOIN h USING (mer)")
def hs2_pop(spark, d):
    p = load(spark, d, "part")
    n = p.count()
    b = p.groupBy(F.col("p_brand").alias("mer"), F.col("p_type").alias("allele")).agg(F.avg("p_retailprice").alias("ic50"))
    f = p.groupBy(F.col("p_type").alias("allele")).agg((F.count(F.lit(1)) / n).alias("freq"))
    return rounded(Q.population_binding(b, f, "mer", "allele", 1400), 6)
