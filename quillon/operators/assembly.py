"""Assembly of overlapping peptides without given starts (SQ16).

Overlaps come of a join of k-mers with prefixes. They are taken greedily, the longest first: a round takes every overlap that no better
one at either of its ends forbids, which is what one sorted pass would take. Chains get their starts by pointer jumps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.models import components
from quillon.operators.sequences import assemble, kmers
from quillon.session import discard, stage


def overlaps(peptides: DataFrame, group: str, key: str, seq: str, least: int) -> DataFrame:
    """(group, a, b, at, overlap): where b's first ``least`` residues start in a at ``at`` and both agree to the end of one.

    ``overlap`` is their common length; that of all of b means that a contains it. A row for each such place of two keys.
    """
    if least < 1:
        raise ValueError("an overlap has at least one residue")
    long = peptides.where(F.length(seq) >= least)
    ends = kmers(long, key, seq, least, keep=[group]).join(long.select(group, key, F.col(seq).alias("_s")), [group, key])
    ends = ends.select(group, F.col(key).alias("a"), F.col("start").alias("at"), "kmer", F.expr("substring(_s, start + 1)").alias("_end"))
    heads = long.select(group, F.col(key).alias("b"), F.substring(seq, 1, least).alias("kmer"), F.col(seq).alias("_b"))
    both = ends.join(heads, [group, "kmer"]).where("a <> b")
    common = F.least(F.length("_end"), F.length("_b"))
    return both.where("startswith(_end, _b) OR startswith(_b, _end)").select(group, "a", "b", "at", common.alias("overlap"), (F.length("_b") == common).alias("_whole"))


def _greedy(edges: DataFrame, group: str) -> DataFrame:
    """Of edges (group, a, b, overlap) those that a pass over them takes, by overlap (longest first), a and b, an end once each."""
    order = F.struct((-F.col("overlap")).alias("o"), "a", "b")
    chosen, left = [], stage(edges)
    while True:
        best = left.withColumn("_o", order)
        for end in ("a", "b"):
            best = best.withColumn(f"_{end}", F.min("_o").over(Window.partitionBy(group, end)))
        chosen.append(stage(best.where("_o = _a AND _o = _b").select(left.columns)))
        if not chosen[-1].limit(1).count():
            discard(left)
            break
        rest = left.join(chosen[-1].select(group, "a"), [group, "a"], "left_anti").join(chosen[-1].select(group, "b"), [group, "b"], "left_anti")
        rest, old = stage(rest), left
        discard(old)
        left = rest
    out = stage(reduce(DataFrame.unionByName, chosen))
    discard(*chosen)
    return out


def _opened(links: DataFrame, group: str) -> DataFrame:
    """Links without the weakest one (shortest overlap, then the largest keys) of each ring."""
    node = lambda end: F.struct(group, F.col(end).alias("k"))
    named = components(links.select(node("a").alias("u"), node("b").alias("v")))
    of = links.withColumn("id", node("a")).join(named, "id")
    nodes = named.groupBy("component").agg(F.count(F.lit(1)).alias("_nodes"))
    last = of.groupBy("component").agg(F.count(F.lit(1)).alias("_links"), F.max(F.struct((-F.col("overlap")).alias("o"), "a", "b")).alias("_w"))
    ring = last.join(nodes, "component").where("_links = _nodes").select(F.col(f"component.{group}").alias(group), F.col("_w.a").alias("a"), F.col("_w.b").alias("b"))
    return links.join(ring, [group, "a", "b"], "left_anti")


def placements(df: DataFrame, group: str, key: str, seq: str, least: int) -> DataFrame:
    """(group, key, seq, contig, start): each peptide's chain, named by its first peptide's key, and its place from 0 there.

    Peptides of one sequence are placed together, by the smallest key. One that another contains is placed inside it: in the longest
    such, of the smallest key, at its first place. The others are chained by exact overlaps of ``least`` or more, the longest
    first, ties by the keys; a ring is opened at its weakest overlap. Peptides shorter than ``least`` or without overlap are chains of their
    own. Rows with a null group, key or sequence, or an empty one, are left out. Keys must be unique in a group.
    """
    rows = stage(df.select(group, key, seq).where(F.col(group).isNotNull() & F.col(key).isNotNull() & (F.col(seq) != "")))
    one = stage(rows.groupBy(group, seq).agg(F.min(key).alias(key)))
    found = stage(overlaps(one, group, key, seq, least))
    inner = found.where("_whole").select(group, F.col("b").alias(key)).distinct()
    outer = found.where("_whole").join(inner.select(group, F.col(key).alias("a")), [group, "a"], "left_anti").join(one.select(group, F.col(key).alias("a"), F.length(seq).alias("_l")), [group, "a"])
    inside = outer.groupBy(group, F.col("b").alias(key)).agg(F.min(F.struct((-F.col("_l")).alias("l"), "a", "at")).alias("_in")).select(group, key, F.col("_in.a").alias("_a"), F.col("_in.at").alias("_at"))
    tops = one.join(inner, [group, key], "left_anti")
    free = lambda end: inner.select(group, F.col(key).alias(end))
    edges = found.where("NOT _whole AND at > 0").join(free("a"), [group, "a"], "left_anti").join(free("b"), [group, "b"], "left_anti")
    edges = edges.groupBy(group, "a", "b").agg(F.max("overlap").alias("overlap"), F.min("at").alias("at"))
    links = _greedy(edges, group)
    chain = stage(_opened(links, group))
    # the peptide before and the steps from it, then twice as far a round
    state = stage(tops.select(group, key).join(chain.select(group, F.col("b").alias(key), "a", "at"), [group, key], "left").select(group, key, F.coalesce("a", key).alias("contig"), F.coalesce("at", F.lit(0)).alias("start")))
    while True:
        back = state.select(group, F.col(key).alias("contig"), F.col("contig").alias("_c"), F.col("start").alias("_s"))
        new = stage(state.join(back, [group, "contig"]).select(group, key, F.col("_c").alias("contig"), (F.col("start") + F.col("_s")).alias("start"), (F.col("contig") != F.col("_c")).alias("_moved")))
        discard(state)
        state = new
        if not new.where("_moved").limit(1).count():
            break
    at_tops = state.select(group, key, "contig", "start")
    at_inner = inside.join(at_tops.withColumnRenamed(key, "_a"), [group, "_a"]).select(group, key, "contig", (F.col("start") + F.col("_at")).alias("start"))
    out = rows.join(at_tops.unionByName(at_inner).join(one, [group, key]).drop(key), [group, seq]).select(group, key, seq, "contig", "start")
    placed = stage(out)
    discard(rows, one, found, links, chain, state)
    return placed


def assemble_overlapping(df: DataFrame, group: str, key: str, seq: str, least: int = 8) -> DataFrame:
    """(group, contig, seq, peptides): the sequences that the peptides of placements() spell, and how many rows each holds."""
    placed = placements(df, group, key, seq, least)
    whole = F.struct(F.col(group).alias("g"), F.col("contig").alias("c")).alias("_id")
    texts = assemble(placed.select(whole, "start", seq).distinct(), "_id", "start", seq).drop("conflicts")
    return texts.join(placed.groupBy(whole).agg(F.count(F.lit(1)).alias("peptides")), "_id").select(F.col("_id.g").alias(group), F.col("_id.c").alias("contig"), "seq", "peptides")
