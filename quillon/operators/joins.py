"""Join shapes that need a decision beyond the optimizer's (J1-J20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import shuffle_partitions, stage


def left_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Left equi-join; the right side's other columns get the suffix."""
    return left.join(right.select(*keys, *(F.col(c).alias(c + suffix) for c in right.columns if c not in keys)), keys, "left")


def inner_suffixed(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Key-aligned inner join with ``_A`` and ``_B`` on the other columns."""
    side = lambda x, s: x.select(key, *(F.col(c).alias(c + s) for c in x.columns if c != key))
    return side(a, "_A").join(side(b, "_B"), key)


def outer_all(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Chain of full outer joins on the keys."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, "full_outer")
    return out


def with_totals(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Detail beside its group's total: a window in place of aggregate and join back."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))


def left_zero(groups: DataFrame, counts: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Groups with counts, zero where there are none."""
    return groups.join(counts, key, "left").na.fill(0, names)


def paired(df: DataFrame, unit: str, category: str, value: str) -> DataFrame:
    """A unit's values under two categories, once for each pair of categories."""
    a = df.select(unit, F.col(category).alias("cat_a"), F.col(value).alias("value_a"))
    b = df.select(unit, F.col(category).alias("cat_b"), F.col(value).alias("value_b"))
    return a.join(b, unit).where("cat_a < cat_b")


def match_substring(files: DataFrame, samples: DataFrame, file: str, sample: str) -> DataFrame:
    """Files with the sample whose name they contain; only where the match is one to one.

    A file meets a sample by its substrings as long as some sample's name, so the join has a key; equal files and equal samples meet once,
    with their number of rows.
    """
    f = files.where(F.col(file).isNotNull()).groupBy(F.col(file).alias("_f")).agg(F.count(F.lit(1)).alias("_nf"))
    s = samples.where(F.col(sample).isNotNull()).groupBy(F.col(sample).alias("_s")).agg(F.count(F.lit(1)).alias("_ns"))
    lengths = F.broadcast(s.select(F.length("_s").alias("_l")).distinct())  # as many as names have lengths
    places = F.when(F.col("_l") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length("_f") - F.col("_l") + 1))
    cut = f.join(lengths, F.length("_f") >= F.col("_l")).select("_f", "_nf", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("_f"), i, F.col("_l"))))).alias("_s"))
    hits = stage(cut.join(s, "_s").select("_f", "_s", (F.col("_nf") * F.col("_ns")).alias("_n")))
    one = lambda c: hits.groupBy(c).agg(F.sum("_n").alias("_all")).where("_all = 1").select(c)
    pairs = hits.join(one("_f"), "_f").join(one("_s"), "_s").select("_f", "_s")
    return files.join(pairs, F.col(file) == F.col("_f")).join(samples, F.col("_s") == F.col(sample)).select(*(files[c] for c in files.columns), *(samples[c] for c in samples.columns))


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str], bin_size: int) -> DataFrame:
    """Pairs of [start, end) intervals of equal keys that overlap.

    Each interval goes to the bins it touches; a pair meets in the bin of its
    later start alone, so it appears once, and the join is an equi-join on key and bin.
    Columns of ``a`` keep their names, those of ``b`` get ``_b``.
    """
    bins = lambda df: df.where(F.col("start") < F.col("end")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    right = bins(b).select(*(F.col(c).alias(c if c in (*keys, "_bin") else c + "_b") for c in [*b.columns, "_bin"]))
    pairs = bins(a).join(right, [*keys, "_bin"]).where((F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end")))
    return pairs.where(F.col("_bin") == F.floor(F.greatest("start", "start_b") / bin_size)).drop("_bin")


def near_pairs(df: DataFrame, key: str, value: str, radius: float, by: list[str] = ()) -> DataFrame:
    """(key, key_b, d) of rows whose values differ by at most ``radius``, both orders: an equi-join on bins of that width."""
    cell = range_column(F.col(value), radius)
    left = df.select(*by, key, F.col(value).alias("_v"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"))
    right = df.select(*by, F.col(key).alias(key + "_b"), F.col(value).alias("_w"), cell.alias("_c"))
    return left.join(right, [*by, "_c"]).withColumn("d", F.abs(F.col("_v") - F.col("_w"))).where((F.col("d") <= radius) & (F.col(key) != F.col(key + "_b"))).select(*by, key, key + "_b", "d")


#: Rows of a group that block_pairs() joins with as many at a time.
BLOCK = 2048


def block_pairs(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Pairs of rows of equal ``by`` with key < key_b; right columns get ``_b``.

    A group's rows fall into blocks of about BLOCK by a hash of the key, and each two blocks meet in a task of their own: a row is sent once for
    each block of its group, no task gets a whole group, and few rows that make many pairs are spread over all tasks.
    """
    n = shuffle_partitions(df.sparkSession)
    rows = df.where(F.col(key).isNotNull())
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    rows = rows.join(sizes, by) if by else rows.crossJoin(F.broadcast(sizes))
    rows = rows.withColumn("_k", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o")
    at = [*by, "_p", "_q"]
    names = [c for c in df.columns if c not in by]
    left = rows.select(*by, *names, "_k", other).where("_k <= _o").select(*by, *names, F.col("_k").alias("_p"), F.col("_o").alias("_q")).repartition(n, *at)
    right = rows.select(*by, *(F.col(c).alias(c + "_b") for c in names), "_k", other).where("_o <= _k").select(*by, *(c + "_b" for c in names), F.col("_o").alias("_p"), F.col("_k").alias("_q")).repartition(n, *at)
    met = left.hint("merge").join(right, at).where((F.col("_p") < F.col("_q")) & (F.col(key) != F.col(key + "_b")) | (F.col(key) < F.col(key + "_b")))
    swap = F.col(key) > F.col(key + "_b")  # of two blocks either may hold the lesser key
    return met.select(*by, *(F.when(swap, F.col(c + "_b")).otherwise(F.col(c)).alias(c) for c in names), *(F.when(swap, F.col(c)).otherwise(F.col(c + "_b")).alias(c + "_b") for c in names))


def all_pairs(df: DataFrame, key: str, by: list[str], symmetric: bool = True) -> DataFrame:
    """Pairs of rows within a group (all of it if ``by`` is empty), i < j if symmetric; right columns get ``_b``."""
    if symmetric:
        return block_pairs(df, key, by)
    right = df.select(*(F.col(c).alias(c if c in by else c + "_b") for c in df.columns))
    return df.join(right, by) if by else df.crossJoin(right)


def maximal_sets(sets: DataFrame, key: str, items: str) -> DataFrame:
    """Sets that no other set contains (of equal sets the smallest key stays); items come sorted.

    Equal sets become one first. Candidates are found by the set's rarest item, so
    sets without a common item never meet and a frequent item brings few together.
    """
    distinct = sets.groupBy(items).agg(F.min(key).alias(key))
    each = distinct.select(F.col(items).alias("_s2"), F.explode(items).alias("_x"))
    often = each.groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    probe = distinct.select(items, F.explode(items).alias("_x")).join(often, "_x").groupBy(items).agg(F.min_by("_x", F.struct("_n", "_x")).alias("_x"))
    inside = probe.join(each, "_x").where((F.size("_s2") > F.size(items)) & (F.size(F.array_except(items, "_s2")) == 0))
    return distinct.join(inside.select(items).distinct(), items, "left_anti").select(key, items)


def align_last(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """Both series on the union of their times, each value carried forward (as-of)."""
    grid = left.select(*by, time).unionByName(right.select(*by, time)).distinct()
    out = grid.join(left, [*by, time], "left").join(right, [*by, time], "left")
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """Left rows with the right values of the latest time at or before theirs: one shuffle of the union, no range join."""
    side = F.lit(0).alias("_left")
    r = right.select(*by, time, *values, side)
    a = left.withColumn("_row", F.lit(1))
    names = [c for c in left.columns if c not in (*by, time)]
    union = a.select(*by, time, *names, F.lit(1).alias("_left")).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return union.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values}).where("_left = 1").drop("_left")


def range_column(column: Column, size: float) -> Column:
    return F.floor(column / size).cast("long")
