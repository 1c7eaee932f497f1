"""Source divergence audit: how far the words of a source depart from those of its language and of its other sources.

Counting runs over Arrow batches: words are encoded against a dictionary of their batch, so
only sums by (lang, source, term) are shuffled. What is kept of it, one row for each term of a group
(a posting), is written once.

The most divergent terms of a group are searched by upper bounds. A bucket holds the postings
of a group with the same count; their value is at most that of the bucket's least lang
probability. The first wave takes buckets by falling bound until they hold ``top`` terms, whose
``top``-th value is a threshold. The second takes every other bucket whose bound is not strictly below it; what
is left cannot enter the list, nor tie with its end.

Values of pairs of sources come from the postings alone. With f(a, b) the value of a term of counts a and b,

    sum f(a, b) = V f(0, 0) + sum over a > 0 of (f(a, 0) - f(0, 0)) + sum over b > 0 of (f(0, b) - f(0, 0))
                + sum over a, b > 0 of (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))

The two sums in the middle run over the buckets, the last over the postings of a term, which are dealt
into blocks of sources and summed by pair inside the tasks. All arithmetic is of integers, and decimals of 38 digits where a product may exceed 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._text import LOWER, buffers, slices, words
from quillon.session import discard, stage

SCALE = 1_000_000_000
#: Sources of a block of postings, about.
BLOCK = 256
#: Bytes that part terms: what is below 0x80 and no letter.
_PART = np.zeros(256, bool)
_PART[:0x80] = True
_PART[65:91] = _PART[97:123] = False
_COUNTS = "lang string, source string, term string, n long, docs long"
_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, for parts of a few megabytes of text."""
    for batch in batches:
        for part in slices(batch, "text", 8_000_000):
            data, offsets = buffers(part.column("text"))
            data = LOWER[data]
            starts, ends, row = words(data, offsets, _PART)
            if not len(starts):
                continue
            places = np.zeros(len(starts) + 1, np.int32)
            np.cumsum(ends - starts, out=places[1:])
            terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[~_PART[data]]))
            coded = terms.dictionary_encode()
            lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
            size, sources = len(coded.dictionary), len(source.dictionary)
            group = lang.indices.to_numpy().astype(np.int64) * sources + source.indices.to_numpy()
            by_doc, n = np.unique(row * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            key = group[by_doc // size] * size + by_doc % size
            order = np.argsort(key, kind="stable")
            found, first, docs = np.unique(key[order], return_index=True, return_counts=True)
            total = np.add.reduceat(n[order], first)
            g = found // size
            columns = [lang.dictionary.take(pa.array(g // sources)), source.dictionary.take(pa.array(g % sources)), coded.dictionary.take(pa.array(found % size)), pa.array(total.astype(np.int64)), pa.array(docs.astype(np.int64))]
            made = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)
            yield from (made.slice(k, 50_000) for k in range(0, made.num_rows, 50_000))


def _probability(n: Column, total: Column) -> Column:
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)")) + 1


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def postings(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, ln, lead): occurrences of each kept term by group and lang; ``lead`` marks one row of each (lang, term)."""
    counts = docs.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    every = counts.withColumn("ln", F.sum("n").over(term)).withColumn("ld", F.sum("docs").over(term))
    every = every.withColumn("lead", (F.row_number().over(term.orderBy("source")) == 1).cast("int"))
    return every.where(F.col("ld") >= least_docs).select("lang", "source", "term", "n", "ln", "lead")


def _groups(docs: DataFrame, post: DataFrame) -> DataFrame:
    """(lang, source, d, ld, v, terms): of every group the divisors of its probabilities and its lang's, and numbers of kept terms."""
    own = post.groupBy("lang", "source").agg(F.sum("n").alias("gn"), F.count(F.lit(1)).alias("terms"))
    of_lang = post.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("lead").alias("v"))
    every = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_docs"))
    every = every.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["gn", "terms", "total", "v"])
    return every.select("lang", "source", (F.col("gn") + F.col("v")).alias("d"), (F.col("total") + F.col("v")).alias("ld"), "v", "terms")


def _top_terms(post: DataFrame, buckets: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): best-first by buckets of ``post(lang, source, term, n, p, q)``."""
    group = Window.partitionBy("lang", "source")
    by_bound = buckets.where("above > 0").withColumn("bound", _value(F.col("p"), F.col("low")))
    before = F.sum("above").over(group.orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1))
    by_bound = by_bound.withColumn("before", F.coalesce(before, F.lit(0)))

    def best(chosen: DataFrame) -> DataFrame:
        rows = post.where("p > q").join(chosen.select("lang", "source", "n"), ["lang", "source", "n"])
        rows = rows.select("lang", "source", F.col("term").alias("item"), _value(F.col("p"), F.col("q")).alias("value"))
        return rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    first = stage(by_bound.where(F.col("before") < top))
    kth = best(first).where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
    second = stage(by_bound.join(kth, ["lang", "source"], "left").where("kth IS NULL OR bound >= kth").select("lang", "source", "n"))
    discard(first)
    return best(second)


_SUMS = "lang string, source string, item string, value long"
_SUMS_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by (lang, source, other source) of the last sum's terms, over rows (lang, a, b) of two blocks of a term's postings."""

    def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        ends = lists.value_lengths().to_numpy().astype(np.int64)
        return np.concatenate([[0], np.cumsum(ends)])[:-1], ends, lists.flatten()

    for batch in batches:
        (a0, an, a), (b0, bn, b) = flat(batch.column("a")), flat(batch.column("b"))
        work, at = np.cumsum(an * bn), 0
        names = pa.concat_arrays([a.field("source"), b.field("source")]).dictionary_encode()
        ids = names.indices.to_numpy().astype(np.int64)
        ia, ib, n_names = ids[: len(a)], ids[len(a) :], max(1, len(names.dictionary))
        lang = batch.column("lang").dictionary_encode()
        il = lang.indices.to_numpy().astype(np.int64)
        pa_, pb_, za, zb = (x.field(c).to_numpy() for x, c in ((a, "p"), (b, "p"), (a, "z"), (b, "z")))
        f = lambda x, y: (x - y) * (x - y) // y
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        while at < batch.num_rows:
            done = work[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(work, done + 1_000_000, "right")))
            size = (an * bn)[at:end]
            row = np.repeat(np.arange(at, end), size)
            k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            x, y = a0[row] + k // bn[row], b0[row] + k % bn[row]
            other = ia[x] != ib[y]
            x, y, row = x[other], y[other], row[other]
            value = f(pa_[x], pb_[y]) - f(pa_[x], zb[y]) - f(za[x], pb_[y]) + f(za[x], zb[y])
            key = (il[row] * n_names + ia[x]) * n_names + ib[y]
            order = np.argsort(key, kind="stable")
            found, first = np.unique(key[order], return_index=True)
            if len(found):
                sums.append((found, np.add.reduceat(value[order], first)))
            at = end
        if not sums:
            continue
        key, value = (np.concatenate(c) for c in zip(*sums))
        order = np.argsort(key, kind="stable")
        found, first = np.unique(key[order], return_index=True)
        value = np.add.reduceat(value[order], first)
        g = found // n_names
        columns = [lang.dictionary.take(pa.array(g // n_names)), names.dictionary.take(pa.array(g % n_names)), names.dictionary.take(pa.array(found % n_names)), pa.array(value)]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _SUMS_SCHEMA.types)], schema=_SUMS_SCHEMA)


def _pairs(post: DataFrame, buckets: DataFrame, groups: DataFrame, most_sources: int) -> DataFrame:
    """(lang, source, item, value, rank) of all ordered pairs of sources of a lang."""
    one = groups.select("lang", "source", "v", "terms", F.when(F.col("v") > 0, _probability(F.lit(0).cast("long"), F.when(F.col("v") > 0, F.col("d")))).alias("z"))
    two = one.select("lang", F.col("source").alias("item"), F.col("terms").alias("terms2"), F.col("z").alias("z2"))
    base = one.join(two, "lang").where("source <> item")
    # V f(0, 0), and its part of the sums over a > 0 and over b > 0
    base = base.select("lang", "source", "item", F.coalesce((F.col("v") - F.col("terms") - F.col("terms2")) * _value(F.col("z"), F.col("z2")), F.lit(0).cast("long")).alias("value"))
    alone = buckets.select("lang", "source", "size", "p", "z").join(two, "lang").where("source <> item")
    size, p, z2 = F.col("size"), F.col("p"), F.col("z2")
    ways = F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), (size * _value(p, z2)).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (size * _value(z2, p)).alias("value")),
    )
    alone = alone.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")
    blocks = max(1, -(-most_sources // BLOCK))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block")
    lists = post.groupBy("lang", "term", block).agg(F.collect_list(F.struct("source", "p", "z")).alias("a"))
    if blocks == 1:
        both = lists.where(F.size("a") > 1).select("lang", "a", F.col("a").alias("b"))
    else:
        both = lists.select("lang", "term", "a").join(lists.select("lang", "term", F.col("a").alias("b")), ["lang", "term"]).select("lang", "a", "b")
    sums = base.unionByName(alone).unionByName(both.mapInArrow(_pair_sums, _SUMS)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence_audit(docs: DataFrame, top: int = 200, least_docs: int = 3) -> DataFrame:
    """(lang, source, part, item, value, rank): for each (lang, source) group the ``pair`` rows of every other
    source of its lang and the ``term`` rows of its ``top`` most divergent terms.

    Null texts, langs and sources are empty strings. A group without kept terms has pairs but no terms; in a lang without
    kept terms all values are 0. Equal values are in the UTF-8 order of their items. Every row is a document
    of its own, also where it repeats another. An empty table gives an empty result; other columns are not read. A long text
    is counted as a whole, in memory in proportion to it.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    post = stage(postings(docs, least_docs))
    groups = stage(_groups(docs.select("lang", "source"), post))
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    known = post.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", _probability(F.col("n"), F.col("d")).alias("p"), _probability(F.lit(0).cast("long"), F.col("d")).alias("z"), _probability(F.col("ln"), F.col("ld")).alias("q"))
    buckets = known.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.first("z").alias("z"), F.count(F.lit(1)).alias("size"), F.min("q").alias("low"), F.sum((F.col("p") > F.col("q")).cast("long")).alias("above"))
    buckets = stage(buckets)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(_pairs(known, buckets, groups, most), "pair").unionByName(columns(_top_terms(known, buckets, top), "term"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
kl AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, coalesce(c.n, 0)::HUGEINT AS n, ln FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
probs AS (SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 1)) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + v) AS p,
    1 + (1000000000::HUGEINT * (ln + 1)) // (total + v) AS q
  FROM cells JOIN kl USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM probs WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM allpairs
UNION ALL SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms
QUALIFY rank <= 200
"""
