"""Toxicity by a factorization machine over hashed terms.

A term is a lower-cased word or one of its leading parts of 3 to 8 bytes, by
64-bit hash, present or absent. From a bounded sample of labelled rows, the terms
are chosen that label 1 has far more often, or that tell the labels apart for certain in
either direction, however little; a factorization machine
then learns a weight for each and a vector for each, whose products are weights
of pairs (an insult beside a mention of a group, say).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import U64, buffers, prefix_sums, slices, span_hash, words
from quillon.session import discard, stage

PARTS = (3, 4, 5, 6, 7, 8)
_TABLE_BITS = 22

#: Letters (bytes of multi-byte letters too) and digits are words here.
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def _lower(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.lower() for t in texts.to_pylist()], pa.large_string())


def _terms(texts: pa.Array, wanted=None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every word and leading part, with repeats; only terms that ``wanted`` passes."""
    data, offsets = buffers(texts)
    starts, ends, rows = words(data, offsets, _GAP)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    sums = prefix_sums(data)
    got_rows, got = [], []
    for size in (None, *PARTS):
        if size is None:
            r, h = rows, span_hash(sums, starts, ends)
        else:
            long = ends - starts >= size
            s = starts[long]
            r, h = rows[long], span_hash(sums, s, s + size) ^ U64(size)
        if wanted is not None:
            keep = wanted(h)
            r, h = r[keep], h[keep]
        got_rows.append(r)
        got.append(h)
    return np.concatenate(got_rows), np.concatenate(got)


@dataclass
class FactorizationMachine:
    """Sorted term hashes with a weight and a vector each."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.hint = np.zeros(1 << _TABLE_BITS, bool)
        self.hint[(self.terms >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def _wanted(self, h: np.ndarray) -> np.ndarray:
        keep = self.hint[(h >> U64(64 - _TABLE_BITS)).astype(np.int64)]
        at = np.flatnonzero(keep)
        if len(at) and len(self.terms):
            found = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
            keep[at] = self.terms[found] == h[at]
        return keep

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, index of term)."""
        rows, h = _terms(_lower(texts), self._wanted)
        if not len(rows):
            return rows, rows
        both = np.unique(rows * np.int64(len(self.terms)) + np.searchsorted(self.terms, h))
        return both // len(self.terms), both % len(self.terms)

    def scores(self, n: int, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        linear = np.bincount(rows, weights=self.weights[at], minlength=n)
        pairs = np.zeros(n)
        for f in self.factors.T:
            v = f[at]
            pairs += np.bincount(rows, weights=v, minlength=n) ** 2 - np.bincount(rows, weights=v * v, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30)))

    def predict(self, texts: pa.Array) -> np.ndarray:
        return self.scores(len(texts), *self.present(texts))


def _term_counts(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, texts of label 1 with it, texts with it) of some texts."""
    rows, h = _terms(_lower(texts))
    order = np.lexsort((rows, h))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    rows, h = rows[new], h[new]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    ones = np.add.reduceat(labels[rows].astype(np.int64), first) if len(first) else first
    return h[first], ones, np.diff(np.append(first, len(h)))


def choose_terms(sample: DataFrame, most: int = 4000, least: int = 4) -> np.ndarray:
    """Sorted hashes of terms of at least ``least`` texts of ``sample(text, toxic)``: the ``most`` that lift label 1
    over twofold, and the ``most`` whose likelihood ratio is beyond what chance gives among so many, in either
    direction. The driver gets these alone, twice ``most`` at most."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, ones, n = _term_counts(part.column(0), np.asarray(part.column(1), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ones), pa.array(n)], names=["term", "ones", "n"])

    totals = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n1 = max(1, int(totals[0] or 0))
    n0 = max(1, int(totals[1]) - n1)
    counts = sample.mapInArrow(count, "term long, ones long, n long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    counts = stage(counts.where(F.col("n") >= least))
    terms, total = counts.count(), float(n1 + n0)
    part = lambda x, of, rate: x * F.log(F.greatest(x, F.lit(1e-9)) / F.greatest(of * rate, F.lit(1e-9)))
    x, n = F.col("ones").cast("double"), F.col("n").cast("double")
    apart = sum((part(y, n, k / total) + part(k - y, total - n, k / total) for y, k in ((x, n1), (n - x, n0))), F.lit(0.0))
    lift = (x + 0.5) / (n1 + 1) / ((n - x + 0.5) / (n0 + 1))
    rare = counts.where((x >= least) & (lift > 2)).orderBy((x * F.log(lift)).desc(), "term").limit(most)  # most of the clear words are rare
    sure = counts.where(apart > float(np.log(max(2, terms)))).orderBy(apart.desc(), "term").limit(most)
    chosen = [r["term"] for r in rare.union(sure).select("term").collect()]
    discard(counts)
    return np.unique(np.array(chosen, np.int64).view(U64))


def learn(terms: np.ndarray, rows: np.ndarray, at: np.ndarray, labels: np.ndarray, rates: tuple[float, float] = (1.0, 1.0), rank: int = 4, steps: int = 250, seed: int = 7) -> FactorizationMachine:
    """A factorization machine by Adam on the whole sample: text ``rows[i]`` has term ``at[i]``.

    ``rates`` are the sampling rates of labels 0 and 1, undone by weights.
    """
    labels = np.asarray(labels, float)
    rng = np.random.default_rng(seed)
    k, n = len(terms), len(labels)
    model = FactorizationMachine(terms, 0.0, np.zeros(k), rng.normal(0, 0.01, (k, rank)))
    if not n:
        model.bias = -3.0
        return model
    weight = np.where(labels > 0, 1 / rates[1], 1 / rates[0])
    weight /= weight.sum()
    share = float((weight * labels).sum())
    model.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    state = {name: [0.0, 0.0] for name in ("bias", "weights", "factors")}
    for step in range(1, steps + 1):
        sums = np.stack([np.bincount(rows, weights=f[at], minlength=n) for f in model.factors.T], axis=1) if k else np.zeros((n, rank))
        p = model.scores(n, rows, at)
        error = weight * (p - labels)
        e = error[rows]
        grads = {
            "bias": error.sum(),
            "weights": np.bincount(at, weights=e, minlength=k) + 1e-5 * model.weights,
            "factors": np.stack([np.bincount(at, weights=e * (sums[rows, f] - model.factors[at, f]), minlength=k) for f in range(rank)], axis=1) + 1e-4 * model.factors if k else model.factors,
        }
        for name, g in grads.items():
            m = state[name]
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            move = 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
            setattr(model, name, getattr(model, name) - move)
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, most: int, modulus: int = 4, held_out: int = 2) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most ``most`` labelled ids of each label, by hash order, without the held-out fold; and the labels' counts.

    Of the texts of a repeated id the least is taken.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        some = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text IS NOT NULL")
    return stage(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")), counts


def train(sample: DataFrame, counts: dict[int, int], terms: int = 4000) -> FactorizationMachine:
    """The machine of a bounded ``sample(text, toxic)``; ``counts`` are the labels' in all rows.

    The driver gets the chosen terms (``2 * terms`` at most) and, for each text of
    the sample, the places of those that it holds; texts stay with the tasks.
    """
    spark = sample.sparkSession
    chosen = choose_terms(sample, terms)
    sent = spark.sparkContext.broadcast(FactorizationMachine(chosen, 0.0, np.zeros(len(chosen)), np.zeros((len(chosen), 0))))

    def find(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, at = sent.value.present(part.column(0))
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
                found = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([found.cast(pa.list_(pa.int32())), part.column(1)], names=["at", "toxic"])

    got = sample.mapInArrow(find, "at array<int>, toxic int").toArrow()
    sent.destroy()
    lists = got.column("at").combine_chunks()
    labels = np.asarray(got.column("toxic").to_numpy(), int)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(lists)))]).astype(np.int64) if len(labels) else np.zeros(1, np.int64)
    at = np.asarray(lists.flatten()).astype(np.int64) if len(labels) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(labels)), np.diff(ends))
    rates = tuple(min(1.0, max(1, int((labels == k).sum())) / max(1, counts.get(k, 1))) for k in (0, 1))
    return learn(chosen, rows, at, labels, rates)


def fit(docs: DataFrame, labels: DataFrame, sample: int, terms: int) -> FactorizationMachine:
    rows, counts = sample_rows(docs, labels, sample)
    model = train(rows, counts, terms)
    discard(rows)
    return model


def score_documents(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score) of every whole text; a null or empty text gets the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        fm = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fm.predict(part.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 4000, terms: int = 4000) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Labels are learnt from at most ``sample`` rows of each label, none of the
    held-out fold (crc32 of the doc_id as text, modulo 4, is 2), by at most twice
    ``terms`` terms. Null and empty texts are scored by the bias; a null doc_id is not
    held out. Repeated rows are scored alike; conflicting labels of one doc_id
    count as 1. Without labelled rows of both kinds every score is low. An empty table
    gives an empty result. Other columns are not read.
    """
    model = fit(docs, labels, sample, terms)
    scored = score_documents(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 4000, terms: int = 4000) -> DataFrame:
    """``docs`` without the rows whose text scores at the threshold or above; all columns stay.

    Null and empty texts have the score of the bias; rows that repeat an id are judged
    each by its text. Without labelled rows, and for an empty table, nothing goes.
    Names of other columns do not matter.
    """
    model = fit(docs, labels, sample, terms)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                yield part.filter(pa.array(sent.value.predict(part.column(at)) < threshold))

    return docs.mapInArrow(keep, docs.schema)
