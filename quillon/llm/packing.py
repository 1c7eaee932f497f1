"""Best-fit packing by exact-complement hashing over the histogram of lengths.

Pieces of equal length are alike, so the plan is made on the histogram of
lengths (as many entries as a sequence has tokens, whatever the input) and each
step of the plan is carried out as often as the counts allow. The longest length
left opens a sequence; an index of the sums of one, two and three lengths left tells
whether its gap can be filled exactly. If so, a combination that the counts allow is
taken; all are tried. If not, the best fit goes in and the index is asked for the
rest. Every step uses up a length, so a plan has at most a few times as many steps
as there are lengths.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._text import slices
from quillon.llm._tokens import ChunkEncoder
from quillon.session import shuffle_partitions, stage


class _Sums:
    """Which sums of two or three lengths left are there (a length may repeat); made when first asked for."""

    def __init__(self, counts: np.ndarray):
        self.size = 1 << int(3 * len(counts) - 1).bit_length()
        self.update(counts)

    def update(self, counts: np.ndarray) -> None:
        self.one = (counts > 0).astype(float)
        self._two = self._three = None

    def _sums(self, x: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.rfft(self.one, self.size) * np.fft.rfft(x, self.size), self.size)[: len(self.one)] > 0.5

    @property
    def two(self) -> np.ndarray:
        if self._two is None:
            self._two = self._sums(self.one)
        return self._two

    @property
    def three(self) -> np.ndarray:
        if self._three is None:
            self._three = self._sums(self.two.astype(float))
        return self._three


def _pair(left: np.ndarray, gap: int) -> tuple[int, int] | None:
    a = np.arange(1, gap // 2 + 1)
    good = (left[a] > 0) & (left[gap - a] > 0) & ((2 * a != gap) | (left[a] > 1))
    k = np.flatnonzero(good)
    return (int(a[k[0]]), gap - int(a[k[0]])) if len(k) else None


def _exact(left: np.ndarray, sums: _Sums, gap: int) -> tuple[int, ...] | None:
    if left[gap] > 0:
        return (gap,)
    if sums.two[gap] and (found := _pair(left, gap)):
        return found
    if not sums.three[gap]:
        return None
    third = np.arange(1, gap - 1)
    for c in third[(left[third] > 0) & sums.two[gap - third]][::-1].tolist():
        left[c] -= 1
        found = _pair(left, gap - c)
        left[c] += 1
        if found:
            return (*found, c)
    return None


def plan(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Steps ([(length, times), ...], repeats) that use up ``counts[length]``; index 0 is not used."""
    left = np.asarray(counts, np.int64).copy()
    cap = len(left) - 1
    sums, steps = _Sums(left), []
    for longest in range(cap, 0, -1):
        while left[longest] > 0:
            items: dict[int, int] = {longest: 1}
            left[longest] -= 1
            gap = cap - longest
            while gap > 0:
                found = _exact(left, sums, gap)
                if found is None:
                    fit = np.flatnonzero(left[: gap + 1] > 0)
                    if not len(fit):
                        break
                    found = (int(fit[-1]),)
                for x in found:
                    items[x] = items.get(x, 0) + 1
                    left[x] -= 1
                    gap -= x
            # `left` has the items of one sequence taken out; repeat while each has enough.
            more = min(int(left[x]) // t for x, t in items.items())
            for x, t in items.items():
                left[x] -= more * t
            if any(left[x] == 0 for x in items):
                sums.update(left)
            steps.append((list(items.items()), more + 1))
    return steps


def _segments(steps) -> dict[str, np.ndarray]:
    """Where the k-th piece of a length goes: rows (length, first rank, first sequence, offset), one for each place in a step."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for items, repeats in steps:
        offset = 0
        for x, t in items:
            for _ in range(t):
                rows.append((x, taken.get(x, 0), sequence, offset))
                taken[x] = taken.get(x, 0) + repeats
                offset += x
        sequence += repeats
    out = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": out[:, 0] << 44 | out[:, 1], "rank": out[:, 1], "sequence": out[:, 2], "offset": out[:, 3]}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' pieces: (id, piece, start, length, ids_crc32), written once."""

    def cut(batches):
        encoder = ChunkEncoder.shared(tokenizer, spaced)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for some in slices(batch, "text"):
                rows = {k: [] for k in ("id", "piece", "start", "length", "crc")}
                for i, raw in zip(some.column(0).to_pylist(), encoder.encode([t or "" for t in some.column(1).to_pylist()])):
                    raw += end
                    for k, at in enumerate(range(0, len(raw) // 4, capacity)):
                        part = raw[4 * at : 4 * (at + capacity)]
                        for name, x in (("id", i), ("piece", k), ("start", at), ("length", len(part) // 4), ("crc", zlib.crc32(part))):
                            rows[name].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[k], pa.int32() if k == "piece" else pa.int64()) for k in rows], names=list(rows))

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stage(given.mapInArrow(cut, "id long, piece int, start long, length long, crc long"))


def pack_pieces(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """``cut`` with (sequence_id, offset) for every row.

    Pieces of one length are numbered in slices by a hash, so that a length that
    many documents share is spread over tasks.
    """
    spark = cut.sparkSession
    parts = 4 * shuffle_partitions(spark)
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("id", "piece", "crc", F.monotonically_increasing_id() % 1024), F.lit(parts)).cast("int"))
    sliced = stage(sliced)
    counts = stage(sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `capacity` rows at most
        histogram[row["length"]] = row["n"]
    sent = spark.sparkContext.broadcast(_segments(plan(histogram)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("length", "slice", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("id", "piece", "crc"))
    ranked = sliced.withColumn("within", within).join(firsts, ["length", "slice"]).withColumn("rank", F.col("first") + F.col("within") - 1)

    def place(batches):
        s = sent.value
        for batch in batches:
            cols = {n: np.asarray(batch.column(k)) for k, n in enumerate(batch.schema.names) if n in ("length", "rank")}
            at = np.searchsorted(s["key"], cols["length"] << 44 | cols["rank"], "right") - 1
            out = [batch.column(k) for k in range(5)]
            out += [pa.array(s["sequence"][at] + cols["rank"] - s["rank"][at]), pa.array(s["offset"][at])]
            yield pa.RecordBatch.from_arrays(out, names=["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    return ranked.select("id", "piece", "start", "length", "crc", "rank").mapInArrow(place, "id long, piece int, start long, length long, crc long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of ``docs`` with its sequence and offset.

    A null or empty text is its end id alone. Rows that repeat an id are packed
    each; a null id stays null. Other columns are not read, so names cannot clash.
    An empty table gives an empty result. ``tokenizer`` is a path that every
    executor can open.
    """
    packed = pack_pieces(pieces(docs, tokenizer, capacity, end_id, spaced, id_col, text_col), capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
