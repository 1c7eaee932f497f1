"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

Vectors of equal bits form a class, so copies cost one vector. Each class is
rotated (three rounds of random signs and a Hadamard transform) K times a table;
its code is the K nearest signed axes, and its probes also take the second
nearest axis in one rotation each. Classes that share a code in a table meet in
its bucket, where their cosines are computed in double precision as a block
product. A pair that meets in several buckets counts in the first alone. A bucket
with many classes is cut into blocks, every pair of which is one group. Groups
return counts and tree edges, not pairs.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components, join_classes
from quillon.session import discard, share_code, shuffle_partitions, stage

TABLES = 8
ROTATIONS = 3
BLOCK = 1024
SMALL = 64  # classes of a bucket that shares a group with others
SEED = 20
CHUNK = 2000  # rows for each group of small buckets


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, a power of two long."""
    n, h = x.shape[-1], 1
    while h < n:
        x = x.reshape(*x.shape[:-1], n // (2 * h), 2, h) if x.ndim == 2 else x
        a, b = x[:, :, 0, :], x[:, :, 1, :]
        x = np.stack([a + b, a - b], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(unit: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, seed: int = SEED) -> np.ndarray:
    """(n, tables, 1 + rotations) bucket codes of unit vectors: the nearest axes, then the probes."""
    n, dim = unit.shape
    wide = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :dim] = unit
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables, 1 + rotations), np.int64)
    at = np.arange(n)
    for t in range(tables):
        best, second = [], []
        for _ in range(rotations):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], wide))
            size = np.abs(x)
            top = np.argmax(size, axis=1)
            best.append(2 * top + (x[at, top] < 0))
            size[at, top] = -1
            top = np.argmax(size, axis=1)
            second.append(2 * top + (x[at, top] < 0))
        join = lambda parts: sum(p.astype(np.int64) * (2 * wide) ** k for k, p in enumerate(parts))
        out[:, t, 0] = join(best)
        for k in range(rotations):
            out[:, t, 1 + k] = join([*best[:k], second[k], *best[k + 1 :]])
    return out


def _vectors(values: pa.Array) -> list[np.ndarray | None]:
    """Per row the vector in double precision, or None if it links with nothing."""
    out = []
    for v in values:
        v = v.as_py()
        if not v or any(x is None for x in v):
            out.append(None)
            continue
        x = np.array(v, np.float64)
        norm = np.linalg.norm(x) if np.isfinite(x).all() else 0.0
        if norm and not np.isfinite(norm):
            x = x / np.abs(x).max()
        out.append(x if norm and np.any(x) else None)
    return out


def _hash_table(vectors: DataFrame, tables: int, rotations: int, seed: int) -> DataFrame:
    def build(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                given = _vectors(part.column(1))
                raw = [None if x is None else x.tobytes() for x in given]
                coded: list[bytes | None] = [None] * len(given)
                for dim in {len(x) for x in given if x is not None}:
                    rows = [k for k, x in enumerate(given) if x is not None and len(x) == dim]
                    x = np.stack([given[k] for k in rows])
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for k, c in zip(rows, codes(x, tables, rotations, seed)):
                        coded[k] = c.tobytes()
                fp = [None if x is None else blake2b(x, digest_size=16).digest() for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, pa.binary()) for c in (fp, raw, coded))], names=["id", "fp", "vec", "codes"])

    return stage(vectors.mapInArrow(build, "id long, fp binary, vec binary, codes binary"))


def _bucket_rows(reps: DataFrame) -> DataFrame:
    """(bucket, id): one row for each code of each class."""

    def expand(batches):
        for batch in batches:
            raw, ids = batch.column(1).to_pylist(), np.asarray(batch.column(0))
            if not len(ids):
                continue
            c = np.frombuffer(b"".join(raw), "<i8").reshape(len(ids), TABLES, -1) ^ (np.arange(TABLES)[None, :, None] << 56)
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(np.repeat(ids, c[0].size))], names=["bucket", "id"])

    return reps.select("id", "codes").mapInArrow(expand, "bucket long, id long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) per row.

    n_links counts the other rows linked directly. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, as do vectors
    of other lengths. Rows of a null id are left out. Rows that repeat an id
    count each, by their own vectors. Other columns are not read. An empty table
    gives an empty result.
    """
    share_code(vectors.sparkSession)
    table = _hash_table(vectors.select(F.col(id_col).cast("long"), vector_col).where(F.col(id_col).isNotNull()), TABLES, ROTATIONS, SEED)
    # Classes of equal bits, by a key of their own: ids may repeat. Equal bits have equal codes.
    classes = table.where("fp IS NOT NULL").groupBy("fp").agg(F.min(F.struct("id", "vec", "codes")).alias("r"), F.count(F.lit(1)).alias("size"))
    reps = stage(classes.select("fp", F.col("r.id").alias("rep"), "r.vec", "r.codes", "size").withColumn("id", F.monotonically_increasing_id()))
    total = reps.agg(F.sum("size")).first()[0] or 0
    rows = stage(_bucket_rows(reps))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Small buckets share groups, as many as the rows ask for, so that a task handles many of them at once;
    # a large bucket has groups of its own, one for each pair of its blocks.
    chunks = max(4 * shuffle_partitions(vectors.sparkSession), total // CHUNK)
    large = F.col("n") > SMALL
    dealt = (
        rows.join(full, "bucket")
        .withColumn("gk", F.when(large, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("bucket"), F.lit(chunks))))
        .withColumn("parts", F.when(large, F.ceil(F.col("n") / block)).otherwise(1).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("gk", "bucket", "id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )

    def compare(group: pa.Table) -> pa.Table:
        small = group.column("gk")[0].as_py() < 0
        same_block = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        bucket, own, ids, sizes = (np.asarray(group.column(c)) for c in ("bucket", "own", "id", "size"))
        raw, coded = group.column("vec").to_pylist(), group.column("codes").to_pylist()
        dims = np.array([len(r) for r in raw])
        counts, edges = {}, [np.zeros((2, 0), np.int64)]
        for dim in np.unique(dims):
            rows_ = np.flatnonzero(dims == dim)
            if small:
                rows_ = rows_[np.argsort(bucket[rows_], kind="stable")]
            x = np.frombuffer(b"".join(raw[k] for k in rows_), "<f8").reshape(len(rows_), -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            c = np.frombuffer(b"".join(coded[k] for k in rows_), "<i8").reshape(len(rows_), TABLES, -1)
            at, j, s = bucket[rows_], ids[rows_], sizes[rows_]
            for a, b in _run_pairs(at, x, threshold) if small else _block_pairs(own[rows_], same_block, x, threshold):
                a, b = _first_meeting(a, b, at, c)
                for p, q in ((a, b), (b, a)):
                    near = np.bincount(p, weights=s[q], minlength=len(rows_))
                    for k in np.flatnonzero(near).tolist():
                        counts[int(j[k])] = counts.get(int(j[k]), 0) + int(near[k])
                edges.append(np.stack([j[a], j[b]]))
        u, v = np.concatenate(edges, axis=1)
        tree = _forest(u, v)
        return pa.table({
            "id": pa.array([*counts, *[e[0] for e in tree]], pa.int64()),
            "near": pa.array([*counts.values(), *[0] * len(tree)], pa.int64()),
            "to": pa.array([*[None] * len(counts), *[e[1] for e in tree]], pa.int64()),
        })

    found = stage(dealt.join(reps.select("id", "size", "vec", "codes"), "id").groupBy("gk", "lo", "hi").applyInArrow(compare, "id long, near long, to long"))
    comps = components(found.where("to IS NOT NULL").select(F.col("id").alias("u"), F.col("to").alias("v")))
    near = found.where("to IS NULL").groupBy("id").agg(F.sum("near").alias("near"))
    labels = comps.join(reps.select("id", "rep"), "id")
    least = labels.groupBy("component").agg(F.min("rep").alias("least"))
    labels = labels.join(least, "component").select("id", "least")
    known = stage(reps.select("id", "fp", "rep", "size").join(near, "id", "left").join(labels, "id", "left").drop("id"))
    discard(rows, found)
    out = join_classes(table.select("id", "fp"), known, "fp", total)
    component = F.coalesce("least", "rep", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("size") - 1 + F.coalesce("near", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("id")).alias("kept"),
    )


def _run_pairs(bucket: np.ndarray, x: np.ndarray, threshold: float):
    """Pairs of rows of one bucket with a cosine at the threshold or above; rows come sorted by bucket."""
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)) if len(bucket) else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, len(bucket)))
    for m in np.unique(runs[runs > 1]).tolist():
        i, j = np.triu_indices(m, 1)
        starts = first[runs == m]
        step = max(1, 100_000 // len(i))
        for k in range(0, len(starts), step):
            a, b = ((starts[k : k + step, None] + r).ravel() for r in (i, j))
            good = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            yield a[good], b[good]


def _block_pairs(own: np.ndarray, same_block: bool, x: np.ndarray, threshold: float):
    """As _run_pairs() within one block (or across two) of one bucket."""
    for at in range(0, len(x), 512):
        a, b = np.nonzero(x[at : at + 512] @ x.T >= threshold)
        a += at
        keep = (a < b) & ((own[a] != own[b]) | same_block)
        yield a[keep], b[keep]


def _first_meeting(a: np.ndarray, b: np.ndarray, bucket: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs for which their bucket is the first that both share."""
    for t in range(c.shape[1]):
        mine = bucket[a] >> 56
        same = c[a, t][:, :, None] == c[b, t][:, None, :]
        least = np.where(same, c[a, t][:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2)) if len(a) else mine
        keep = np.where(mine > t, ~same.any(axis=(1, 2)), (mine < t) | (((t << 56) ^ least) == bucket[a]))
        a, b = a[keep], b[keep]
    return a, b


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest: as many as ids, whatever the number of pairs."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for a, b in zip(u.tolist(), v.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((min(a, b), max(a, b)))
    return out
