"""N-gram Jaccard self-join by rare-first prefix filtering.

A text's set is its distinct word shingles. Two texts link when the Jaccard
similarity of their sets reaches a threshold. The stages:

1.  One pass counts every shingle of every document in a count sketch of fixed
    size (a documented parameter); its logarithms, a few MB at any input, order
    the shingles rare first. Any fixed order is correct; this one keeps passages
    that many documents share out of the prefixes.
2.  A second pass writes per document its set's fingerprint, its prefix and a
    histogram of the set with a bin for every two to four shingles. Documents of
    equal sets form a class, which one document stands for.
3.  Prefix shingles are dealt by hash range. In a shingle's bucket each class is
    compared with the bucket's centre. Length and positional filters go first; then the
    suffix filter, which bounds the overlap by the smaller count in each bin; texts
    are fetched only for what is left, and each pair is verified once on the
    whole sets. A class is first compared with the centre that it shares most with.
    Classes that link share a component, so their other pairs need no
    comparison: a group of n near copies costs about n pairs, not n squared.
4.  Buckets that still span components: the classes outside the centre's component
    are compared with all the others, in blocks, by the same filters, so no link
    between components is lost. No candidate is capped.

A shingle that very many classes hold in their prefixes is dealt to several tasks,
which agree on one centre.

Sets and fingerprints are of 64-bit hashes: distinct shingles of one hash count as
one. For chance texts that is about one in 10 ** 13 pairs of shingles of a
document pair; texts made to collide are not guarded against.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from hashlib import blake2b
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import U64, mix, shingles, slices
from quillon.llm.components import components, join_classes
from quillon.session import discard, share_code, shuffle_partitions, stage

SKETCH_BITS = 21
SLICES = 16
BLOCK = 1024  # classes of a block
BLOCK_SHINGLES = 2_000_000
TASK_ROWS = 4096  # rows of blocks for a task
RANGE_TOKENS = 4_000_000  # prefix shingles of a task
HOT = 20  # log2 of the holders, over the mean of a cell of the sketch, from which a shingle is dealt to several tasks
TOKEN_BYTES = 5
BITMAP_BITS = 24


def _set_batches(batches, size):
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, shingles(part.column(part.schema.get_field_index("text")), size)


def count_sketch(docs: DataFrame, size: int = 5, bits: int = SKETCH_BITS) -> np.ndarray:
    """Quantised log2 counts of shingles by their top ``bits`` bits, over all documents.

    Each task adds up its own table; tables are summed by slice, as streams. The
    driver gets 2**bits bytes, whatever the input.
    """
    width = (1 << bits) // SLICES

    def count(batches):
        total, some = np.zeros(1 << bits, np.int64), False
        for _, sets in _set_batches(batches, size):
            some = True
            h = np.concatenate(sets) if sets else np.zeros(0, U64)
            np.add.at(total, (h >> U64(64 - bits)).astype(np.int64), 1)
        if some:
            pack = zstandard.ZstdCompressor(level=1)
            blobs = [pack.compress(total[k * width : (k + 1) * width].tobytes()) for k in range(SLICES)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array(blobs, pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zstandard.decompress(blob.as_py()), np.int64)
                sums[k] = sums[k] + part if k in sums else part.copy()
        if sums:
            logs = [np.ceil(np.log2(v + 1)).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "logs": pa.array(logs, pa.binary())})

    parts = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, logs binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for row in parts:
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["logs"], np.uint8)
    return out


def _pack(h: np.ndarray) -> bytes:
    """The top 40 bits of each hash: prefix keys; a clash only adds a candidate."""
    return (h >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    wide[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.view("<i8").ravel()


def _histogram(h: np.ndarray) -> bytes:
    """Counts of a set's shingles by the top bits of a mixed hash, in a power of two of bins."""
    bits = max(4, len(h).bit_length() - 2)
    counts = np.bincount((mix(h) >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _fold(bins: np.ndarray, size: int) -> np.ndarray:
    """A histogram in ``size`` bins, which are fewer or as many; int16 (a bin of 255 may hold more: it bounds nothing)."""
    wide = bins.astype(np.int32)
    wide[bins == 255] = 1 << 20
    return wide.reshape(size, -1).sum(axis=1)


def set_table(docs: DataFrame, threshold: Fraction, size: int, logs: np.ndarray, bits: int) -> DataFrame:
    """Per row of ``docs(id, text)``: id, th (hash of the text), n, set fingerprint, rare-first prefix, histogram."""
    sent = docs.sparkSession.sparkContext.broadcast(logs)
    num, den = threshold.numerator, threshold.denominator

    def build(batches):
        order = sent.value
        for part, sets in _set_batches(batches, size):
            rows = {"n": [], "fp": [], "prefix": [], "bins": []}
            for h in sets:
                n = len(h)
                rank = order[(h >> U64(64 - bits)).astype(np.int64)]
                keep = n - -(-num * n // den) + 1 if n else 0
                first = np.lexsort((h, rank))[:keep]
                rows["n"].append(n)
                rows["fp"].append(blake2b(h.tobytes(), digest_size=16).digest() if n else None)
                rows["prefix"].append(_pack(h[first]))
                rows["bins"].append(_histogram(h) if n else b"")
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(rows["n"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in ("fp", "prefix", "bins"))],
                names=["id", "th", "n", "fp", "prefix", "bins"],
            )

    given = docs.select("id", F.xxhash64("text").alias("th"), "text")
    out = stage(given.mapInArrow(build, "id long, th long, n int, fp binary, prefix binary, bins binary"))
    sent.destroy()
    return out


def _narrow(fields) -> bytes:
    """Arrays of whole numbers from 0 on, each in the least width that holds it."""
    out = []
    for x in fields:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
        out += [np.array([width, len(x)], "<i4").tobytes(), x.astype(f"<u{width}").tobytes()]
    return b"".join(out)


def _widen(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        width, n = np.frombuffer(raw, "<i4", 2, at).tolist()
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 8).astype(np.int64))
        at += 8 + width * n
    return out


def _deal(reps: DataFrame, parts: int, logs: np.ndarray, bits: int, hot: int) -> DataFrame:
    """Prefix tokens of the classes, packed by hash range: (part, blob).

    A token of a sketch cell that counts 2 ** hot shingles or more is dealt by token and
    class, to as many ranges as the count asks for.
    """
    kind = np.dtype([("token", "<i8"), ("doc", "<i4"), ("pos", "<i4"), ("salt", "<i4")])
    sent = reps.sparkSession.sparkContext.broadcast(logs)

    def pack_rows(got, keys, ns):
        rows, keys, ns = np.concatenate(got), np.array(keys, np.int64), np.array(ns, np.int64)
        part = (rows["token"] * parts >> 8 * TOKEN_BYTES) + np.maximum(rows["salt"], 0)
        part %= parts
        order = np.lexsort((rows["salt"], rows["token"], part))
        part = part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        squeeze = zstandard.ZstdCompressor(level=1)
        names, blobs = [], []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            some = rows[order[a:b]]
            docs, doc = np.unique(some["doc"], return_inverse=True)
            fields = (np.diff(some["token"], prepend=0), doc, some["pos"], some["salt"] + 1, np.diff(keys[docs], prepend=0), ns[docs])
            names.append(int(part[a]))
            blobs.append(squeeze.compress(_narrow(fields)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def deal(batches):
        got, keys, ns, held, log = [], [], [], 0, sent.value
        for batch in batches:
            for i, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens = _unpack(raw.as_py())
                rows = np.empty(len(tokens), kind)
                rows["token"], rows["doc"], rows["pos"], rows["salt"] = tokens, len(keys), np.arange(len(tokens)), -1
                keys.append(i)
                ns.append(n)
                holders = log[tokens >> (8 * TOKEN_BYTES - bits)].astype(np.int64)
                many = np.flatnonzero(holders >= hot)
                if len(many):
                    rows["salt"][many] = mix(np.array([i], U64))[0] % (U64(2) << (holders[many] - hot).astype(U64))
                got.append(rows)
                held += len(rows)
                if held > 2_000_000:
                    yield pack_rows(got, keys, ns)
                    got, keys, ns, held = [], [], [], 0
        if held:
            yield pack_rows(got, keys, ns)

    return reps.select("key", "n", "prefix").mapInArrow(deal, "part int, blob binary")


def _buckets(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of tokens that two or more classes of compatible lengths hold in their prefixes, with the bucket's centre.

    A row stays if its neighbour by length in the bucket passes the length filter;
    if that one does not, none does. All rows of tokens that several tasks share
    stay; these get the token's one centre afterwards.
    """
    schema = "token long, shared boolean, key long, n int, pos int, c_mix long, c_key long, c_n int, c_pos int"

    def meet(table: pa.Table) -> pa.Table:
        cols = [[], [], [], [], []]
        for blob in table.column("blob"):
            step, doc, pos, salt, keys, ns = _widen(zstandard.decompress(blob.as_py()))
            for c, x in zip(cols, (np.cumsum(step), np.cumsum(keys)[doc], ns[doc].astype(np.int32), pos.astype(np.int32), (salt - 1).astype(np.int32))):
                c.append(x)
        token, key, n, pos, salt = (np.concatenate(c) for c in cols)
        order = np.lexsort((n, salt, token))
        t, m, s = token[order], n[order].astype(np.int64), salt[order]
        near = (t[1:] == t[:-1]) & (s[1:] == s[:-1]) & (m[:-1] * den >= m[1:] * num)
        order = order[np.concatenate([near, [False]]) | np.concatenate([[False], near]) | (s >= 0)] if len(t) else order
        token, key, n, pos, salt = (x[order] for x in (token, key, n, pos, salt))
        mixed = mix(key.astype(U64)).view(np.int64)
        order = np.lexsort((mixed, salt, token))
        token, salt = token[order], salt[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]) if len(token) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, len(token)))
        keep = np.repeat((runs > 1) | (salt[first] >= 0), runs)
        centre = order[np.repeat(first, runs)][keep]
        order = order[keep]
        return pa.table({"token": token[keep], "shared": salt[keep] >= 0, "key": key[order], "n": n[order], "pos": pos[order], "c_mix": mixed[centre], "c_key": key[centre], "c_n": n[centre], "c_pos": pos[centre]})

    found = stage(dealt.groupBy("part").applyInArrow(meet, schema))
    columns = ["token", "key", "n", "pos", "c_key", "c_n", "c_pos"]
    if not found.where("shared").limit(1).count():
        return found
    one = found.where("shared").groupBy("token").agg(F.min(F.struct("c_mix", "c_key", "c_n", "c_pos")).alias("c"))
    shared = found.where("shared").drop("c_mix", "c_key", "c_n", "c_pos").join(one, "token").select("token", "key", "n", "pos", "c.c_key", "c.c_n", "c.c_pos")
    out = stage(found.where("NOT shared").select(columns).unionByName(shared))
    discard(found)
    return out


def _may_link(n, pos, m, qos, num: int, den: int):
    """Length and positional filters: the overlap that is still possible suffices."""
    need = F.ceil((n + m) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))
    small, large = F.least(n, m), F.greatest(n, m)
    return (small * den >= large * num) & (F.least(n - pos, m - qos) + F.least(pos, qos) >= need)


def _bounded(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs(u, v)`` that the suffix filter leaves: smaller counts, bin by bin, add up to enough."""

    def bound(batches):
        for batch in batches:
            u_n, v_n = (np.asarray(batch.column(c)).astype(np.int64) for c in (2, 4))
            keep = []
            for k, (a, b) in enumerate(zip(batch.column(3), batch.column(5))):
                a, b = (np.frombuffer(x.as_py(), np.uint8) for x in (a, b))
                size = min(len(a), len(b))
                keep.append(int(np.minimum(_fold(a, size), _fold(b, size)).sum()) * (num + den) >= num * int(u_n[k] + v_n[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: reps.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}"))
    wide = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "n_u", "bins_u", "n_v", "bins_v")
    return stage(wide.mapInArrow(bound, "u long, v long"))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """2 ** BITMAP_BITS bits, those of the ``hashes(h)`` set: a fixed size at any input; when full it holds nothing back."""
    width = (1 << BITMAP_BITS) // SLICES

    def mark(batches):
        bits, some = np.zeros(1 << BITMAP_BITS, np.uint8), False
        for batch in batches:
            some = True
            bits[(mix(np.asarray(batch.column(0)).view(U64)) >> U64(64 - BITMAP_BITS)).astype(np.int64)] = 1
        if some:
            pack = zstandard.ZstdCompressor(level=1)
            blobs = [pack.compress(np.packbits(bits[k * width : (k + 1) * width]).tobytes()) for k in range(SLICES)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "bits": pa.array(blobs, pa.binary())})

    def join(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zstandard.decompress(blob.as_py()), np.uint8)
                sums[k] = sums[k] | part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "bits": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for row in hashes.select("h").mapInArrow(mark, "slice int, bits binary").repartition(SLICES, "slice").mapInArrow(join, "slice int, bits binary").collect():
        out[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _texts(docs: DataFrame, reps: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of some classes, from the documents themselves, one row each.

    A bitmap of the wanted rows goes to all tasks, so that few other texts are shuffled.
    """
    h = F.xxhash64("id", "th").alias("h")
    wanted = stage(reps.select("key", "id", "th").join(keys.select("key").distinct(), "key"))
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(h)))

    def keep(batches):
        bits = sent.value
        for batch in batches:
            at = (mix(np.asarray(batch.column(3)).view(U64)) >> U64(64 - BITMAP_BITS)).astype(np.int64)
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))).select(["id", "th", "text"])

    given = docs.select("id", F.xxhash64("text").alias("th"), "text").select("id", "th", "text", h).mapInArrow(keep, "id long, th long, text string")
    out = stage(given.join(wanted, ["id", "th"]).groupBy("id", "th").agg(F.first("key").alias("key"), F.first("text").alias("text")).select("key", "text"))
    discard(wanted)
    sent.destroy()
    return out


def _sets(texts: pa.ChunkedArray, size: int) -> list[np.ndarray]:
    got: list[np.ndarray] = []
    for at in range(0, len(texts), 64):
        got += shingles(texts.slice(at, 64), size)
    return got


def verify(pairs: DataFrame, texts: DataFrame, threshold: Fraction, size: int) -> DataFrame:
    """The links (u, v) among candidate ``pairs(u, v)``, each compared once on whole ``texts(key, text)``."""
    num, den = threshold.numerator, threshold.denominator

    def compare(batches):
        for batch in batches:
            for part in slices(batch, "text_v", 1_000_000):
                u, v = np.asarray(part.column(0)), np.asarray(part.column(1))
                # Rows come by u, so one set of it serves them.
                new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
                at = np.cumsum(np.isin(np.arange(len(u)), new)) - 1
                left, right = _sets(pa.chunked_array([part.column(2).take(pa.array(new))]), size), _sets(pa.chunked_array([part.column(3)]), size)
                good = []
                for k in range(len(u)):
                    a, b = left[at[k]], right[k]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if den * both >= num * (len(a) + len(b) - both):
                        good.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(u[good], pa.int64()), pa.array(v[good], pa.int64())], names=["u", "v"])

    side = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}"))
    wide = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "text_u", "text_v")
    return wide.mapInArrow(compare, "u long, v long")


def _across(group: DataFrame, reps: DataFrame, docs: DataFrame, threshold: Fraction, size: int) -> DataFrame:
    """Links between components within each group of (main, key, comp, out).

    Every pair of a group that spans two components, with one end or both ``out``,
    is compared; a large group is cut into blocks, and each pair of blocks is a
    task's work. The length and suffix filters find the classes of a pair of blocks
    that may link at all; the overlaps of these are counted through an inverted index of their
    shingles. Only a spanning forest over the components is returned.
    """
    num, den = threshold.numerator, threshold.denominator
    sized = group.join(reps.select("key", "n"), "key")
    parts = sized.groupBy("main").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"), F.count(F.lit(1)).alias("size"))
    dealt = stage(
        join_classes(group, parts, "main", group.count())
        .withColumn("own", F.pmod(F.xxhash64("key"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("main", "key", "comp", "out", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    columns = "main long, lo int, hi int, key long, comp long, out boolean, own int"

    def may_link(table: pa.Table) -> pa.Table:
        comp, out, own, n = (np.asarray(table.column(c)) for c in ("comp", "out", "own", "n"))
        n = n.astype(np.int64)
        same_block = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        raw = [np.frombuffer(b.as_py(), np.uint8) for b in table.column("bins")]
        level = np.array([min(len(r), 64) for r in raw])
        coarse = {w: np.stack([np.minimum(_fold(raw[k], w), 65535) for k in np.flatnonzero(level == w)]).astype(np.uint16) for w in np.unique(level).tolist()}
        mine = {w: np.flatnonzero(level == w) for w in coarse}
        keep = np.zeros(len(n), bool)
        for w, rows in mine.items():
            outs = np.flatnonzero(out[rows])
            outs = outs[np.argsort(n[rows[outs]], kind="stable")]
            for at in range(0, len(outs), 64):
                some = outs[at : at + 64]
                a, x = rows[some], coarse[w][some].astype(np.int32)
                for v, others in mine.items():
                    least = min(v, w)
                    near = np.flatnonzero((n[others] * den >= n[a[0]] * num) & (n[others] * num <= n[a[-1]] * den))
                    if not len(near):
                        continue
                    b = others[near]
                    y = coarse[v][near].astype(np.int32).reshape(len(b), least, -1).sum(axis=2).astype(np.int32)
                    x2 = x.reshape(len(a), least, -1).sum(axis=2).astype(np.int32)
                    most = np.zeros((len(a), len(b)), np.int32)
                    for k in range(least):
                        most += np.minimum(x2[:, k, None], y[None, :, k])
                    total = n[a][:, None] + n[b]
                    low, high = np.minimum(n[a][:, None], n[b]), np.maximum(n[a][:, None], n[b])
                    good = (most * (num + den) >= num * total) & (low * den >= high * num) & (comp[a][:, None] != comp[b])
                    if not same_block:
                        good &= own[a][:, None] != own[b]
                    for i, j in zip(*np.nonzero(good)):
                        i, j = a[i], b[j]
                        fine = min(len(raw[i]), len(raw[j]))
                        if not (keep[i] and keep[j]) and (fine <= 64 or int(np.minimum(_fold(raw[i], fine), _fold(raw[j], fine)).sum()) * (num + den) >= num * int(n[i] + n[j])):
                            keep[i] = keep[j] = True
        return table.select(["main", "lo", "hi", "key", "comp", "out", "own"]).filter(pa.array(keep))

    # The work grows with rows, not bytes, so the number of tasks is set by rows.
    tasks = max(1, dealt.count() // TASK_ROWS)
    spread = dealt.join(reps.select("key", "n", "bins"), "key").repartition(tasks, "main", "lo", "hi")
    some = stage(spread.groupBy("main", "lo", "hi").applyInArrow(may_link, columns))
    discard(dealt)

    def compare(table: pa.Table) -> pa.Table:
        ids, comp, out, own = (np.asarray(table.column(c)) for c in ("key", "comp", "out", "own"))
        same_block = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        got = _sets(table.column("text"), size)
        n = np.array([len(h) for h in got])
        flat, owner = np.concatenate(got), np.repeat(np.arange(len(got)), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        runs = np.diff(np.append(first, len(flat)))
        key = np.empty(len(flat), np.int64)
        key[order] = np.repeat(np.arange(len(first)), runs)
        starts = np.concatenate([[0], np.cumsum(n)])
        parent = {int(c): int(c) for c in comp}
        edges = []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for k in np.flatnonzero(out).tolist():
            mine = key[starts[k] : starts[k + 1]]
            mine = mine[runs[mine] > 1]
            if not len(mine):
                continue
            size_, at = runs[mine], first[mine]
            places = np.repeat(at - np.concatenate([[0], np.cumsum(size_)[:-1]]), size_) + np.arange(size_.sum())
            both = np.bincount(owner[places], minlength=len(n))
            good = (den * both >= num * (n + n[k] - both)) & (comp != comp[k]) & (same_block | (own != own[k]))
            for j in np.flatnonzero(good).tolist():
                a, b = root(int(comp[k])), root(int(comp[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((int(ids[k]), int(ids[j])))
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    texts = _texts(docs, reps, some)
    links = stage(some.join(texts, "key").groupBy("main", "lo", "hi").applyInArrow(compare, "u long, v long"))
    discard(some, texts)
    return links


def _labelled(rows: DataFrame, comps: DataFrame, column: str, name: str) -> DataFrame:
    known = comps.select(F.col("id").alias(column), F.col("component").alias(f"_{name}"))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(f"_{name}", column)).drop(f"_{name}")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: str = "0.75", size: int = 5, bits: int = SKETCH_BITS, hot: int = HOT) -> DataFrame:
    """(id, th, n, component_id) per row of ``docs`` with an id, as jaccard_components(); th is xxhash64 of the text."""
    spark = docs.sparkSession
    share_code(spark)
    limit = Fraction(threshold)
    num, den = limit.numerator, limit.denominator
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    logs = count_sketch(given, size, bits)
    table = set_table(given, limit, size, logs, bits)

    # Classes of equal sets; the document of the least id stands for its class.
    classes = table.where("n > 0").groupBy("fp").agg(F.min(F.struct("id", "th", "n", "prefix", "bins")).alias("r"), F.count(F.lit(1)).alias("size"))
    reps = stage(classes.select("fp", "r.*", "size").withColumn("key", F.monotonically_increasing_id()))
    totals = reps.agg(F.sum(F.length("prefix")), F.sum("size")).first()
    tokens, total = (totals[0] or 0) // TOKEN_BYTES, totals[1] or 0
    named = reps.select("fp", "key", F.col("id").alias("rep"), "size")
    member = stage(join_classes(table.select("id", "th", "n", "fp"), named, "fp", total).drop("fp"))
    discard(table)

    hot += (4 * tokens >> bits).bit_length()  # over the mean count of the sketch
    ranges = max(shuffle_partitions(spark), -(-tokens // RANGE_TOKENS))
    buckets = _buckets(_deal(reps, ranges, logs, bits, hot), num, den)

    rows = buckets.where((F.col("key") != F.col("c_key")) & _may_link(F.col("n"), F.col("pos"), F.col("c_n"), F.col("c_pos"), num, den))
    star = rows.groupBy(F.col("c_key").alias("u"), F.col("key").alias("v")).agg(F.count(F.lit(1)).alias("shared"))
    star = stage(star.groupBy("v").agg(F.max_by("u", F.struct("shared", "u")).alias("u")).select("u", "v"))
    pairs = _bounded(star, reps, num, den)
    texts = _texts(given, reps, pairs.select(F.explode(F.array("u", "v")).alias("key")))
    links = stage(verify(pairs, texts, limit, size))
    discard(star, pairs, texts)
    comps = components(links)

    known = stage(_labelled(_labelled(buckets.select("token", "key", "c_key"), comps, "key", "comp"), comps, "c_key", "main").select("token", "main", "key", "comp"))
    discard(links, buckets)
    outside = known.where("comp <> main")
    inside = known.where("comp = main").join(outside.select("token").distinct(), "token", "left_semi")
    group = outside.select("main", "key", "comp", F.lit(True).alias("out")).unionByName(inside.select("main", "key", "comp", F.lit(False).alias("out"))).distinct()
    group = stage(group)
    links = _across(group, reps, given, limit, size)
    discard(known, group)

    # Components of components, and their least ids.
    edges = stage(_labelled(_labelled(links, comps, "u", "cu"), comps, "v", "cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
    above = components(edges)
    alone = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(comps, "id", "left_anti").withColumn("component", F.col("id"))
    labels = _labelled(comps.unionByName(alone), above, "component", "whole").join(reps.select(F.col("key").alias("id"), F.col("id").alias("rep"), "size"), "id")
    whole = labels.groupBy("whole").agg(F.min("rep").alias("component_id"))
    labels = stage(labels.join(whole, "whole").select(F.col("id").alias("key"), "component_id", "size"))
    discard(reps, links, edges)
    found = join_classes(member.drop("size"), labels, "key", total)
    return found.select("id", "th", "n", F.coalesce("component_id", "rep", "id").alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``.

    component_id is the smallest id reachable by links. Null and empty texts, and
    texts without words, have n_shingles 0 and link with nothing. Rows of a null
    id are left out, as they cannot be named; rows that repeat an id count each, by
    their own texts. Other columns are not read, so
    names cannot clash. An empty table gives an empty result.
    """
    found = jaccard_groups(docs, id_col, **options)
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one_per_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the near copies: of each component the document of the smallest doc_id stays.

    All columns are kept. Rows of a null doc_id stay, and so do null and empty texts,
    which link with nothing. Rows that repeat a doc_id go or stay each by its
    own text; of rows that repeat both, all do. An empty table stays empty.
    """
    gone = stage(jaccard_groups(docs, **options).where("component_id <> id").select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct())
    return docs.join(gone, (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_th"]), "left_anti")
