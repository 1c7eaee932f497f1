"""Token-id files with fixed-width bit packing.

A shard is one binary value:

    magic "QTB1" | bits u32 | block u32 | documents u64 | ids u64
    document ids i64[documents] | null flags u8[documents] | starts u64[documents + 1]
    block offsets u64[blocks + 1] | payload

Every id takes ``bits`` bits, the least that hold the vocabulary, low bit first.
A block is ``block`` ids (the last one fewer) from a byte boundary on; the
offsets allow any range of ids to be unpacked, by numpy, without the rest.
Shards are stored as rows of Parquet files, through Spark, so any Hadoop file
system serves.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import slices
from quillon.llm._tokens import ChunkEncoder, vocabulary_size
from quillon.session import shuffle_partitions, stage

MAGIC = b"QTB1"
BLOCK = 4096
SHARD_IDS = 1 << 20
_HEAD = struct.Struct("<4sIIQQ")


def width(vocabulary: int) -> int:
    """Bits that hold ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def encode_shard(doc_ids: list[int | None], docs: Iterable[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    docs = list(docs)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    starts = np.cumsum([0, *map(len, docs)]).astype("<u8")
    blocks = [pack(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    flags = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([_HEAD.pack(MAGIC, bits, block, len(docs), len(ids)), known.tobytes(), flags.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Random access to a shard's ids."""

    def __init__(self, raw: bytes):
        magic, self.bits, self.block, n, self.n_ids = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = _HEAD.size
        known = np.frombuffer(raw, "<i8", n, at)
        flags = np.frombuffer(raw, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if f else int(d) for d, f in zip(known, flags)]
        at += 9 * n
        self.starts = np.frombuffer(raw, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at).astype(np.int64)
        self.raw, self.at = raw, at + 8 * (blocks + 1)

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids of [start, end); only the blocks that hold them are unpacked."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.raw[self.at + self.offsets[b] : self.at + self.offsets[b + 1]], n, self.bits))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, spaced: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the token ids of ``docs`` in ascending id order, as a written table.

    Columns: part and shard (their order is the order of ids), before (ids of the
    part's earlier shards), n_ids, content. Null texts are empty; a null id comes
    first; rows that repeat an id follow each other, by text. ``tokenizer`` is a
    path that every executor can open.
    """
    spark = docs.sparkSession
    bits = width(max(vocabulary_size(tokenizer), end_id + 1))

    def write(batches):
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        encoder = ChunkEncoder.shared(tokenizer, spaced)
        end = np.array([end_id], "<u4").tobytes()
        ids, held, n = [], [], 0

        def flush():
            content = encode_shard(ids, held, bits)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (shard, pa.int32()), (before, pa.int64()), (n, pa.int64()), (content, pa.binary()))], names=["part", "shard", "before", "n_ids", "content"])

        for batch in batches:
            for some in slices(batch, "text"):
                texts = [t or "" for t in some.column(1).to_pylist()]
                for i, raw in zip(some.column(0).to_pylist(), encoder.encode(texts)):
                    ids.append(i)
                    held.append(np.frombuffer(raw + end, "<u4"))
                    n += len(held[-1])
                    if n >= SHARD_IDS:
                        yield flush()
                        shard, before = shard + 1, before + n
                        ids, held, n = [], [], 0
        if ids:
            yield flush()

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = given.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    return stage(dealt.mapInArrow(write, "part int, shard int, before long, n_ids long, content binary"))


def read_documents(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, unpacked from the files."""
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row a write task
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    def read(batches):
        for batch in batches:
            for part, before, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shard = Shard(content.as_py())
                n = np.diff(shard.starts)
                crc = [zlib.crc32(shard.document(k).tobytes()) for k in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1] + base[part] + before), pa.array(n), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return files.select("part", "before", "content").mapInArrow(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
