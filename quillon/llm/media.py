"""Whole texts as lossless WebP media, and digests of what is read back."""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import slices
from quillon.llm.webp_lanes import decode_payloads, encode_payloads
from quillon.session import share_code


def feature(pixels: np.ndarray) -> str:
    """Mean and standard deviation of each channel and the share of rows' differences, of pixels read back."""
    flat = pixels.reshape(-1, 4).astype(np.float64)
    steps = np.abs(np.diff(flat, axis=0)).mean() if len(flat) > 1 else 0.0
    return f"{pixels.shape[0]}x{pixels.shape[1]};" + ";".join(f"{a:.3f},{b:.3f}" for a, b in zip(flat.mean(0), flat.std(0))) + f";{steps:.3f}"


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = 576) -> DataFrame:
    """(id, n_bytes, media): each whole text's bytes, filled up with 255, as WebP pixels.

    Null texts are empty; an empty text is one row of 255. Equal texts have equal
    media. Rows that repeat an id or have none keep it. Other columns are not read.
    An empty table gives an empty result. ``row`` is a multiple of 32 bytes.
    """

    def store(batches):
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                distinct = {b: k for k, b in enumerate(dict.fromkeys(raw))}
                stored = encode_payloads([b + b"\xff" * (-len(b) % row if b else row) for b in distinct], row // 4)
                media = [stored[distinct[b]] for b in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    share_code(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(store, "id long, n_bytes long, media binary")


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and a feature of the pixels that the decoder reads back, per row of media_table(); empty if that is."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches):
        for batch in (part for whole in batches for part in slices(whole, "media")):
            cols: list[list] = [[] for _ in names[2:]]
            media = batch.column(2).to_pylist()
            for stored, pixels in zip(media, decode_payloads(media)):
                payload = pixels.tobytes()
                for c, x in zip(cols, (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), sha256(stored).hexdigest(), feature(pixels))):
                    c.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    schema = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("id", "n_bytes", "media").mapInArrow(read, schema)
