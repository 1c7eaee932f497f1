"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of fixed length. Each byte has a
learnt vector; filters of several widths run over them, the largest answer of
each filter in a window goes through a softmax layer. All filters are columns of
one matrix (narrow ones have zero rows), so a batch of windows is one matrix
product. A document's prediction is the mean of its windows' probabilities,
weighted by their letters.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import buffers, slices
from quillon.session import share_code

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
DEPTH = 8  # of a byte's vector

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 256), *range(0x80, 0xC0)]] = True


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, row) of the bytes of each row; the last window of a row is filled with zeros."""
    lens = np.diff(offsets)
    n = -(-lens // WINDOW)
    rows = np.repeat(np.arange(len(lens)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    start = offsets[:-1][rows] + (np.arange(len(rows)) - first[rows]) * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][rows][:, None]
    out = np.zeros(at.shape, np.uint8)
    out[inside] = data[at[inside]]
    return out, rows


@dataclass
class ByteConvNet:
    languages: list[str]
    bytes_: np.ndarray  # (256, DEPTH)
    filters: np.ndarray  # (max(WIDTHS) * DEPTH, filters)
    bias: np.ndarray
    out: np.ndarray  # (filters, languages)
    out_bias: np.ndarray

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        x = self.bytes_[windows]
        n, length, depth = x.shape
        wide = max(WIDTHS)
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, length - wide + 1, wide * depth), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view)

    def _forward(self, windows: np.ndarray):
        patches = self._patches(windows)
        n, places, size = patches.shape
        answers = (patches.reshape(-1, size) @ self.filters).reshape(n, places, -1)
        return patches, answers

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        got = []
        for at in range(0, len(windows), 256):
            _, answers = self._forward(windows[at : at + 256])
            top = np.maximum(answers.max(axis=1) + self.bias, 0)
            z = top @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            got.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(got) if got else np.zeros((0, len(self.languages)), np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its probability per row; `und` and 0 without a letter."""
        data, offsets = buffers(texts)
        windows, rows = cut_windows(data, offsets)
        letters = _LETTER[windows].sum(axis=1)
        windows, rows, letters = windows[letters > 0], rows[letters > 0], letters[letters > 0]
        p = self.probabilities(windows) * letters[:, None]
        total = np.stack([np.bincount(rows, weights=c, minlength=len(texts)) for c in p.T], axis=1)
        weight = total.sum(axis=1)
        best = total.argmax(axis=1)
        ok = [w > 0 and any(c.isalpha() for c in t) for w, t in zip(weight.tolist(), (t or "" for t in texts.to_pylist()))]
        names = [self.languages[b] if k else "und" for b, k in zip(best.tolist(), ok)]
        score = np.where(ok, total[np.arange(len(best)), best] / np.maximum(weight, 1e-12), 0.0)
        return names, np.clip(score, 0, 1)


def _mask() -> np.ndarray:
    """Which rows of the filter matrix each filter may use."""
    wide = max(WIDTHS)
    cols = []
    for w in WIDTHS:
        col = np.zeros((wide * DEPTH, FILTERS), np.float32)
        col[: w * DEPTH] = 1
        cols.append(col)
    return np.concatenate(cols, axis=1)


def sample_windows(text: str, most: int, seed: int = 3) -> list[bytes]:
    """At most ``most`` windows at random places of a text, some of them short; the same for equal texts."""
    raw = np.frombuffer(text.encode(), np.uint8)
    rng = np.random.default_rng([seed, zlib.crc32(raw)])
    out = []
    for start in np.unique(rng.integers(0, max(0, len(raw) - WINDOW) + 1, most)).tolist():
        row = np.zeros(WINDOW, np.uint8)
        size = WINDOW if rng.random() < 0.7 else int(rng.integers(8, WINDOW + 1))  # short texts too
        part = raw[start : start + size]
        row[: len(part)] = part
        if _LETTER[row].any():
            out.append(row.tobytes())
    return out


def train(windows: list[bytes], labels: list[str], seed: int = 3, epochs: int = 5, batch: int = 64) -> ByteConvNet:
    """The network by Adam on cross-entropy over labelled windows."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    mask = _mask()
    k = mask.shape[1]
    net = ByteConvNet(
        languages,
        rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
        (rng.normal(0, 0.2, mask.shape) * mask).astype(np.float32),
        np.zeros(k, np.float32),
        rng.normal(0, 0.1, (k, max(1, len(languages)))).astype(np.float32),
        np.zeros(max(1, len(languages)), np.float32),
    )
    if len(languages) < 2:
        return net
    y = np.array([languages.index(name) for name in labels])
    windows = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)
    names = ("bytes_", "filters", "bias", "out", "out_bias")
    m = {n: np.zeros_like(getattr(net, n)) for n in names}
    v = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            w = windows[pick]
            patches, answers = net._forward(w)
            n, places, size = patches.shape
            where = answers.argmax(axis=1)
            top = np.take_along_axis(answers, where[:, None, :], axis=1)[:, 0] + net.bias
            hidden = np.maximum(top, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[pick]] -= 1
            p /= n
            back = (p @ net.out.T) * (top > 0)
            chosen = patches[np.arange(n)[:, None], where]  # (n, filters, size)
            g_filters = np.einsum("nk,nks->sk", back, chosen) * mask
            g_patch = back[:, :, None] * net.filters.T[None]  # (n, filters, size)
            g_bytes = np.zeros_like(net.bytes_)
            for j in range(max(WIDTHS)):
                ids = w[np.arange(n)[:, None], where + j]
                np.add.at(g_bytes, ids.ravel(), g_patch[:, :, j * DEPTH : (j + 1) * DEPTH].reshape(-1, DEPTH))
            grads = {"bytes_": g_bytes, "filters": g_filters, "bias": back.sum(0), "out": hidden.T @ p, "out_bias": p.sum(0)}
            step += 1
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                move = 0.004 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-7)
                setattr(net, name, (getattr(net, name) - move).astype(np.float32))
    return net


def training_windows(docs: DataFrame, most: int, per_text: int) -> tuple[list[bytes], list[str]]:
    """At most ``per_text`` windows of each of ``most`` distinct (doc_id, text) outside the held-out fold, by hash order.

    The windows are cut by the tasks; the driver gets ``most * per_text`` of them at most. Of
    conflicting languages of a pair the greatest is taken.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text", "lang")
    picked = known.select("doc_id", "h").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most).distinct()

    def cut(batches):
        for batch in batches:
            rows = [(i, h, lang, k, w) for i, h, text, lang in zip(*(c.to_pylist() for c in batch.columns)) for k, w in enumerate(sample_windows(text, per_text))]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "h", "lang", "k", "window"])

    cut_ = known.join(F.broadcast(picked), ["doc_id", "h"]).select("doc_id", "h", "text", "lang").mapInArrow(cut, "doc_id long, h long, lang string, k int, window binary")
    rows = cut_.groupBy("doc_id", "h", "k").agg(F.max("lang").alias("lang"), F.min("window").alias("window")).orderBy("doc_id", "h", "k").collect()
    return [bytes(r["window"]) for r in rows], [r["lang"] for r in rows]


def predict_languages(docs: DataFrame, sample: int = 2400, per_text: int = 6) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``.

    The network is trained on at most ``per_text`` windows of each of at most
    ``sample`` texts with a language, none of the held-out fold (crc32 of the doc_id
    as text, modulo 4, is 2). Every whole text is predicted. A text that
    is null or has no letter is `und` with score 0; so is every text if the
    sample holds no language. Rows with equal texts get equal predictions. A null
    doc_id is not held out. An empty table gives an empty result. Other columns are
    not read.
    """
    share_code(docs.sparkSession)
    windows, langs = training_windows(docs, sample, per_text)
    net = train(windows, langs)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def predict(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                if sent.value.languages:
                    names, score = sent.value.predict(part.column(1))
                else:
                    names, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return given.select("doc_id", held.alias("held_out"), "lang_pred", "score")
