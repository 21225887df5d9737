"""Language ID: a byte convolutional network in numpy.

Texts are cut into windows of a fixed number of bytes, every byte of the text in one window. Bytes are embedded,
filters of several widths run over them, the strongest answer of each filter over the window goes into a softmax.
A text's probabilities are the mean over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer
from .words import mixed, span_hashes

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS, EMBEDDING = 10, 6
#: Labelled documents that the network is trained on at most, those of smallest hash, and windows of each, those of smallest hash of all its windows.
SAMPLE, PER_TEXT = 4000, 3
#: Epochs, or as many more as make the least number of steps on a small sample.
EPOCHS, STEPS, RATE = 8, 200, 4e-3
#: Windows that go through the network at once; small, so that all stays in the cache.
CHUNK = 64


@dataclass
class ByteNetwork:
    """embed (256, e); filters (longest width * e, f), narrower ones zero beyond their width; bias f; out (f, classes); shift."""

    labels: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    def pooled(self, windows: np.ndarray):
        """Strongest answers (n, f), their places, and the unfolded input, of windows (n, WINDOW) of bytes."""
        widest = max(WIDTHS)
        x = self.embed[np.pad(windows, ((0, 0), (0, widest - 1)))]
        n, e = len(windows), self.embed.shape[1]
        rows = np.lib.stride_tricks.as_strided(x, (n, windows.shape[1], widest * e), (x.strides[0], x.strides[1], x.strides[2]))
        unfolded = np.ascontiguousarray(rows).reshape(-1, widest * e)
        return unfolded, (unfolded @ self.filters).reshape(n, windows.shape[1], -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), len(self.labels)), np.float32)
        for k in range(0, len(windows), CHUNK):
            _, a = self.pooled(windows[k : k + CHUNK])
            z = np.maximum(a.max(axis=1) + self.bias, 0) @ self.out + self.shift
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[k : k + CHUNK] = z / z.sum(axis=1, keepdims=True)
        return out


def windows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows, first window of each text and one more): lower-case bytes, the last window filled up with 0."""
    flat, offsets = text_buffer(pc.utf8_lower(column))
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    first = np.r_[0, np.cumsum(count)]
    out = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    place = np.arange(len(flat)) - np.repeat(offsets[:-1], size) + np.repeat(first[:-1] * WINDOW, size)
    out[place] = flat
    return out.reshape(-1, WINDOW), first


def mask_of(embedding: int = EMBEDDING, filters: int = FILTERS) -> np.ndarray:
    """Ones where a filter has weights: narrower ones end before the longest."""
    mask = np.zeros((max(WIDTHS) * embedding, filters * len(WIDTHS)), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * embedding, k * filters : (k + 1) * filters] = 1
    return mask


def gradients(net: ByteNetwork, windows: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean cross-entropy of windows and its derivatives by the network's arrays."""
    widest, e = max(WIDTHS), net.embed.shape[1]
    unfolded, a = net.pooled(windows)
    n, length = windows.shape
    where = a.argmax(axis=1)
    top = np.take_along_axis(a, where[:, None, :], 1)[:, 0] + net.bias
    h = np.maximum(top, 0)
    z = h @ net.out + net.shift
    z = np.exp(z - z.max(axis=1, keepdims=True))
    d = z / z.sum(axis=1, keepdims=True)
    loss = float(-np.log(np.maximum(d[np.arange(n), labels], 1e-30)).mean())
    d[np.arange(n), labels] -= 1
    d /= n
    dh = (d @ net.out.T) * (top > 0)
    picked = unfolded.reshape(n, length, -1)[np.arange(n)[:, None], where]  # (n, f, widest * e)
    g = {"out": h.T @ d, "shift": d.sum(axis=0), "bias": dh.sum(axis=0), "filters": np.einsum("nf,nfk->kf", dh, picked) * mask}
    back = (dh[:, :, None] * net.filters.T[None]).reshape(n, -1, widest, e)
    byte = np.pad(windows, ((0, 0), (0, widest - 1)))[np.arange(n)[:, None, None], where[:, :, None] + np.arange(widest)]
    g["embed"] = np.zeros_like(net.embed)
    np.add.at(g["embed"], byte.ravel(), back.reshape(-1, e))
    return loss, g


def train_network(windows: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = EPOCHS, seed: int = 3) -> ByteNetwork:
    """Adam on the cross-entropy of windows, in batches of 128; labels are places in names."""
    rng = np.random.default_rng(seed)
    mask = mask_of()
    f = mask.shape[1]
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), "filters": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(f, np.float32), "out": rng.normal(0, 0.2, (f, len(names))).astype(np.float32), "shift": np.zeros(len(names), np.float32),
    }
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    net = ByteNetwork(names, *p.values())
    epochs = max(epochs, -(-STEPS // -(-len(windows) // 128)))
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 128):
            at = order[lo : lo + 128]
            _, g = gradients(net, windows[at], labels[at], mask)
            step += 1
            rate = RATE * (0.3 if epoch >= epochs * 2 // 3 else 1)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def chosen_windows(windows: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` windows of smallest hash of each text."""
    flat = windows.ravel()
    starts = np.arange(len(windows)) * WINDOW
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = mixed(span_hashes(flat, starts, starts + WINDOW) + (np.arange(len(windows)) - first[text]).astype(np.uint64)) if len(windows) else np.zeros(0, np.uint64)
    order = np.lexsort((h, text))
    return np.sort(order[np.arange(len(order)) - first[text[order]] < most])


def fit_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, per_text: int = PER_TEXT) -> ByteNetwork | None:
    """Trains on at most `sample` rows with a text with letters and a lang, `per_text` windows of each; None if there are none.

    Labels are learned in code point order. Windows come from anywhere in a whole text and are taken in the order
    of their documents' hashes, so the network doesn't depend on how the table is laid out.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # The hash decides first and alone, so that no texts but the sample's are cut into windows.
    h = F.xxhash64(id_col, text_col)
    cut = known.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cut is None:
        return None

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "t")):
            windows, first = windows_of(b.column("t"))
            at = chosen_windows(windows, first, per_text)
            text = np.searchsorted(first, at, "right") - 1
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WINDOW), len(at), [None, pa.py_buffer(np.ascontiguousarray(windows[at]))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("h").take(pa.array(text)), b.column("lang").take(pa.array(text)), pa.array(at - first[text]), blob], names=["h", "lang", "place", "window"])

    rows = known.filter(h <= cut).select(h.alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    rows = rows.mapInArrow(cut_up, "h bigint, lang string, place bigint, window binary").orderBy("h", "place", "lang").limit(sample * per_text).toPandas()
    rows = rows.sort_values(["h", "place", "lang"], kind="stable")
    names = sorted(rows["lang"].unique())
    windows = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)
    return train_network(windows, np.array([names.index(x) for x in rows["lang"]]), names)


def predict_language(docs: DataFrame, network: ByteNetwork | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, lang_pred, score) for each row: `und` with score 0 for null texts, texts without a letter, or without a network.

    All windows of a text count, however long it is; of equal means the first label in code point order is taken.
    Repeated rows are rows of their own, null ids stay null, an empty table gives no rows; other columns are
    ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "t")):
            windows, first = windows_of(b.column("t"))
            letters = b.column("letters").to_numpy(zero_copy_only=False)
            if network is None:
                best, top = ["und"] * b.num_rows, np.zeros(b.num_rows)
            else:
                total = np.zeros((len(windows) + 1, len(network.labels)))
                np.cumsum(network.probabilities(windows), axis=0, out=total[1:])
                mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
                best = [network.labels[k] if x else "und" for k, x in zip(mean.argmax(axis=1), letters, strict=True)]
                top = np.where(letters, np.clip(mean.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(best, pa.string()), pa.array(top, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)
