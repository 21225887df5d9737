"""Benchmark decontamination: winnowed fingerprints of documents met with those of benchmark items.

A text's k-grams of words are hashed, and of every w consecutive k-grams the smallest hash is kept (the rightmost
of equal ones). A window of k + w - 1 words keeps a hash that depends on its own words alone, so every span of that
many words which a document shares with an item keeps the same fingerprint in both: none is missed. Fingerprints
that no item has are dropped where they are made, by a filter of fixed size. Each that is left is extended to the
windows that kept it: those are what is joined with the items' windows, by fingerprint and a digest of 128 bits, so
that a fingerprint that very many texts hold (a common phrase) meets a window at most once and never makes pairs.
Windows that occur are then merged into spans of words.

Items shorter than a window are one window of their own length; documents are winnowed once for each length that
occurs, of which there are at most as many as a window has words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_table, slices, text_buffer
from .words import mixed, span_hashes, spans_of

#: Words of a window.
WINDOW = 10
#: Bits of the filter of fingerprints and windows: 1 MB, whatever the benchmark's size. A full one lets all pass; the join decides.
FILTER_BITS = 1 << 23
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
FOUND = "row bigint, id bigint, n_words bigint, start bigint, length int, print bigint, one bigint, other bigint"


def _runs(h: np.ndarray, size: int, factor: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of `size` entries of h, or of those that start `at` some places."""
    n = max(len(h) - size + 1, 0) if at is None else len(at)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(factor) + (h[k : k + n] if at is None else h[at + k])
    return mixed(out)


def winnow(h: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` words that begins at one of `starts`: the place and the hash of the k-gram it keeps."""
    k = (length + 1) // 2
    grams = mixed(_runs(h, k, FACTORS[0]) ^ np.uint64(length))
    best, place = grams[starts], starts.copy()
    for j in range(1, length - k + 1):
        other = grams[starts + j]
        smaller = other <= best
        best = np.where(smaller, other, best)
        place[smaller] = starts[smaller] + j
    return place, best


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % np.uint64(len(bits) * 64)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _windows(lengths: list[int] | None, bits: np.ndarray | None, window: int):
    """Rows (FOUND): one for each text with its number of words, and one for each window; with bits only windows that may be an item's.

    lengths None: a text's windows have `window` words, or all it has if they are fewer.
    """

    def signed(x: np.ndarray) -> pa.Array:
        return pa.array(x.astype(np.uint64).view(np.int64))

    def of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, offsets = text_buffer(b.column("t"))
        flat = LOWER[flat]
        begin, end = spans_of(IS_WORD[flat], offsets)
        h = span_hashes(flat, begin, end) if len(begin) else np.zeros(0, np.uint64)
        first = np.searchsorted(begin, offsets)
        counts = np.diff(first)
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(counts.astype(np.int64)), none, pa.nulls(b.num_rows, pa.int32()), none, none, none], names=NAMES)
        for length in lengths if lengths is not None else sorted({int(x) for x in np.unique(np.minimum(counts, window)) if x}):
            n = np.maximum(counts - length + 1, 0)
            if lengths is None and length < window:
                n[counts != length] = 0
            text = np.repeat(np.arange(len(n)), n)
            starts = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + first[text]
            if not len(starts):
                continue
            place, prints = winnow(h, starts, length)
            if bits is not None:
                chosen = np.zeros(len(h), bool)
                chosen[place] = True
                prints_at = np.zeros(len(h), np.uint64)
                prints_at[place] = prints
                kept = np.flatnonzero(chosen)
                chosen[kept] = _has(bits, prints_at[kept])
                some = chosen[place]
                text, starts, prints = text[some], starts[some], prints[some]
            one = _runs(h, length, FACTORS[1], starts)
            if bits is not None:
                some = _has(bits, one)
                text, starts, prints, one = text[some], starts[some], prints[some], one[some]
            other = _runs(h, length, FACTORS[2], starts)
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(take), b.column("id").take(take), pa.nulls(len(text), pa.int64()), pa.array(starts - first[text]), pa.array(np.full(len(text), length, np.int32)), signed(prints), signed(one), signed(other)], names=NAMES
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "t"):
                yield from of(b)

    return run


NAMES = [c.split()[0] for c in FOUND.split(", ")]
KEY = ["length", "print", "one", "other"]


def _filter(items: DataFrame, bits: int) -> np.ndarray:
    """A bit for each fingerprint and each window of items. At most bits / 64 rows of two numbers come to the driver."""
    at = items.select(F.explode(F.array("print", "one")).alias("v"))
    # A hash stands for an unsigned number, and bits divides 2 ** 64: the rest is the same.
    at = at.select(F.pmod("v", F.lit(bits)).alias("v"))
    rows = at.groupBy(F.shiftright("v", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(v & 63 as int)))").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("word").to_numpy()
    return out.view(np.uint64)


def _source(texts: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_hit, spans, items, contaminated.

    Words are runs of digits, ASCII letters and characters beyond ASCII, with A-Z in lower case. An item's windows
    are its runs of `window` words, or all its words if they are fewer. A document's word is hit if it lies in an
    occurrence of a window; spans are the hit words as (first, last) pairs, from 0 and with the end left out, that
    neither overlap nor touch. items are the ids of items with an occurring window as strings, each once, in code
    point order; rows of items with one id are one item, and items without an id hit words but are not listed.
    Null and empty texts have no words: such a document is clean, such an item finds nothing. Repeated documents
    give a row each. An empty table of docs gives no rows, one of items only clean ones; other columns are ignored.
    Words are told apart by hashes of 64 bits, windows by 128.
    """
    if window < 1 or filter_bits & (filter_bits - 1) or filter_bits < 64:
        raise ValueError("a window has a word at least, a filter a power of two of bits, 64 at least")
    found = kept_table(_source(items, item_text, item_id).mapInArrow(_windows(None, None, window), FOUND), "items").filter("start is not null").select("id", *KEY).distinct()
    # Windows that the same items hold share a set: documents then meet a set of items once, not a window's items each time.
    item = F.col("id").cast("string")
    grouped = found.groupBy(*KEY).agg(F.count("id").alias("n"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y"))
    grouped = kept_table(grouped, "item-windows")
    lengths = sorted(r[0] for r in grouped.select("length").distinct().collect())  # at most `window` numbers
    rows = kept_table(_source(docs, text_col, id_col).mapInArrow(_windows(lengths, _filter(grouped, filter_bits), window), FOUND), "windows")
    hits = kept_table(rows.filter("start is not null").select("row", "start", *KEY).join(grouped, KEY).select("row", "start", (F.col("start") + F.col("length")).alias("stop"), "n", "x", "y"), "hits")
    before = Window.partitionBy("row").orderBy("start", "stop")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    island = hits.select("row", "start", "stop", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)).alias("new"))
    island = island.select("row", "start", "stop", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    spans = island.groupBy("row", "island").agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    spans = spans.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    members = found.join(grouped, KEY).filter("id is not null").select("n", "x", "y", item.alias("item")).distinct()
    listed = hits.select("row", "n", "x", "y").distinct().join(members, ["n", "x", "y"]).select("row", "item").distinct()
    listed = listed.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.filter("start is null").select("row", "id", "n_words").join(spans, "row", "left").join(listed, "row", "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"),
    )
