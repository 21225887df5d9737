"""Spelling variants: words one edit apart, found by a prefix filter over their rarest bigrams.

All bigrams of the vocabulary are ordered by how often they occur in it. One edit destroys two bigrams of a word at
most, so of the three rarest of each of two near words (of equal ones the first) one is met in the other, and what
lies on one side of it is the same in both: the edit is on the other side. The position limit is therefore exact: a
word is listed under each of its three rarest bigrams twice, with what stands before it (same place from the start)
and with what follows it (same place from the end). Words listed alike whose lengths differ by one at most are
candidates, and edit distance decides. The list of bigrams is bounded by the alphabet, 90 squared.

A word's form is its near word with the most occurrences if that has twice its own, so that forms form a forest;
roots are found by doubling steps, at most as many as the logarithm of the longest chain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, kept_table, slices, text_buffer
from .words import mixed, span_hashes, spans_of

#: A run whose checksum this number divides loses a character; None: none does.
DAMAGE = 97
LETTERS, COUNT, FACTOR = 5, 3, 2
#: Rarest bigrams that a word is listed under: one edit destroys two.
RAREST = 3
#: a-z and the 64 characters from U+00C0 to U+00FF.
ALPHABET = 90
#: Characters beyond which a word's checksum and edits are found one word at a time.
LONG = 64
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
LEAD = 0xC3  # of the two bytes of U+00C0 to U+00FF; it never continues a character


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


CRC = _crc_table()


def checksums(heads: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what the checksum in heads stands for, followed by flat[start:end], for all spans at once."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    state = (heads ^ np.uint32(0xFFFFFFFF))[order]
    at, size = starts[order], lengths[order]
    for k in range(min(int(size[0]) if len(size) else 0, LONG)):
        n = int(np.searchsorted(-size, -k, "left"))  # spans longer than k
        state[:n] = CRC[(state[:n] ^ flat[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(state), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in order[: int(np.searchsorted(-size, -LONG, "left"))]:
        out[i] = zlib.crc32(flat[starts[i] + LONG : ends[i]].tobytes(), int(out[i]))
    return out


def _word_counts(damage: int | None, letters: int):
    """(word, n) of a slice's words with at least `letters` characters."""

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, offsets = text_buffer(b.column("t"))
        flat = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)
        lead = flat == LEAD
        flags = ASCII_LETTER[flat] | lead
        flags[1:] |= lead[:-1]
        starts, ends = spans_of(flags, offsets)
        data, lengths = flat[flags], ends - starts
        stop = np.cumsum(lengths)
        start = stop - lengths
        keep = np.ones(len(data), bool)
        if damage and len(starts):
            heads = np.array([zlib.crc32(b"%d:" % i if i is not None else b":") for i in b.column("id").to_pylist()], np.uint32)
            text = np.searchsorted(offsets, starts, "right") - 1
            h = checksums(heads[text], data, start, stop)
            hit = np.flatnonzero(h % np.uint32(damage) == 0)
            points = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
            first = np.searchsorted(points, start[hit])
            place = points[first + h[hit].astype(np.int64) % (np.searchsorted(points, stop[hit]) - first)]
            keep[place] = False
            keep[place[data[place] == LEAD] + 1] = False
            lengths = np.add.reduceat(keep, start, dtype=np.int64) if len(start) else lengths
        data = data[keep]
        bounds = np.r_[0, np.cumsum(lengths)]
        continued = np.r_[0, np.cumsum((data & 0xC0) == 0x80)]
        size = lengths - (continued[bounds[1:]] - continued[bounds[:-1]])
        words = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        counts = pc.value_counts(words.filter(pa.array(size >= letters)))
        return pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "t"):
                yield of(b)

    return run


def word_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", damage: int | None = DAMAGE, letters: int = LETTERS, count: int = COUNT) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of at least `letters` characters that occur at least `count` times.

    A run whose CRC-32 of "<id>:<run>" is divided by `damage` first loses the character at that checksum modulo its
    length. Null text has no words; a null id is an empty string in the checksum.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(_word_counts(damage, letters), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number under ALPHABET for each character of a batch of words, and where each word starts."""
    flat, offsets = text_buffer(column)
    begins = (flat & 0xC0) != 0x80
    points = np.flatnonzero(begins)
    head = flat[points].astype(np.int64)
    wide = head == LEAD
    codes = head - 97
    codes[wide] = 26 + flat[points[wide] + 1] - 0x80
    return codes, np.searchsorted(points, offsets)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of each batch of words."""
    for batch in batches:
        codes, first = _codes(batch.column("word"))
        inner = np.ones(max(len(codes) - 1, 0), bool)
        inner[first[1:-1] - 1] = False
        grams, n = np.unique((codes[:-1] * ALPHABET + codes[1:])[inner], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), pa.array(n)], names=["gram", "n"])


def _listed(rank: np.ndarray):
    """(word, n, long, at) for each word and place it is listed at: a hash of side, number of characters left to compare and what is the same.

    Beside a shared bigram one side is the same and the other, of s characters in the shorter word, holds the edit:
    its half next to the bigram is the same, or the other half is. A word is listed as the shorter one (or one of
    two as long), and as the longer one of a pair (long).
    """

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        codes, first = _codes(b.column("word"))
        sizes = np.diff(first)
        word = np.repeat(np.arange(len(sizes)), sizes - 1)
        base = np.cumsum(sizes - 1) - (sizes - 1)
        place = np.arange(len(word)) - base[word]
        at = first[word] + place
        order = np.lexsort((place, rank[codes[at] * ALPHABET + codes[at + 1]], word))
        nth = np.arange(len(order)) - base[word[order]]
        chosen = order[nth < RAREST]
        word, at = word[chosen], at[chosen]
        flat = codes.astype(np.uint8)
        begin, end, after = first[word], first[word + 1], at + 2

        def same(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return span_hashes(flat, lo, hi)

        rows = []
        for long in (0, 1):
            left, right = at - begin - long, end - after - long  # characters to compare before and after the bigram
            for side, s in ((0, right), (1, left)):
                ok = s >= 0
                lo, hi, mid, stop, size = begin[ok], end[ok], at[ok], after[ok], s[ok]
                half = size // 2
                if side == 0:
                    near, fixed, far = same(lo, stop + half), same(lo, stop), same(hi - (size - half), hi)
                else:
                    near, fixed, far = same(mid - half, hi), same(mid, hi), same(lo, lo + (size - half))
                tag = mixed((size * 4 + side * 2 + 1).astype(np.uint64))
                rows.append((word[ok], long, mixed(near ^ tag)))
                rows.append((word[ok], long, mixed((fixed * np.uint64(3) + far) ^ (tag + np.uint64(1)))))
        taken = pa.array(np.concatenate([r[0] for r in rows]))
        longs = np.concatenate([np.full(len(r[0]), bool(r[1])) for r in rows])
        return pa.RecordBatch.from_arrays([b.column("word").take(taken), b.column("n").take(taken), pa.array(longs), pa.array(np.concatenate([r[2] for r in rows]).view(np.int64))], names=["word", "n", "long", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield of(b)

    return run


def one_edit(a: str, b: str) -> F.Column:
    """Whether two different words are one edit apart. Built-in edit distance takes the square of a word's length: long ones go by their first difference."""
    one, other = F.col(a), F.col(b)
    m, n = F.length(one), F.length(other)
    at = F.array_position(F.zip_with(F.split(one, ""), F.split(other, ""), lambda x, y: x != y), True).cast("int")
    at = F.when(at == 0, F.least(m, n) + 1).otherwise(at)
    long = F.when(m == n, F.substr(one, at + 1) == F.substr(other, at + 1)).when(m == n + 1, F.substr(one, at + 1) == F.substr(other, at)).when(n == m + 1, F.substr(other, at + 1) == F.substr(one, at)).otherwise(False)
    return F.when(m <= LONG, F.levenshtein(one, other, 1) == 1).otherwise(long)


def near_pairs(words: DataFrame) -> DataFrame:
    """(one, other, n_one, n_other) for each pair of words (word, n; at least four characters of the alphabet) that differ by exactly one edit; one < other."""
    counted = words.select("word").mapInArrow(_bigrams, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # 8100 rows at most
    grams, n = counted.column("gram").to_numpy(), counted.column("n").to_numpy()
    rank = np.zeros(ALPHABET * ALPHABET, np.int64)
    rank[grams[np.lexsort((grams, n))]] = np.arange(len(grams))
    listed = words.mapInArrow(_listed(rank), "word string, n bigint, long boolean, at bigint").repartition("at")
    a, b = listed.alias("a"), listed.alias("b")
    met = a.join(b, (F.col("a.at") == F.col("b.at")) & ~(F.col("a.long") & F.col("b.long")) & (F.col("a.word") < F.col("b.word")) & one_edit("a.word", "b.word"))
    return met.select(F.col("a.word").alias("one"), F.col("b.word").alias("other"), F.col("a.n").alias("n_one"), F.col("b.n").alias("n_other")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms are followed by steps that double."""
    spark = forms.sparkSession
    at = kept_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        fresh = kept_table(at.join(step, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        moved = not fresh.filter("moved").isEmpty()
        drop_tables(spark, [at])
        at = fresh.select("word", "root")
        if not moved:
            return at


def spelling_variants(words: DataFrame, factor: float = FACTOR) -> DataFrame:
    """One row for each row of words (word, n, each word once): word, form, root, n, n_near, form_n.

    Words are near if they differ by exactly one inserted, deleted or replaced character; n_near counts a word's near
    words. form is the near word with the largest n, of equal ones the first in code point order, if its n is at
    least `factor` (over 1) times the word's, else null, as is form_n, its n. root is where forms lead in the end:
    the word itself without a form. An empty table gives no rows.
    """
    words = kept_table(words.select("word", "n"), "words")
    pairs = kept_table(near_pairs(words), "near")
    both = pairs.select(F.col("one").alias("word"), F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("form")).alias("to")).unionByName(
        pairs.select(F.col("other").alias("word"), F.struct((-F.col("n_one")).alias("less"), F.col("one").alias("form")).alias("to"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("to").alias("to")).select("word", "n_near", F.col("to.form").alias("form"), (-F.col("to.less")).alias("form_n"))
    best = kept_table(words.join(best, "word", "left"), "best")
    big = F.col("form_n") >= F.col("n") * F.lit(factor)
    forms = kept_table(best.filter(big).select("word", "form", "form_n"), "forms")
    return best.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near")).join(forms, "word", "left").join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
