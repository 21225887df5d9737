"""Toxicity: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Tokens are words, known by themselves and by their beginnings, so that a stem counts whatever follows it. Log-odds
of a token in toxic against other documents have a Dirichlet prior at the base rate. Tokens of the lexicon
score their log-odds, all others the small negative log-likelihood ratio of not being in it; every maximal
segment of a text is found in one scan. A segment's E-value K n exp(-lambda S) has lambda from the scores that the
words of clean text have, and K from the best segments of clean documents, by maximum likelihood. A logistic curve of the best
segment's and all significant segments' evidence, fitted on labelled documents, gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table, slices
from .words import mixed, span_hashes, words

#: Labelled rows that the model is fitted on at most, those of smallest hash of the id.
SAMPLE = 20_000
#: Bytes of the beginnings of words that are tokens too.
BEGINNINGS = (3, 4, 5, 6, 7, 8, 10)
#: Toxic documents that a token must occur in, the prior's documents, and the least log-odds.
LEAST_DOCS, PRIOR, LEAST_ODDS = 5, 2.0, 2.7
SIGNIFICANT = 0.05


@dataclass
class ToxicityModel:
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = 0.05
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] = (-2.0, 0.0, 0.0)


def word_tokens(column: pa.Array):
    """For every word of a batch the hashes of itself and its beginnings, longest first; 0 where it has none."""
    hashes, starts, ends, first, flat = words(column)
    out = [mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))]
    for k in reversed(BEGINNINGS):
        longer = ends - starts > k
        h = np.zeros(len(starts), np.uint64)
        if longer.any():
            h[longer] = span_hashes(flat, starts[longer], starts[longer] + k)
        out.append(h)
    return out, starts, ends, first, flat


def _document_counts(known: np.ndarray | None):
    """(token, toxic documents, other documents); with known, of known tokens only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text")):
            tokens, _, _, first, _ = word_tokens(b.column("text"))
            toxic = b.column("toxic").to_numpy()
            doc = np.repeat(np.arange(len(toxic)), np.diff(first))
            hits, docs = [], []
            for t in tokens:
                ok = t != 0
                if known is not None and len(known):
                    at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                    ok &= known[at] == t
                hits.append(t[ok]), docs.append(doc[ok])
            hit, doc = np.concatenate(hits), np.concatenate(docs)
            order = np.lexsort((doc, hit))
            hit, doc = hit[order], doc[order]
            once = np.r_[True, (hit[1:] != hit[:-1]) | (doc[1:] != doc[:-1])] if len(hit) else np.zeros(0, bool)
            hit, doc = hit[once], doc[once]
            token, at = np.unique(hit, return_inverse=True)
            yes = np.bincount(at, toxic[doc] == 1, len(token)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(yes), pa.array(np.bincount(at, minlength=len(token)) - yes)], names=["token", "yes", "no"])

    return run


def segments(scores: np.ndarray, gaps: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first hit, last hit, score), as Ruzzo and Tompa define them, in one scan.

    scores are those of the hits, all positive; gaps the numbers of drifting tokens before each.
    """
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    back: list[int] = []
    total = 0.0
    for i, (s, g) in enumerate(zip(scores.tolist(), gaps.tolist(), strict=True)):
        total -= drift * g
        lo, total = total, total + s
        begin, hi = i, total
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                left.append(lo), right.append(hi), span.append((begin, i)), back.append(j)
                break
            lo, begin = left[j], span[j][0]
            del left[j:], right[j:], span[j:], back[j:]
    return [(a, b, r - x) for (a, b), x, r in zip(span, left, right, strict=True)]


def _scan(column: pa.Array, model: ToxicityModel, places: bool = False):
    """For each text its number of words, its segments and its hit words; with places, the places of these in the lexicon."""
    tokens, starts, ends, first, flat = word_tokens(column)
    place = np.full(len(starts), -1)
    if len(model.tokens):
        for t in tokens:
            at = np.minimum(np.searchsorted(model.tokens, t), len(model.tokens) - 1)
            new = (place < 0) & (model.tokens[at] == t) & (t != 0)
            place[new] = at[new]
    odds = np.where(place < 0, 0.0, model.odds[place] if len(model.odds) else 0.0)
    hit = np.flatnonzero(place >= 0)
    at = np.searchsorted(hit, first)
    for d in range(len(first) - 1):
        h = hit[at[d] : at[d + 1]]
        n = int(first[d + 1] - first[d])
        if places or not len(h):
            yield n, [], starts, ends, first[d], place[h]
            continue
        gaps = np.diff(np.r_[first[d] - 1, h]) - 1
        yield n, segments(odds[h], gaps, model.drift), starts, ends, first[d], h


def evidence(n: int, found: list[tuple[int, int, float]], model: ToxicityModel) -> tuple[float, float]:
    """-log10 of the best segment's E-value, and the sum of that over the significant ones, both in [0, 30]."""
    worth = [(model.lam * s - math.log(model.k * max(n, 1))) / math.log(10) for _, _, s in found]
    return min(max([0.0, *worth]), 30.0), min(sum(w for w in worth if w > -math.log10(SIGNIFICANT)), 30.0)


def probability(x: tuple[float, float], model: ToxicityModel) -> float:
    z = model.weights[0] + model.weights[1] * x[0] + model.weights[2] * math.sqrt(x[1])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the first column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def decay_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda * score) is 1."""
    share = weights / weights.sum()
    low, high = 1e-6, 1.0
    mean = lambda x: float((share * np.exp(x * values)).sum())
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def fit_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> ToxicityModel:
    """Fits on at most `sample` rows of labels (id_col, toxic 0/1; null labels and ids don't count), each text once a label. Without both labels, as in an empty table, scores are one constant."""
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = kept_table(chosen, "labels")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` rows of 12 bytes
    rows = kept_table(rows.select("toxic", "text", F.md5(F.col("text").cast("binary")).alias("d")).dropDuplicates(["toxic", "d"]).select("toxic", "text"), "fit")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = totals.get(1, 0), totals.get(0, 0)
    model = ToxicityModel()
    if not yes or not no:
        model.weights = (-8.0 if not yes else 8.0, 0.0, 0.0)
        return model
    schema = "token bigint, yes bigint, no bigint"
    often = rows.filter("toxic = 1").mapInArrow(_document_counts(None), schema).groupBy("token").agg(F.sum("yes").alias("yes")).filter(F.col("yes") >= LEAST_DOCS)
    often = often.toPandas().astype("int64")
    known = np.sort(often["token"].to_numpy().view(np.uint64))
    counts = rows.filter("toxic = 0").mapInArrow(_document_counts(known), schema).groupBy("token").agg(F.sum("no").alias("no")).toPandas().astype("int64")
    both = often.merge(counts, on="token", how="left").fillna(0)
    base = yes / (yes + no)
    t, c = both["yes"].to_numpy(float), both["no"].to_numpy(float)
    odds = np.log((t + PRIOR * base) / (c + PRIOR * (1 - base))) - math.log(base / (1 - base))
    good = odds >= LEAST_ODDS
    token = both["token"].to_numpy().astype(np.int64).view(np.uint64)[good]
    order = np.argsort(token)
    model.tokens, model.odds = token[order], odds[good][order]

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text")):
            n, hits = np.zeros(2, np.int64), [np.zeros(len(model.odds), np.int64), np.zeros(len(model.odds), np.int64)]
            for toxic, (words_, _, _, _, _, h) in zip(b.column("toxic").to_pylist(), _scan(b.column("text"), model, places=True), strict=True):
                n[toxic] += words_
                hits[toxic] += np.bincount(h, minlength=len(model.odds))
            place = [-1, -1, *(np.flatnonzero(hits[0])), *(np.flatnonzero(hits[1]))]
            toxic = np.r_[0, 1, np.zeros(np.count_nonzero(hits[0]), np.int64), np.ones(np.count_nonzero(hits[1]), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(toxic), pa.array(np.r_[n, hits[0][hits[0] > 0], hits[1][hits[1] > 0]])], names=["token", "yes", "no"])

    # A row for each token of the lexicon and label at most, and the words of all texts under -1.
    seen = rows.mapInArrow(rates, schema).groupBy("token", "yes").agg(F.sum("no").alias("n")).collect()
    size, hits = [0, 0], np.zeros((2, len(model.odds)))
    for r in seen:
        if r["token"] < 0:
            size[r["yes"]] = r["n"]
        else:
            hits[r["yes"], r["token"]] = r["n"]
    rate = [(hits[k].sum() + 0.5) / (size[k] + 1) for k in (0, 1)]
    model.drift = max(math.log((1 - rate[0]) / (1 - rate[1])), 1e-3)
    # The scores of clean text: each token of the lexicon as often as it comes there, half a hit shared by all, else the drift.
    scores = np.r_[model.odds if len(model.odds) else LEAST_ODDS, -model.drift]
    model.lam = decay_rate(scores, np.r_[hits[0] + 0.5 / max(len(model.odds), 1) if len(model.odds) else 0.5, max(size[0] - hits[0].sum(), 1.0)])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text")):
            x = np.array([(n, max([0.0, *(s for _, _, s in found)])) for n, found, *_ in _scan(b.column("text"), model)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1])], names=["toxic", "n", "best"])

    tops = rows.mapInArrow(best, "toxic int, n bigint, best double").toPandas()
    clean = tops[tops.toxic == 0]
    model.k = float(len(clean) / max((np.maximum(clean["n"], 1) * np.exp(-model.lam * clean["best"])).sum(), 1e-9))

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text")):
            x = np.array([evidence(n, found, model) for n, found, *_ in _scan(b.column("text"), model)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "one", "all"])

    fit = rows.mapInArrow(proofs, "toxic int, one double, all double").toPandas()
    x = np.stack([np.ones(len(fit)), fit["one"], np.sqrt(fit["all"])], axis=1)
    model.weights = tuple(float(v) for v in logistic(x, fit["toxic"].to_numpy(float), ridge=1.0))
    return model


PASSAGE = "array<struct<first_word: bigint, last_word: bigint, score: double, e_value: double>>"


def toxic_passages(docs: DataFrame, model: ToxicityModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, score, n_words, passages: every significant passage by its first and last word, with score and E-value.

    Null and empty texts have no words, no passages, and the score of a text without any evidence. Whole texts are
    scanned, however long. Repeated rows are rows of their own, null ids stay null, an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "t")):
            score, size, passages = [], [], []
            for n, found, _, _, first, h in _scan(b.column("t"), model):
                score.append(probability(evidence(n, found, model), model))
                size.append(n)
                e = [model.k * max(n, 1) * math.exp(-model.lam * s) for _, _, s in found]
                passages.append([{"first_word": int(h[i] - first), "last_word": int(h[j] - first), "score": s, "e_value": x} for (i, j, s), x in zip(found, e, strict=True) if x < SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(size, pa.int64()), pa.array(passages, kind)], names=["id", "score", "n_words", "passages"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id bigint, score double, n_words bigint, passages {PASSAGE}").withColumnRenamed("id", id_col)
