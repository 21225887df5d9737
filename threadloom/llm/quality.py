"""Quality classifier: document evidence under hierarchical empirical Bayes priors of hosts and paths.

A logistic classifier on the make-up of a text gives each document its own evidence. Hosts and the paths below
them have quality rates of their own: a Beta prior fitted to the spread between hosts shrinks sparse hosts to the
global rate, one fitted to the spread within hosts shrinks sparse paths to their host. A document's posterior
log-odds are its own plus what the rate of the other documents of its path adds to the global rate; its own score
is left out of its site, so that no evidence counts twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_struct, kept_table, text_bounds, text_buffer
from .toxicity import logistic
from .words import IS_WORD, span_hashes, spans_of

#: Labelled rows that the classifier is fitted on at most, those of smallest hash of the id.
SAMPLE = 20_000
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13), "other": range(128, 256),
    "stop": (46, 44, 59, 58), "shout": (33, 63), "bar": (124,), "symbol": (35, 36, 37, 38, 42, 64, 94, 126, 43, 61, 92), "bracket": (40, 41, 60, 62, 91, 93, 123, 125), "quote": (34, 39, 96, 45, 95, 47),
}


def text_make_up(column: pa.Array) -> np.ndarray:
    """For each text: 1, root shares of kinds of bytes, logs of words, mean length, shares of distinct words and pairs, whether empty."""
    flat, offsets = text_buffer(column)
    n = np.diff(offsets)
    kind = np.zeros(256, np.int64)
    for k, members in enumerate(CLASSES.values()):
        kind[list(members)] = k + 1
    width = len(CLASSES) + 1
    doc = np.repeat(np.arange(len(n)), n)
    shares = np.bincount(doc * width + kind[flat], minlength=len(n) * width).reshape(-1, width) / np.maximum(n, 1)[:, None]
    starts, ends = spans_of(IS_WORD[flat], offsets)
    hashes = span_hashes(flat, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(n)), count)

    def distinct(h: np.ndarray, of: np.ndarray, most: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, of))
        a, o = h[order], of[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (o[1:] != o[:-1])] if len(a) else np.zeros(0, bool)
        return np.bincount(o[new], minlength=len(n)) / np.maximum(most, 1)

    pair = hashes[1:] * np.uint64(3) + hashes[:-1] if len(hashes) > 1 else np.zeros(0, np.uint64)
    within = owner[1:] == owner[:-1]
    words_ = distinct(hashes, owner, count)
    pairs = distinct(pair[within], owner[1:][within], count - 1)
    letters = np.bincount(owner, ends - starts, len(n)) / np.maximum(count, 1)
    log_words = np.log1p(count)
    return np.column_stack([np.ones(len(n)), np.sqrt(shares[:, 1:]), log_words, log_words**2 / 10, np.log1p(letters), words_, words_**2, pairs, words_ * log_words, count == 0])


def whole_make_up(column: pa.Array) -> np.ndarray:
    """text_make_up of a column of any size, slice by slice."""
    return np.concatenate([text_make_up(column.slice(lo, hi - lo)) for lo, hi in text_bounds(column)] or [text_make_up(column)])


def _classify(weights: np.ndarray):
    @arrow_udf("double")
    def own_quality(text: pa.Array) -> pa.Array:
        z = np.clip(whole_make_up(text) @ weights, -12, 12)
        return pa.array(1 / (1 + np.exp(-z)))

    return own_quality


def fit_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> np.ndarray:
    """Classifier weights from at most `sample` rows of labels (id_col, quality 0/1) and as many of docs; nulls don't count, of rows that repeat an id one does. Without both classes the weights are 0 but for the constant."""
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = kept_table(chosen, "labels")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` rows of 12 bytes

    @arrow_udf("array<double>")
    def make_up(text: pa.Array) -> pa.Array:
        x = whole_make_up(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    # One row an id: a group keeps its row of smallest text hash, and no more than `sample` rows reach the driver.
    made = rows.select("id", "quality", F.xxhash64("text").alias("h"), make_up(F.coalesce("text", F.lit(""))).alias("x"))
    seen = made.groupBy("id").agg(F.min_by(F.struct("quality", "x"), F.struct("h", "x")).alias("s")).select("id", "s.*").toPandas().sort_values("id")
    width = text_make_up(pa.array([""])).shape[1]
    if seen["quality"].nunique() < 2:
        weights = np.zeros(width)
        weights[0] = 4.0 if not len(seen) or seen["quality"].iloc[0] else -4.0
        return weights
    return logistic(np.stack(seen["x"].to_numpy()), seen["quality"].to_numpy(float), ridge=0.3)


def host_of(source: Column) -> Column:
    """The part of a source or address up to the first single slash, in lower case; null is a host of its own."""
    bare = F.regexp_replace(F.lower(source), r"^[a-z][a-z0-9+.-]*://", "")
    return F.coalesce(F.substring_index(bare, "/", 1), F.lit(""))


def path_of(source: Column, within: Column) -> Column:
    """The first step of the path, or else what `within` says."""
    bare = F.regexp_replace(F.lower(source), r"^[a-z][a-z0-9+.-]*://", "")
    step = F.get(F.split(bare, "/"), F.lit(1))
    return F.coalesce(F.when(step != "", step), within, F.lit(""))


def site_rates(scored: DataFrame) -> DataFrame:
    """(host, path, n, good, host_n, host_good, of_host, of_path, host_rate, path_rate, global_rate) from (host, path, own): posterior means under moment-fitted Beta priors.

    A prior's strength (of_host, of_path) is rate (1 - rate) / variance - 1, the variance being what the spread of
    group means leaves after the spread expected of means of so many documents; 1 at least and 1e6 at most. What is
    grouped twice never holds more than a row for each path.
    """
    paths = kept_table(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("good"), F.sum(F.col("own") * F.col("own")).alias("square")), "paths")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("square").alias("square"), F.count("*").alias("paths"), F.countDistinct("host").alias("hosts")).first()
    n = whole["n"] or 1
    rate = min(max((whole["good"] or 0.0) / n, 0.001), 0.999)
    noise = max((whole["square"] or 0.0) / n - ((whole["good"] or 0.0) / n) ** 2, 0.0)

    def strength(spread: float | None, groups: int) -> float:
        """spread: the mean square distance of group means from their prior mean, by documents."""
        left = max((spread or 0.0) - noise * groups / n, 1e-9)
        return min(max(rate * (1 - rate) / left - 1, 1.0), 1e6)

    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    between = hosts.agg(F.sum(F.col("host_n") * F.pow(F.col("host_good") / F.col("host_n") - rate, 2)) / n).first()[0]
    of_host = strength(between, whole["hosts"])
    hosts = hosts.withColumn("host_rate", shrunk(F.col("host_good"), F.col("host_n"), F.lit(rate), F.lit(of_host)))
    met = kept_table(paths.join(hosts, "host"), "met")
    inner = met.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("host_rate"), 2)) / n).first()[0]
    of_path = F.lit(strength(inner, whole["paths"]))
    path_rate = shrunk(F.col("good"), F.col("n"), F.col("host_rate"), of_path)
    return met.select("host", "path", "n", "good", "host_n", "host_good", F.lit(of_host).alias("of_host"), of_path.alias("of_path"), "host_rate", path_rate.alias("path_rate"), F.lit(rate).alias("global_rate"))


def shrunk(good: Column, n: Column, prior: Column, strength: Column) -> Column:
    """The posterior mean of a rate with `good` of n, under a Beta prior of that mean and strength."""
    return (good + strength * prior) / (n + strength)


def without_own(own: Column) -> Column:
    """A document's path rate when its own score is taken out of its path and host, from the columns of site_rates."""
    host = shrunk(F.greatest(F.col("host_good") - own, F.lit(0.0)), F.col("host_n") - 1, F.col("global_rate"), F.col("of_host"))
    return shrunk(F.greatest(F.col("good") - own, F.lit(0.0)), F.col("n") - 1, host, F.col("of_path"))


def _log_odds(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def posterior(own: Column, path_rate: Column, global_rate: Column) -> Column:
    z = _log_odds(own) + _log_odds(path_rate) - _log_odds(global_rate)
    return 1 / (1 + F.exp(-z))


def _judged(docs: DataFrame, weights: np.ndarray, text_col: str, source_col: str, path: Column | None) -> DataFrame:
    """(whole, own, host_rate, path_rate, score): every row of docs as the struct `whole`, so that no column's name can clash."""
    source = F.col(source_col)
    below = path if path is not None else path_of(source, F.col("lang") if "lang" in docs.columns else F.lit(""))
    own = _classify(weights)(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.select(as_struct(docs).alias("whole"), host_of(source).alias("host"), below.alias("path"), own.alias("own"))
    return marked.withColumn("path", F.coalesce("path", F.lit("")))


def _scored(marked: DataFrame) -> DataFrame:
    rates = kept_table(site_rates(marked.select("host", "path", "own")), "rates")
    met = marked.join(rates, ["host", "path"])
    return met.withColumn("score", posterior(F.col("own"), without_own(F.col("own")), F.col("global_rate")))


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", path: Column | None = None, least: float = 0.5) -> DataFrame:
    """One row for each row of docs: id_col, own_score, host_rate, path_rate, score, kept.

    Null text counts as empty; a null source is a host of its own, a null path the empty one. host_rate and
    path_rate are those of the whole site, score leaves the document's own part out of them. kept is
    score >= least. Repeated rows are rows of their own; an empty table gives no rows; other columns are ignored.
    """
    marked = kept_table(_judged(docs.select(*dict.fromkeys((id_col, text_col, source_col, *(["lang"] if "lang" in docs.columns else [])))), weights, text_col, source_col, path).withColumn("whole", F.col(f"whole.`{id_col}`")), "own")
    return _scored(marked).select(F.col("whole").alias(id_col), F.col("own").alias("own_score"), "host_rate", "path_rate", "score").withColumn("kept", F.col("score") >= least)


def keep_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text", source_col: str = "source", path: Column | None = None, least: float = 0.5) -> DataFrame:
    """The rows of docs with score >= least, with all their columns; nulls, repeated rows and empty tables as in score_quality.

    Rows are written beside their own scores, which sites and the decision both need: reading them back takes a
    fraction of what scoring whole texts again would.
    """
    return _scored(kept_table(_judged(docs, weights, text_col, source_col, path), "judged")).filter(F.col("score") >= least).select("whole.*")
