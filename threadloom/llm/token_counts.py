"""Token counts: exact histogram of encoded lengths and its suffix sums.

Documents are encoded where they lie and only their lengths travel. The histogram has a row for each length
that occurs, so it is bounded by the longest document and not by the number of documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern that this vocabulary was made with; a fixed value of the tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Lengths in a span of the histogram.
SPAN = 256


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name=vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens) for each row; null and empty texts have 0 tokens, text of special tokens is ordinary text.

    Repeated rows are counted each, null ids stay null, an empty table gives no rows; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("t")).mapInArrow(count, f"`{id_col}` bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Suffix sums over the histogram of n_tokens, one row for each length that occurs.

    For a length L taken as context limit: docs of exactly L tokens, docs and tokens of at least that length,
    tokens_kept when every document is cut at L, tokens_cut by that, docs_cut that are longer than L, and the
    share of documents of at most L (the quantile of L). An empty table gives no row.
    """
    by = by or []
    n, length = F.col("n_docs"), F.col("n_tokens")
    # Two uses follow: the written table has a row for each length and keeps the texts from being encoded twice.
    counts = kept_table(lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs")).withColumn("_span", F.floor(length / SPAN)), "lengths")
    # Sums of spans of lengths first: no window holds more than SPAN lengths or all spans.
    down = W.partitionBy(*by).orderBy(F.desc("_span")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    spans = counts.groupBy(*by, "_span").agg(F.sum(n).alias("_docs"), F.sum(n * length).alias("_tokens"))
    spans = spans.select(
        *(F.col(c).alias(f"_k_{c}") for c in by), F.col("_span").alias("_at"), F.coalesce(F.sum("_docs").over(down), F.lit(0)).alias("_docs_above"), F.coalesce(F.sum("_tokens").over(down), F.lit(0)).alias("_tokens_above"),
        F.sum("_docs").over(whole).alias("docs_total"), F.sum("_tokens").over(whole).alias("tokens_total"),
    )
    met = F.col("_span") == F.col("_at")
    for c in by:
        met &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    within = W.partitionBy(*by, "_span").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    return (
        counts.join(spans, met)
        .withColumn("docs_at_least", F.col("_docs_above") + F.sum(n).over(within))
        .withColumn("tokens_at_least", F.col("_tokens_above") + F.sum(n * length).over(within))
        .withColumn("docs_cut", F.col("docs_at_least") - n)
        .withColumn("tokens_cut", (F.col("tokens_at_least") - n * length) - F.col("docs_cut") * length)
        .withColumn("tokens_kept", F.col("tokens_total") - F.col("tokens_cut"))
        .withColumn("share_up_to", (F.col("docs_total") - F.col("docs_cut")) / F.col("docs_total"))
        .select(*by, "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_total", "tokens_total", "docs_cut", "tokens_cut", "tokens_kept", "share_up_to")
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_cut, tokens_kept for any context limits, from the histogram alone."""
    n, length = F.col("n_docs"), F.col("n_tokens")
    cells = [F.struct(F.lit(int(x)).cast("bigint").alias("context"), F.coalesce(F.sum(F.when(length > x, n)), F.lit(0)).alias("docs_cut"), F.coalesce(F.sum(F.least(length, F.lit(int(x))) * n), F.lit(0)).alias("tokens_kept")) for x in limits]
    return histogram.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least that share of the documents doesn't exceed; exact."""
    out = histogram.select(*(F.min(F.when(F.col("share_up_to") >= q, F.col("n_tokens"))).alias(str(i)) for i, q in enumerate(shares)))
    return out.select(F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(str(i)).alias("n_tokens")) for i, q in enumerate(shares)))).alias("x")).select("x.*")
