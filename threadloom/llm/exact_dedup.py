"""Exact dedup: tree-merge of sorted digest runs.

Every partition turns its texts into one run of (digest, best row, count), sorted by digest. The partitions
then stand at the corners of a hypercube with `radix` points to a side. In round r each partition hands every
partition that differs from it in digit r alone the part of its run whose digests carry that partition's
digit, and merges the runs it gets, verifying that equal digests stand for equal lengths and second hashes. What
arrives is one sorted run from each of the radix senders, end to end; Spark's sorter is a TimSort, which finds these
runs and merges them instead of sorting anew, and merges by a priority queue what it had to spill, so that a merge
is bounded in memory whatever the runs' length. After the last round a partition holds one slice of the digest
space and nothing is ever gathered in one place; a digest occurs at most once in a run, so a group of copies costs
a partition one row however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table, rows_kept

RADIX = 4
RUN = "digest binary, bytes bigint, check bigint, id bigint, row bigint, copies bigint, dest int"


def _corners(wanted: int, radix: int) -> tuple[int, int]:
    rounds = 1
    while radix**rounds < wanted:
        rounds += 1
    return radix**rounds, rounds


def _merged(batches: Iterator[pa.RecordBatch], keep_largest: bool, corners: int, radix: int, to_round: int | None) -> Iterator[pa.RecordBatch]:
    """Joins neighbours with one digest in a sorted stream of runs. Equal digests must agree in length and second hash."""
    node = TaskContext.get().partitionId() % corners
    held: list[np.ndarray] | None = None

    def routed(cols: list[np.ndarray]) -> pa.RecordBatch:
        digest = cols[0]
        if to_round is None:
            dest = np.zeros(len(digest), np.int32)
        else:
            slot = (digest[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])) % corners
            step = radix**to_round
            dest = (node + (slot // step % radix - node // step % radix) * step).astype(np.int32)
        blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(digest), [None, pa.py_buffer(np.ascontiguousarray(digest))]).cast(pa.binary())
        absent = cols[3] == np.iinfo(np.int64).min
        return pa.RecordBatch.from_arrays([blob, *(pa.array(c, mask=absent if k == 2 else None) for k, c in enumerate(cols[1:])), pa.array(dest)], names=["digest", "bytes", "check", "id", "row", "copies", "dest"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id")
        digest = np.frombuffer(batch.column("digest").cast(pa.binary(32)).buffers()[1], np.uint8).reshape(-1, 32)[batch.column("digest").offset :][: batch.num_rows]
        cols = [digest, *(batch.column(c).to_numpy() for c in ("bytes", "check")), ids.fill_null(np.iinfo(np.int64).min).to_numpy(), *(batch.column(c).to_numpy() for c in ("row", "copies"))]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        same = (cols[0][1:] == cols[0][:-1]).all(axis=1)
        if (same & ((cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))).any():
            raise ValueError("two texts share a SHA-256 digest and differ in length or second hash")
        starts = np.flatnonzero(np.r_[True, ~same])
        group = np.cumsum(np.r_[True, ~same]) - 1
        rank = cols[3] if keep_largest else np.where(cols[3] == np.iinfo(np.int64).min, cols[3], -cols[3])
        order = np.lexsort((-cols[4], rank, group))  # the last of each group is the row that stays; of repeated ids the first row
        best = order[np.r_[starts[1:], len(order)] - 1]
        cols = [cols[0][starts], cols[1][starts], cols[2][starts], cols[3][best], cols[4][best], np.add.reduceat(cols[5], starts)]
        held = [c[-1:] for c in cols]
        if len(cols[0]) > 1:
            yield routed([c[:-1] for c in cols])
    if held is not None:
        yield routed(held)


def digest_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, digest, bytes, check, row) of every row; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("t")).select(
        "id", F.unhex(F.sha2(F.col("t"), 256)).alias("digest"), F.octet_length("t").cast("bigint").alias("bytes"), F.xxhash64("t").alias("check"), F.monotonically_increasing_id().alias("row")
    )


def merge_runs(rows: DataFrame, keep: str = "largest", partitions: int | None = None, radix: int = RADIX) -> DataFrame:
    """One row for each digest, with the row that stays and the number of copies."""
    spark = rows.sparkSession
    corners, rounds = _corners(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), radix)
    largest = keep == "largest"

    def step(to_round):
        return lambda batches: _merged(batches, largest, corners, radix, to_round)

    runs = rows.withColumn("copies", F.lit(1).cast("bigint")).sortWithinPartitions("digest").mapInArrow(step(0), RUN)
    for r in range(rounds):
        runs = runs.repartitionById(corners, F.col("dest")).drop("dest").sortWithinPartitions("digest").mapInArrow(step(r + 1 if r + 1 < rounds else None), RUN)
    return runs.drop("dest")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "largest", partitions: int | None = None, radix: int = RADIX) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical, unchanged. Null text counts as empty, so null and empty texts are one
    group. Of each group one row stays: that with the largest id (keep="smallest": the smallest), null ids last;
    of repeated rows with one id and text exactly one stays. keep_id is null only if all ids of the group are.
    An empty table gives an empty result; columns other than the two named are ignored.
    """
    rows = kept_table(digest_rows(docs, text_col, id_col), "digests")
    best = merge_runs(rows, keep, partitions, radix).filter("copies > 1").select("digest", F.col("id").alias("best"), F.col("row").alias("best_row"), "copies")
    found = rows.join(best, "digest", "left")
    alone = F.col("copies").isNull()
    return found.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    best = kept_table(merge_runs(digest_rows(docs, text_col, id_col), keep).select(F.col("id").alias(id_col), "digest"), "winners")
    return rows_kept(docs, best, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), id_col)
