"""Groups in sorted Arrow streams, and connected components by Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, kept_table


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the bounds of each, from a stream sorted by keys (integers without nulls). Holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def out(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        cols = [t.column(k).to_numpy() for k in keys]
        new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]
        return t, np.r_[np.flatnonzero(new), t.num_rows]

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        end = tuple(c[-1] for c in cols)
        tail = int(np.argmax(np.logical_and.reduce([c == e for c, e in zip(cols, end, strict=True)])))
        if tail == 0 and (last is None or last == end):
            held.append(b)
        else:
            yield out([*held, b.slice(0, tail)] if tail else held)
            held = [b.slice(tail)]
        last = end
    if held:
        yield out(held)


def binary_matrix(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.cast(pa.large_binary())
    if not len(c):
        return np.zeros((0, width), dtype)
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(c), width)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        fresh = root.copy()
        np.minimum.at(fresh, root[a], low)
        np.minimum.at(fresh, root[b], low)
        fresh = fresh[fresh]
        while (fresh != fresh[fresh]).any():
            fresh = fresh[fresh]
        root = fresh[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the smallest node reachable. Nodes without edges don't occur.

    Large-star and small-star in turn: every node hands its larger neighbours, then its smaller ones, to the
    smallest it knows, until nothing changes. Aggregates combine before they shuffle, and joins back to a node
    with very many neighbours can be split by adaptive execution.
    """

    def low_high(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(r)

    spark = edges.sparkSession
    edges = kept_table(low_high(edges), "edges")
    seen = mark(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written apart from the joins, so that adaptive execution can split a node with very many neighbours.
        least = kept_table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = kept_table(low_high(both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")), "large")
        down = kept_table(large.groupBy("b").agg(F.min("a").alias("m")), "down")
        small = large.join(down, "b").select(F.col("m").alias("x"), F.col("a").alias("y"), F.col("b").alias("z"))
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("x").alias("a"), F.col("z").alias("b")))).alias("e")).select("e.*")
        old, edges = [edges, least, large, down], kept_table(low_high(small), "edges")
        drop_tables(spark, old)
        fresh = mark(edges)
        if fresh == seen:
            break
        seen = fresh
    found = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return found.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
