"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors are rotated and split into blocks of few dimensions. cos >= c means |a-b|^2 <= 2-2c, so in one
block at least the squared distance is within the block's share of that, in proportion to its dimensions.
Each block is range-joined on its own: median cuts of a sample that grows with the leaves give these, a leaf that is
still too full is split into parts that meet in pairs, a vector lies in one leaf and
visits the later leaves that its budget reaches, each cut crossed spending what its gap adds to the squared
distance. Only block coordinates travel for that; what has a near vector in some leaf goes on with its whole
vector and is verified in double precision. A pair counts in the first block where it is near and in the later of
its two leaves, so it is counted once. A task sends on counts and spanning links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table
from .grouping import binary_matrix, components, local_roots

#: Dimensions of a block, about: wide enough that unrelated vectors are hardly ever near in one.
BLOCK_DIMS = 16
#: Vectors that a leaf should hold.
LEAF = 8192
#: Vectors from which the cuts are taken: so many at least, and so many for each leaf, which is one in 2048 of all. They
#: come to the driver as float32. They place the cuts only; any cuts give the same result.
SAMPLE, PER_LEAF = 16384, 4
#: A leaf of more than so many times the vectors it should hold is split into parts.
FULL = 4
#: Bits of a task's number for the part of a leaf.
PARTS = 20
#: Rows and columns of the largest matrix of distances.
CHUNK = 1024
#: Values that rounding could carry over a bound are computed again, by one formula for all tasks.
CLOSE = 1e-12


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[slice]:
    ends = np.cumsum([len(x) for x in np.array_split(np.arange(dims), max(1, round(dims / BLOCK_DIMS)))])
    return [slice(int(a), int(b)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def budgets(dims: int, threshold: float) -> list[float]:
    """Each block's share of the squared distance that a link may have, with what rounding may add."""
    share = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12
    return [share * (s.stop - s.start) / dims for s in blocks_of(dims)]


def cuts_of(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and medians of a complete binary tree in heap order; a node cuts the dimension in which its points spread most."""
    dims, cuts = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
    held = {0: points}
    for node in range(len(cuts)):
        p = held.pop(node)
        if len(p):
            dims[node] = int(p.var(axis=0).argmax())
            cuts[node] = float(np.median(p[:, dims[node]]))
        right = p[:, dims[node]] > cuts[node]
        held[2 * node + 1], held[2 * node + 2] = p[~right], p[right]
    return dims, cuts


def leaves_within(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each point's own leaf, and (point, leaf) for all later leaves whose cells may hold points within the squared distance."""
    dims, cuts = tree
    n = len(points)
    at, node, spent, gaps = np.arange(n), np.zeros(n, np.int64), np.zeros(n), np.zeros_like(points)
    for _ in range(int(np.log2(len(cuts) + 1))):
        d = dims[node]
        x = points[at, d]
        right = x > cuts[node]
        away = (x - cuts[node]) ** 2
        more = np.maximum(away - gaps[np.arange(len(at)), d], 0)
        over = np.flatnonzero(spent + more <= budget)
        far = gaps[over]
        far[np.arange(len(over)), d[over]] += more[over]
        home, other = 2 * node + 1 + right, 2 * node[over] + 2 - right[over]
        at, node, spent, gaps = np.concatenate([at, at[over]]), np.concatenate([home, other]), np.concatenate([spent, (spent + more)[over]]), np.concatenate([gaps, far])
    own, leaf = node[:n] - len(cuts), node[n:] - len(cuts)
    keep = leaf > own[at[n:]]
    return own, at[n:][keep], leaf[keep]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(c), dims)


def _sampled(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as float32 place cuts; those whose components leave that range don't count."""
    x = _matrix(column, dims)
    return x[np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _deal(dims: int, trees: list[tuple[np.ndarray, np.ndarray]], budget: list[float]):
    """Each vector's block coordinates once as data in its leaf of every block, and as a visitor in later leaves."""
    turn = rotation(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, ids = _matrix(b.column("v"), dims), b.column("vec").to_numpy()
            for lo in range(0, b.num_rows, 2048):
                rotated = _unit(v[lo : lo + 2048]) @ turn
                for k, s in enumerate(blocks_of(dims)):
                    own, at, leaf = leaves_within(rotated[:, s], trees[k], budget[k])
                    who, task = np.concatenate([np.arange(len(own)), at]), (np.int64(k) << 48) | (np.concatenate([own, leaf]) << PARTS)
                    visits = np.arange(len(who)) >= len(own)
                    flat = np.ascontiguousarray(rotated[:, s], np.float32)
                    for x in range(0, len(who), 8192):
                        part = flat[who[x : x + 8192]]
                        blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * flat.shape[1]), len(part), [None, pa.py_buffer(part)]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(task[x : x + 8192]), pa.array(visits[x : x + 8192]), pa.array(ids[lo + who[x : x + 8192]]), blob], names=["task", "visitor", "vec", "x"])

    return run


def _loads(dims: int, trees: list[tuple[np.ndarray, np.ndarray]]):
    """(task, n) of each batch: how many vectors lie in a leaf."""
    turn = rotation(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), dims)
            for lo in range(0, b.num_rows, 2048):
                rotated = _unit(v[lo : lo + 2048]) @ turn
                found = [(np.int64(k) << 48) | (leaves_within(rotated[:, s], trees[k], -1.0)[0] << PARTS) for k, s in enumerate(blocks_of(dims))]
                task, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(n)], names=["task", "n"])

    return run


def _parted(dealt: DataFrame, full: DataFrame) -> DataFrame:
    """Rows of full leaves (task, parts) dealt to parts: a vector is data in one part and visits the later ones, a visitor visits all."""
    rows = dealt.join(full, "task", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    own = F.pmod(F.xxhash64("vec"), F.col("parts"))
    first = F.when(F.col("visitor"), F.lit(0).cast("bigint")).otherwise(own)
    rows = rows.withColumn("own", own).withColumn("part", F.explode(F.sequence(first, F.col("parts") - 1)))
    return rows.select((F.col("task") + F.col("part")).alias("task"), (F.col("visitor") | (F.col("part") != F.col("own"))).alias("visitor"), "vec", "x")


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch, bool]]:
    """(task, whether visitors, rows, whether these are the last of the task) of a stream sorted by task and visitor."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        task, visits = b.column("task").to_numpy(), b.column("visitor").to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero((task[1:] != task[:-1]) | (visits[1:] != visits[:-1])) + 1, len(task)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held is not None:
                yield (*held, held[0] != task[lo])
            held = (int(task[lo]), bool(visits[lo]), b.slice(lo, hi - lo))
    if held is not None:
        yield (*held, True)


def _widened(x: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """p, q with p[i] @ q[j] = |x[i] - x[j]|^2 - budget, but for rounding."""
    square, one = (x * x).sum(axis=1), np.ones(len(x), np.float32)
    return np.column_stack([-2 * x, square - np.float32(budget + 1e-5), one]), np.column_stack([x, one, square])


def _near(budget: list[float], widths: list[int]):
    """The rows of a leaf, data and visitors, that have a near vector there in the leaf's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[pa.RecordBatch] = []
        p = q = ids = met = None

        def out(task: int, visits: bool, vec: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(vec), task)), pa.array(np.full(len(vec), visits)), pa.array(vec)], names=["task", "visitor", "vec"])

        for task, visits, b, last in _tasks(batches):
            k = task >> 48
            if not visits:
                fresh.append(b)
            if fresh and (visits or last):  # the leaf's data are complete
                t = pa.Table.from_batches(fresh)
                fresh = []
                ids = t.column("vec").to_numpy()
                p, q = _widened(binary_matrix(t.column("x"), np.float32, widths[k]), budget[k])
                met = np.zeros(len(ids), bool)
                for i in range(0, len(ids), CHUNK):
                    for j in range(i, len(ids), CHUNK):
                        gap = p[i : i + CHUNK] @ q[j : j + CHUNK].T
                        if i == j:
                            np.fill_diagonal(gap, 1)
                        rows = np.flatnonzero(gap.min(axis=1) <= 0)
                        if len(rows):
                            met[i + rows] = True
                            met[j + np.flatnonzero((gap[rows] <= 0).any(axis=0))] = True
            if visits and ids is not None:
                x = _widened(binary_matrix(b.column("x"), np.float32, widths[k]), budget[k])[0]
                vec, hit = b.column("vec").to_numpy(), np.zeros(b.num_rows, bool)
                for i in range(0, len(x), CHUNK):
                    for j in range(0, len(ids), CHUNK):
                        gap = x[i : i + CHUNK] @ q[j : j + CHUNK].T
                        rows = np.flatnonzero(gap.min(axis=1) <= 0)
                        if len(rows):
                            hit[i + rows] = True
                            met[j + np.flatnonzero((gap[rows] <= 0).any(axis=0))] = True
                if hit.any():
                    yield out(task, True, vec[hit])
            if last:
                if met is not None and met.any():
                    yield out(task, False, ids[met])
                p = q = ids = met = None

    return run


def _compare(dims: int, threshold: float, budget: list[float]):
    """Counts and spanning links of a leaf's pairs, verified on whole vectors."""
    turn, parts = rotation(dims), blocks_of(dims)

    def within(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, k: int) -> np.ndarray:
        """Which pairs are near in block k."""
        xa, xb = ra[:, parts[k]], rb[:, parts[k]]
        away = (xa * xa).sum(1)[:, None] + (xb * xb).sum(1)[None, :] - 2 * (xa @ xb.T)
        near = away <= budget[k]
        i, j = np.nonzero(np.abs(away - budget[k]) < CLOSE)
        for lo in range(0, len(i), 256):
            gap = (a[i[lo : lo + 256]] - b[j[lo : lo + 256]])[:, None, :] * turn.T[parts[k]][None]
            near[i[lo : lo + 256], j[lo : lo + 256]] = (gap.sum(axis=2) ** 2).sum(axis=1) <= budget[k]
        return near

    def links(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that block k counts; of a chunk with itself each once."""
        mine = within(a, b, ra, rb, k)
        if same:
            mine &= ~np.tri(len(a), dtype=bool)
        for other in range(k if mine.any() else 0):
            mine &= ~within(a, b, ra, rb, other)
        if not mine.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cosine = a @ b.T
        i, j = np.nonzero(mine & (np.abs(cosine - threshold) < CLOSE))
        cosine[i, j] = (a[i] * b[j]).sum(axis=1)
        return np.nonzero(mine & (cosine >= threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[pa.RecordBatch] = []
        one = rot = ids = many = None
        held: list = []

        def note(names: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(i):
                return
            root = local_roots(len(names), i, j)
            count = np.bincount(np.concatenate([i, j]), np.concatenate([copies[j], copies[i]]), len(names))
            some = np.flatnonzero(count)
            held.append((names[some], names[root[some]], count[some]))
            if sum(len(x[0]) for x in held) > 100_000:
                yield flush()

        def flush() -> pa.RecordBatch:
            a, r, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            pair, at = np.unique(np.stack([a, r]), axis=1, return_inverse=True)
            total = np.bincount(at.ravel(), weights=n).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(total)], names=["vec", "root", "links"])

        for task, visits, b, last in _tasks(batches):
            k = task >> 48
            if not visits:
                fresh.append(b)
            if fresh and (visits or last):
                t = pa.Table.from_batches(fresh)
                fresh = []
                ids, many, one = t.column("vec").to_numpy(), t.column("copies").to_numpy(), _unit(_matrix(t.column("v"), dims))
                rot = one @ turn
                for i in range(0, len(ids), CHUNK):
                    for j in range(i, len(ids), CHUNK):
                        x, y = slice(i, i + CHUNK), slice(j, j + CHUNK)
                        p, q = links(one[x], one[y], rot[x], rot[y], k, i == j)
                        n = len(ids[x]) if i != j else 0
                        yield from note(np.concatenate([ids[x], ids[y]]) if n else ids[x], np.concatenate([many[x], many[y]]) if n else many[x], p, n + q)
            if visits and ids is not None:
                mine, names, copies = _unit(_matrix(b.column("v"), dims)), b.column("vec").to_numpy(), b.column("copies").to_numpy()
                turned = mine @ turn
                for i in range(0, len(names), CHUNK):
                    for j in range(0, len(ids), CHUNK):
                        x, y = slice(i, i + CHUNK), slice(j, j + CHUNK)
                        p, q = links(mine[x], one[y], turned[x], rot[y], k, False)
                        yield from note(np.concatenate([names[x], ids[y]]), np.concatenate([copies[x], many[y]]), p, len(names[x]) + q)
            if last:
                one = rot = ids = many = None
        if held:
            yield flush()

    return run


def _links(used: DataFrame, dims: int, n: int, threshold: float, leaf: int) -> DataFrame:
    """(vec, root, links) among classes (v, vec, copies) of n vectors of one length."""
    budget, parts = budgets(dims, threshold), blocks_of(dims)
    levels = max(0, int(np.ceil(np.log2(max(n / leaf, 1)))))
    few = min(1.0, 1.1 * max(SAMPLE, PER_LEAF << levels) / max(n, 1))
    taken = used.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(np.ceil(few * (1 << 30)))).select(F.col("v").cast("array<float>").alias("v")).toArrow() if levels else None
    points = np.zeros((0, dims), np.float32)
    if levels and taken.num_rows:
        points = (_unit(_sampled(taken.column("v"), dims)) @ rotation(dims)).astype(np.float32)
    trees = [cuts_of(points[:, s], levels) for s in parts]
    dealt = used.select("vec", "v").mapInArrow(_deal(dims, trees, budget), "task bigint, visitor boolean, vec bigint, x binary")
    if levels:
        loads = used.select("v").mapInArrow(_loads(dims, trees), "task bigint, n bigint").groupBy("task").agg(F.sum("n").alias("n"))
        full = kept_table(loads.filter(F.col("n") > FULL * leaf).select("task", F.ceil(F.col("n") / leaf).cast("bigint").alias("parts")), "full-leaves")
        if not full.isEmpty():
            dealt = _parted(dealt, full)
    near = dealt.repartition("task").sortWithinPartitions("task", "visitor").mapInArrow(_near(budget, [s.stop - s.start for s in parts]), "task bigint, visitor boolean, vec bigint")
    met = kept_table(near, "near").hint("merge").join(used, "vec").select("task", "visitor", "vec", "copies", "v")
    return met.repartition("task").sortWithinPartitions("task", "visitor").mapInArrow(_compare(dims, threshold, budget), "vec bigint, root bigint, links bigint")


def embedding_join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, leaf: int = LEAF) -> DataFrame:
    """One row for each row of vectors: id_col, n_links, component_id, kept.

    Vectors are linked if their cosine in double precision is at least threshold (over 0). Null, empty and zero
    vectors and those with null or non-finite components link with nothing. Vectors of every length that occurs are
    compared, with those of their own length. n_links counts the other vectors linked directly,
    component_id is the smallest id reachable by links, the own one included. kept: id = component_id. Rows
    with null id link with nothing, their component_id is null and kept is true. Rows that repeat an id with
    different vectors are vectors of their own that share it; a repeated id makes `kept` true for each.
    """
    spark = vectors.sparkSession
    e = F.col("e")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    base = kept_table(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("e"), F.monotonically_increasing_id().alias("row")).withColumn("good", F.coalesce(F.col("id").isNotNull() & good, F.lit(False))), "vectors")
    lengths = base.filter("good").groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    if not lengths:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    # Equal vectors are one class, named by its first row.
    used = kept_table(base.filter("good").select("row", F.col("e").alias("v")).groupBy("v").agg(F.min("row").alias("vec"), F.count("*").alias("copies")), "used")
    found = [kept_table(_links(used.filter(F.size("v") == d), d, n, threshold, leaf), "links") for d, n in lengths if n > 1]
    links = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "vec bigint, root bigint, links bigint")
    counts = links.groupBy("vec").agg(F.sum("links").alias("n"))
    groups = components(links.select(F.col("vec").alias("a"), F.col("root").alias("b")).filter("a <> b")).select(F.col("node").alias("vec"), F.col("root"))
    groups = used.select("v", "vec", "copies").join(groups, "vec", "left").join(counts, "vec", "left").withColumn("root", F.coalesce("root", "vec"))
    classes = groups.select("v", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    named = base.filter("good").select("id", F.col("e").alias("v")).join(classes, "v").select("id", "root", "n")
    named = named.unionByName(base.filter("not good").select("id", F.lit(None).cast("bigint").alias("root"), F.lit(0).cast("bigint").alias("n")))
    named = kept_table(named, "named")
    least = kept_table(named.filter("root is not null").groupBy("root").agg(F.min("id").alias("least")), "least")
    named = named.join(least, "root", "left").withColumn("component", F.coalesce("least", "id"))
    return named.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
