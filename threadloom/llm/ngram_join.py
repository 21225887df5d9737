"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts that are equal are one class from the start. Every class has a MinHash signature dealt to `trees` paths of
`depth` values, and each tree is a trie of the paths in order. A trie's parts below prefixes of `stop` values lie in
one task each, sorted by the rest of their paths; `stop` is where a pair at the threshold has met in some tree with
the target recall, so no prefix has to be shorter. Such a part is walked from full paths up: members that share a
prefix are gathered around leaders, and a leader covers those whose signatures agree as much as linked sets do. A
covered member is done; only leaders and members without a match go on with a shorter prefix, and so on until the
target recall is reached. Leaders are tied to all that a covered set could still be linked with, so ties connect
whatever is linked and there are never more of them than members and leaders call for. Crowded parts are cut into
blocks, whose leaders then meet in pairs of blocks. Tied classes form candidate components; within these all
shingle sets are compared exactly, in pairs of blocks, and only counts and spanning ties leave a task, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table, rows_kept, slices
from .grouping import binary_matrix, components, local_roots, whole_groups
from .words import mixed, shingles, words

TREES, DEPTH, RECALL = 16, 8, 0.995
#: Sets of a component that one task compares with as many others, and the bytes of their shingles, on average.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Members of a trie's part that are gathered at once.
GATHER = 1024
#: What a signature's agreement may fall short of the similarity: two to three standard errors.
SLACK = 0.1


def recall(similarity: float, trees: int, prefix: int) -> float:
    return 1 - (1 - similarity**prefix) ** trees


def stop_of(threshold: float, trees: int, depth: int, target: float) -> int:
    """The shortest prefix that the walk needs: where pairs at the threshold have met with the target recall (1 at least)."""
    stop = depth
    while stop > 1 and recall(threshold, trees, stop) < target:
        stop -= 1
    return stop


def signatures(sets: np.ndarray, at: np.ndarray, values: int) -> np.ndarray:
    """(texts, values) smallest permuted hashes, 32 bits each; sets without members have all ones."""
    factors = np.random.default_rng(7).integers(1, 2**63, values, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.full((len(at) - 1, values), 0xFFFFFFFF, np.uint32)
    for k, f in enumerate(factors if len(full) else []):
        out[full, k] = (np.minimum.reduceat(mixed_once(sets * f), at[full]) >> np.uint64(32)).astype(np.uint32)
    return out


def mixed_once(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(29))


def _sketches(size: int, trees: int, depth: int, stop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "t")):
            hashes, _, _, first, _ = words(b.column("t"))
            sets, at = shingles(hashes, first, size)
            sig = signatures(sets, at, trees * depth)
            paths = sig.reshape(-1, trees, depth)
            key = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), paths.shape[:2]).copy()
            for k in range(stop):
                key = mixed(key * np.uint64(0x9FB21C651E98DF25) + paths[:, :, k].astype(np.uint64))
            some = np.diff(at) > 0
            nodes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(some, trees, 0))].astype(np.int32)), pa.array(key[some].view(np.int64).ravel()))
            low = (sig & 0xFFFF).astype("<u2")
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), b.column("digest"), nodes, pa.array([r.tobytes() for r in low], pa.binary())], names=["id", "row", "digest", "nodes", "signature"])

    return run


def walk(sig: np.ndarray, paths: np.ndarray, cover: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gathers a trie's part from full paths up: (who is not covered, ties a, ties b). paths: the rest of each member's path.

    A leader that covers others stays one and meets all members of each longer run, covered ones too, so that what
    is linked with a covered member is tied to its leader.
    """
    n = len(sig)
    if n == 2:
        met = (sig[0] == sig[1]).mean() >= reach
        return np.array([True, not met]), np.zeros(int(met), np.int64), np.ones(int(met), np.int64)
    order = np.lexsort(paths.T[::-1]) if paths.shape[1] else np.arange(n)
    sig, paths = sig[order], paths[order]
    shared = np.cumprod(paths[1:] == paths[:-1], axis=1).sum(axis=1)
    covered, leads = np.zeros(n, bool), np.zeros(n, bool)
    a, b = [], []
    for level in range(paths.shape[1], -1, -1):
        edges = np.r_[0, np.flatnonzero(shared < level) + 1, n]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2 or (level < paths.shape[1] and shared[lo : hi - 1].min() > level):
                continue  # alone, or no larger than the run below
            here = np.arange(lo, hi)
            for i in (*here[leads[lo:hi]], *here[~leads[lo:hi]]):
                if covered[i]:
                    continue
                alike = (sig[lo:hi] == sig[i]).mean(axis=1)
                near = lo + np.flatnonzero(alike >= reach)
                a.append(np.full(len(near), i)), b.append(near)
                done = (alike >= cover) & ~covered[lo:hi] & ~leads[lo:hi]
                done[i - lo] = False
                covered[lo:hi] |= done
                leads[i] |= done.any()
    none = [np.zeros(0, np.int64)]
    open_ = np.zeros(n, bool)
    open_[order[~covered]] = True
    return open_, order[np.concatenate(a or none)], order[np.concatenate(b or none)]


def _gather(trees: int, depth: int, stop: int, cover: float, reach: float):
    """For each block spanning ties (a, b) of what its leaders tie together, and its leaders (a, a) with their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["node", "block"]):
            sig = binary_matrix(t.column("signature"), "<u2", trees * depth)
            node, tree = t.column("node").to_numpy(), t.column("tree").to_numpy()
            is_leader, root = np.zeros(t.num_rows, bool), np.arange(t.num_rows)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part, k = sig[lo:hi], int(tree[lo]) * depth
                is_leader[lo:hi], one, other = walk(part, part[:, k + stop : k + depth], cover, reach)
                root[lo:hi] = lo + local_roots(hi - lo, one, other)
            cls, many = t.column("cls").to_numpy(), t.column("members").to_numpy()
            tied, leaders = np.flatnonzero(root != np.arange(t.num_rows)), np.flatnonzero(is_leader & (many > GATHER))
            a, b = np.concatenate([root[tied], leaders]), np.concatenate([tied, leaders])
            for at in range(0, len(a), 4096):
                x, y = a[at : at + 4096], b[at : at + 4096]
                own = x == y
                blobs = t.column("signature").combine_chunks().take(pa.array(x, mask=~own))
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(cls[x]), pa.array(cls[y]), blobs], names=["node", "a", "b", "signature"])

    return run


def _meet(values: int, reach: float):
    """Spanning ties between the leaders of two blocks, or of one, each compared with each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["node", "one", "other"]):
            sig = binary_matrix(t.column("signature"), "<u2", values)
            one, other, block, cls = (t.column(c).to_numpy() for c in ("one", "other", "block", "cls"))
            root = np.arange(t.num_rows)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                left, right = lo + np.flatnonzero(block[lo:hi] == one[lo]), lo + np.flatnonzero(block[lo:hi] == other[lo])
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in left:
                    near = right[(sig[right] == sig[i]).mean(axis=1) >= reach]
                    a.append(np.full(len(near), i - lo)), b.append(near - lo)
                root[lo:hi] = lo + local_roots(hi - lo, np.concatenate(a), np.concatenate(b))
            tied = np.flatnonzero(root != np.arange(t.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(cls[root[tied]]), pa.array(cls[tied])], names=["a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "t")):
            hashes, _, _, first, _ = words(b.column("t"))
            sets, at = shingles(hashes, first, size)
            blobs = [np.unique(sets[x:y]).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(blobs, pa.binary())], names=["cls", "shingles"])

    return run


def shared_counts(rows: list[np.ndarray], cols: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections between rows and cols (None: rows again), by products of 0/1 columns of shingles that two sets or more hold."""
    both = rows if cols is None else rows + cols
    flat = np.concatenate(both)
    who = np.repeat(np.arange(len(both)), [len(x) for x in both])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    often = np.bincount(group) > 1 if len(flat) else np.zeros(0, bool)
    keep = often[group] if len(flat) else np.zeros(0, bool)
    column = (np.cumsum(often) - 1)[group[keep]] if len(flat) else np.zeros(0, int)
    who = who[keep]
    n, m = len(rows), len(both)
    out = np.zeros((n, n if cols is None else m - n), np.float32)
    step = max(64, (1 << 22) // max(m, 1))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [lo, lo + step])
        x = np.zeros((m, step), np.float32)
        x[who[i:j], column[i:j] - lo] = 1
        out += x[:n] @ (x[:n] if cols is None else x[n:]).T
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["comp", "one", "other"]):
            blobs = t.column("shingles").combine_chunks()
            cls, copies, one, other, block = (t.column(c).to_numpy() for c in ("cls", "copies", "one", "other", "block"))
            out = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                sets = [np.frombuffer(blobs[i].as_buffer(), np.uint64) for i in range(lo, hi)]
                length = np.array([len(x) for x in sets], np.float64)
                if one[lo] == other[lo]:
                    left = right = np.arange(hi - lo)
                    shared = shared_counts(sets, None)
                    np.fill_diagonal(shared, 0)
                else:
                    left, right = np.flatnonzero(block[lo:hi] == one[lo]), np.flatnonzero(block[lo:hi] == other[lo])
                    if not len(left) or not len(right):
                        continue
                    shared = shared_counts([sets[i] for i in left], [sets[i] for i in right])
                linked = (shared > 0) & (shared >= threshold * (length[left][:, None] + length[right][None, :] - shared) - 1e-9)
                texts, docs = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                texts[left] += linked.sum(axis=1)
                docs[left] += linked @ copies[lo:hi][right]
                if one[lo] != other[lo]:
                    texts[right] += linked.sum(axis=0)
                    docs[right] += copies[lo:hi][left] @ linked
                i, j = np.nonzero(linked)
                root = local_roots(hi - lo, left[i], right[j])
                some = np.flatnonzero(texts)
                out.append((lo + some, lo + root[some], texts[some], docs[some]))
            if out:
                a, r, n, d = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[r]), pa.array(n), pa.array(d)], names=["cls", "root", "texts", "docs"])

    return run


def ngram_join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5, threshold: float = 0.8, trees: int = TREES, depth: int = DEPTH, target: float = RECALL) -> DataFrame:
    """One row for each row of docs: id_col, class_id, n_links, n_text_links, copies, kept.

    Two texts are linked if the Jaccard similarity of their sets of `size`-word shingles is at least threshold;
    equal texts are linked whatever they hold. Texts shorter than `size` words are one shingle of all words.
    Texts without words, null counting as empty, are linked with their equals only. class_id is the smallest id
    in the connected component of links (null if all ids are null), n_links the number of other rows linked
    directly, n_text_links that of other texts, copies the rows with the same text. kept is true for the row
    with the smallest id of each component; of repeated rows exactly one is kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stop = stop_of(threshold, trees, depth, target)
    source = _digested(docs, text_col, id_col)
    sketches = kept_table(source.withColumn("row", F.monotonically_increasing_id()).select("id", "row", "digest", "t").mapInArrow(_sketches(size, trees, depth, stop), "id bigint, row bigint, digest binary, nodes array<bigint>, signature binary"), "sketches")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = kept_table(sketches.groupBy("digest").agg(F.min(order).alias("best"), F.min(F.struct("row", "id")).alias("first"), F.count("*").alias("copies")).select("digest", "best", F.col("first.row").alias("cls"), F.col("first.id").alias("of"), "copies"), "classes")
    one_each = sketches.select("row", "nodes").join(classes.select("cls"), F.col("row") == F.col("cls"), "left_semi")
    ties = _ties(one_each, sketches.select(F.col("row").alias("cls"), "signature"), trees, depth, stop, threshold)
    parts = components(ties).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    links = kept_table(_links(source, parts, classes, size, threshold), "links")
    counts = links.groupBy("cls").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    groups = components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")).filter("a <> b")).select(F.col("node").alias("cls"), "root")
    named = classes.select("digest", "cls", "best", "copies").join(groups, "cls", "left").join(counts, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = kept_table(named, "named")
    least = kept_table(named.groupBy("root").agg(F.min("best").alias("least")), "least")
    named = named.join(least, "root").select("digest", "copies", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"), F.col("least.id").alias("class_id"), F.col("least.row").alias("keep_row"))
    return sketches.select("id", "row", "digest").join(named, "digest").select(
        F.col("id").alias(id_col), "class_id", (F.col("docs") + F.col("copies") - 1).cast("bigint").alias("n_links"), F.col("texts").cast("bigint").alias("n_text_links"), "copies", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_md5")
    )


def _digested(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("t"))


def _ties(paths: DataFrame, signed: DataFrame, trees: int, depth: int, stop: int, threshold: float) -> DataFrame:
    """Ties (a, b) between classes that could be linked, from their prefixes in every tree (row, nodes) and the signatures (cls, signature) of all rows."""
    at = paths.select(F.col("row").alias("cls"), F.posexplode("nodes").alias("tree", "node"))
    shared = at.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1")
    met = kept_table(at.join(shared, "node"), "met")
    rows = met.hint("merge").join(signed, "cls")
    blocks = F.ceil(F.col("members") / F.lit(GATHER)).cast("bigint")
    dealt = rows.select("node", F.pmod(F.xxhash64("cls"), blocks).alias("block"), "tree", "cls", "signature", "members").repartition("node", "block").sortWithinPartitions("node", "block", "cls")
    # A covered set is within 1 - threshold of its leader, a linked one within that of the covered one.
    reach = max(2 * threshold - 1 - SLACK, 0.0)
    out = kept_table(dealt.mapInArrow(_gather(trees, depth, stop, threshold, reach), "node bigint, a bigint, b bigint, signature binary"), "ties")
    ties = out.filter("a <> b").select("a", "b")
    leaders = out.filter("a = b").select("node", F.col("a").alias("cls"), "signature")
    if leaders.isEmpty():
        return ties
    # Linked sets of two blocks may both be covered: their leaders are a step further apart.
    cut = leaders.groupBy("node").agg(F.ceil(F.count("*") / F.lit(GATHER)).cast("int").alias("blocks"))
    placed = leaders.join(cut, "node").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", F.least("block", "j").alias("one"), F.greatest("block", "j").alias("other"), "block", "cls", "signature")
    pairs = pairs.repartition("node", "one", "other").sortWithinPartitions("node", "one", "other", "cls")
    return ties.unionByName(kept_table(pairs.mapInArrow(_meet(trees * depth, max(3 * threshold - 2 - SLACK, 0.0)), "a bigint, b bigint"), "more-ties"))


def _links(source: DataFrame, parts: DataFrame, classes: DataFrame, size: int, threshold: float) -> DataFrame:
    """(cls, root, texts, docs): for each class and task the links it has there and the smallest class they reach."""
    wanted = kept_table(parts.join(classes.select("cls", "of", F.col("digest").alias("_digest"), "copies"), "cls"), "wanted")
    sets = likely(source, wanted.select("_digest")).join(wanted.select("cls", "of", "_digest").hint("merge"), (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("of"))).select("cls", "t")
    sets = kept_table(sets.mapInArrow(_sets(size), "cls bigint, shingles binary"), "sets")
    if sets.count() > wanted.count():  # repeated rows of one id and text
        sets = sets.dropDuplicates(["cls"])
    sizes = wanted.join(sets.select("cls", F.octet_length("shingles").alias("size")), "cls").groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(BLOCK), F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    dealt = wanted.select("cls", "comp", "copies").join(sizes, "comp").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).join(sets, "cls")
    pairs = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("comp", F.least("block", "j").alias("one"), F.greatest("block", "j").alias("other"), "block", "cls", "copies", "shingles")
    pairs = pairs.repartition("comp", "one", "other").sortWithinPartitions("comp", "one", "other", "cls")
    return pairs.mapInArrow(_verify(threshold), "cls bigint, root bigint, texts bigint, docs bigint")


#: Bits of the filter before the texts of candidates are fetched; 4 MB at most, whatever the input.
FILTER_BITS = 1 << 25


def likely(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of source whose digest may be among wanted's: nearly all others drop out before texts are shuffled.

    A Bloom filter of one hash as a table of bitmaps, FILTER_BITS / 32768 rows of 4 KB at most, so it can be
    broadcast at any size. With very many candidates it lets more pass; the join after it decides.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bits = wanted.select(place("_digest").alias("v")).groupBy(F.bitmap_bucket_number("v").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("_bits"))
    marked = source.withColumn("_v", place("digest")).withColumn("_at", F.bitmap_bit_position("_v"))
    met = marked.join(F.broadcast(bits), F.bitmap_bucket_number("_v") == F.col("_bucket"))
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*source.columns)


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that ngram_join keeps, one of each component, with all their columns."""
    kept = ngram_join(docs, text_col, id_col, **options)
    chosen = kept_table(kept.filter("kept").select(id_col, F.unhex("text_md5").alias("digest")), "kept")
    return rows_kept(docs, chosen, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))), id_col)
