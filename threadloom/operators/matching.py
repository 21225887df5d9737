"""The best block of each of very many queries: a part of the blocks meets a part of the queries in one task, and no match leaves it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Matches, and cells of blocks by queries, that are looked at together.
MATCHES, CELLS = 4 << 20, 16 << 20


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists end to end, and how many each list has."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, end to end."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def best_in_part(queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """(query_id, block_id, created_at, matched, rank, named): of the part's blocks the best of each query that finds one.

    queries: query_id, keys, ranks, named (for each key whether it could be a path); blocks: block_id, created_at,
    keys. More keys in common, then the better (more negative) sum of ranks, then newer, then the smaller id. Blocks
    that match most come first, so that of later ones few matches reach what a query has and get their ranks added.
    """
    blocks = blocks.take(pc.sort_indices(blocks, [("created_at", "descending"), ("block_id", "ascending")]))
    keys, of_query = _flat(queries["keys"])
    ranks, is_path = _flat(queries["ranks"])[0], _flat(queries["named"])[0].astype(bool)
    n = len(of_query)
    by_key = np.argsort(keys, kind="stable")
    known, first, often = np.unique(keys[by_key], return_index=True, return_counts=True)
    query, rank = np.repeat(np.arange(n), of_query)[by_key], ranks[by_key]
    held, of_block = _flat(blocks["keys"])
    at = np.minimum(np.searchsorted(known, held), max(len(known) - 1, 0))
    there = known[at] == held if len(known) else np.zeros(len(held), bool)
    owner = np.repeat(np.arange(len(of_block)), of_block)[there]
    start, length = first[at[there]], often[at[there]]
    many = np.bincount(owner, length, len(of_block)).astype(np.int64)
    held_from = np.searchsorted(owner, np.arange(len(of_block) + 1))
    order = np.argsort(-many, kind="stable")[: np.count_nonzero(many)]
    cum = np.concatenate(([0], np.cumsum(many[order])))
    best_n, best_rank, best_at = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    lo = 0
    while lo < len(order):
        hi = max(int(np.searchsorted(cum, cum[lo] + MATCHES, "right")) - 1, lo + 1)
        dense = min(hi, lo + max(CELLS // n, 1))
        if (cum[dense] - cum[lo]) * 16 >= (dense - lo) * n:
            hi = dense
        else:
            dense = 0
        rows = order[lo:hi]
        spots = _ranges(held_from[rows], held_from[rows + 1] - held_from[rows])
        hits = _ranges(start[spots], length[spots])
        q = query[hits]
        cell = np.repeat(np.arange(hi - lo), np.diff(cum[lo : hi + 1])) * n + q
        if dense:
            count = np.bincount(cell, minlength=(hi - lo) * n)
            good = np.flatnonzero(count.reshape(-1, n) >= np.maximum(best_n, 1))
            count = count[good]
        else:
            good, count = np.unique(cell, return_counts=True)
            reach = count >= best_n[good % n]
            good, count = good[reach], count[reach]
        to = np.searchsorted(good, cell)
        mine = to < len(good)
        mine[mine] = good[to[mine]] == cell[mine]
        sums = np.round(np.bincount(to[mine], rank[hits[mine]], len(good)), 9)
        of, place = good % n, rows[good // n]
        by = np.lexsort((place, sums, -count, of))
        by = by[np.concatenate(([True], np.diff(of[by]) != 0))] if len(by) else by
        of, place, sums, count = of[by], place[by], sums[by], count[by]
        better = (count > best_n[of]) | ((count == best_n[of]) & ((sums < best_rank[of]) | ((sums == best_rank[of]) & (place < best_at[of]))))
        best_n[of[better]], best_rank[of[better]], best_at[of[better]] = count[better], sums[better], place[better]
        lo = hi
    got = np.flatnonzero(best_n)
    ends = np.concatenate(([0], np.cumsum(of_query)))
    named = []
    for k in got:
        mine = slice(ends[k], ends[k + 1])
        paths = keys[mine][is_path[mine]]
        named.append(paths[np.isin(paths, held[there][held_from[best_at[k]] : held_from[best_at[k] + 1]])].tolist() if len(paths) else [])
    of_block = blocks.select(["block_id", "created_at"]).take(pa.array(best_at[got]))
    return pa.table(
        {"query_id": queries["query_id"].take(pa.array(got)), "block_id": of_block["block_id"], "created_at": of_block["created_at"], "matched": pa.array(best_n[got], pa.int64()), "rank": pa.array(best_rank[got]), "named": pa.array(named, pa.list_(pa.int64()))}
    )
