"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A lattice edge is a piece of the vocabulary with its score; characters without a piece of their own get byte
pieces. The forward Viterbi score of a node is the best any path from the start can have there, so a search
that grows paths backward from the end and takes the one of best forward score plus score so far pops the
segmentations in order: A-star with an exact heuristic. Where no piece can cross, before a run of blanks and
around bytes that are in no piece, the lattice falls apart into chunks. Chunks that recur in a task are solved
once, forward and backward, as arrays; the N best of a text are combined from its chunks of least regret, the
only ones that can deviate in them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import slices, text_buffer
from .words import span_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Bytes of text whose lattice is built at once.
LATTICE = 1 << 20
#: Bytes of solved chunks that a task keeps from slice to slice.
KNOWN = 8 << 20
NEVER = -1e18


class Lattice:
    """Pieces as a trie over bytes, blanks in place of the mark that stands for them."""

    def __init__(self, pieces: list[tuple[bytes, float, int]], byte_ids: np.ndarray):
        self.byte_ids = byte_ids
        usual = [s for _, s, _ in pieces if s > -1e8]
        self.byte_score = (min(usual) if usual else 0.0) - 10.0
        children: list[dict[int, int]] = [{}]
        end = [-1]
        for k, (name, _, _) in enumerate(pieces):
            node = 0
            for b in name:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({}), end.append(-1)
                node = children[node][b]
            if end[node] < 0 or pieces[end[node]][1] < pieces[k][1]:
                end[node] = k
        inner = [n for n, c in enumerate(children) if c]
        row = {n: k for k, n in enumerate(inner)}
        self.next = np.full((len(inner), 256), -1, np.int32)
        for n in inner:
            for b, c in children[n].items():
                self.next[row[n], b] = c
        self.row = np.array([row.get(n, -1) for n in range(len(children))], np.int32)
        self.end = np.array(end, np.int32)
        self.ids = np.array([i for _, _, i in pieces], np.int32)
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        used = np.zeros(256, bool)
        crossing = False
        for name, _, _ in pieces:
            used[list(name)] = True
            crossing |= b" " in name.lstrip(b" ")
        self.alone = ~used
        self.alone[128:] = False
        self.at_blanks = not crossing
        # For decoding: all bytes of all ids end to end.
        names: dict[int, bytes] = {i: n for n, _, i in pieces} | {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
        table = [names.get(i, b"") for i in range(max(names, default=0) + 1)]
        self.size = np.array([len(x) for x in table], np.int64)
        self.at = np.r_[0, np.cumsum(self.size)]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def chunks(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of chunks; texts end to end in flat."""
        start = np.zeros(len(flat), bool)
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.at_blanks:
            blank = flat == 32
            start[1:] |= blank[1:] & ~blank[:-1]
        alone = self.alone[flat]
        start |= alone
        start[1:] |= alone[:-1]
        return np.flatnonzero(start)

    def edges(self, flat: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id, score) of all edges; stop says for each byte where its chunk ends."""
        lead = (flat & 0xC0) != 0x80
        lead[0:1] = True
        at = np.flatnonzero(lead)
        width = np.diff(np.r_[at, len(flat)])
        width = np.minimum(width, stop[at] - at)
        known = np.zeros(len(at), bool)
        which = np.arange(len(at))
        node = np.zeros(len(at), np.int32)
        begin, step = at, 0
        found = []
        while len(begin):
            node = self.next[self.row[node], flat[begin + step]]
            live = node >= 0
            begin, node, which = begin[live], node[live], which[live]
            step += 1
            piece = self.end[node]
            full = piece >= 0
            found.append((begin[full], begin[full] + step, self.ids[piece[full]], self.scores[piece[full]]))
            known[which[full & (width[which] == step)]] = True
            more = (self.row[node] >= 0) & (begin + step < stop[begin])
            begin, node, which = begin[more], node[more], which[more]
        bare = np.flatnonzero(~known)
        rest = np.repeat(at[bare], width[bare]) + np.arange(int(width[bare].sum())) - np.repeat(np.cumsum(width[bare]) - width[bare], width[bare])
        found.append((rest, rest + 1, self.byte_ids[flat[rest]], np.full(len(rest), self.byte_score)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of runs of ids end to end and where each run's begin; ids without bytes give none."""
        known = np.where((ids >= 0) & (ids < len(self.size)), ids, 0)
        size = np.where(known == ids, self.size[known], 0)
        ends = np.r_[0, np.cumsum(size)]
        place = np.arange(int(ends[-1])) - np.repeat(ends[:-1], size) + np.repeat(self.at[:-1][known], size)
        return self.bytes[place], ends[bounds]


@lru_cache(maxsize=2)
def lattice(vocabulary: str = VOCABULARY) -> Lattice:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    plain = [(p.id_to_piece(i).replace("▁", " ").encode(), p.get_score(i), i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    return Lattice(plain, np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32))


class Solved:
    """All chunks of flat bytes, each with its best segmentation and the regret of the next."""

    def __init__(self, lat: Lattice, flat: np.ndarray, starts: np.ndarray):
        n = len(starts)
        bounds = np.r_[starts, len(flat)]
        chunk = np.repeat(np.arange(n), np.diff(bounds))
        s, e, self.edge_id, self.edge_score = lat.edges(flat, bounds[1:][chunk]) if n else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32), np.zeros(0))
        self.edge_chunk = chunk[s] if n else s
        # A node for each byte and one for each chunk's end: byte positions moved on by the chunk's number.
        s, e = s + self.edge_chunk, e + self.edge_chunk
        self.s, self.e = s, e
        first, last = bounds[:-1] + np.arange(n), bounds[1:] + np.arange(n)
        self.first, self.last = first, last
        forward = np.full(len(flat) + n, NEVER)
        forward[first] = 0
        self._sweep(forward, s, e, e - first[self.edge_chunk])
        backward = np.full(len(flat) + n, NEVER)
        backward[last] = 0
        self._sweep(backward, e, s, last[self.edge_chunk] - s)
        self.forward, self.best = forward, forward[last]
        tight = np.abs(forward[s] + self.edge_score - forward[e]) < 1e-6
        came = np.full(len(flat) + n, len(flat) + n)
        np.minimum.at(came, e[tight], s[tight])
        chosen = np.flatnonzero(tight & (came[e] == s))
        edge = np.full(len(flat) + n, -1)
        edge[e[chosen]] = chosen
        on = np.zeros(len(flat) + n, bool)
        node = last[last > first]
        while len(node):
            on[node] = True
            node = came[node]
            node = node[edge[node] >= 0]
        path = edge[np.flatnonzero(on)]
        self.path = self.edge_id[path]
        self.path_at = np.r_[0, np.cumsum(np.bincount(self.edge_chunk[path], minlength=n))]
        off = np.ones(len(s), bool)
        off[path] = False
        second = np.full(n, NEVER)
        np.maximum.at(second, self.edge_chunk[off], (forward[s] + self.edge_score + backward[e])[off])
        self.regret = np.where(second > NEVER / 2, self.best - second, np.inf)

    def _sweep(self, score: np.ndarray, a: np.ndarray, b: np.ndarray, level: np.ndarray) -> None:
        order = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 65536 else level, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(level))] if len(level) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[lo:hi]
            if len(at):
                np.maximum.at(score, b[at], score[a[at]] + self.edge_score[at])

    def alternatives(self, wanted: np.ndarray, most: int) -> dict[int, list[tuple[float, tuple[int, ...]]]]:
        """The N best segmentations of some chunks, by backward A-star."""
        need = np.zeros(len(self.first), bool)
        need[wanted] = True
        into: dict[int, list[tuple[int, int, float]]] = {}
        at = np.flatnonzero(need[self.edge_chunk])
        for s, e, i, w in zip(self.s[at].tolist(), self.e[at].tolist(), self.edge_id[at].tolist(), self.edge_score[at].tolist(), strict=True):
            into.setdefault(e, []).append((s, i, w))
        return {c: backward_search(into, self.forward, int(self.first[c]), int(self.last[c]), most) for c in wanted.tolist()}


def gathered(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs values[at[k]:at[k + 1]] of all k in which, end to end, and where each begins."""
    size = np.diff(at)[which]
    ends = np.r_[0, np.cumsum(size)]
    return values[np.arange(int(ends[-1])) - np.repeat(ends[:-1] - at[:-1][which], size)], ends


class Known:
    """Chunks that a task has solved, in the order they came, up to KNOWN bytes; then it begins anew."""

    def __init__(self, lat: Lattice):
        self.lat = lat
        self.clear()

    def clear(self) -> None:
        self.keys, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.path, self.path_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.best, self.regret = np.zeros(0), np.zeros(0)
        self.ways: dict[int, list[tuple[float, tuple[int, ...]]]] = {}

    def places(self, keys: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray | None:
        """Where chunks with different keys stand here, those not known before solved and added; None if two have one key."""
        if len(self.bytes) + len(flat) > KNOWN:
            self.clear()
        where = np.searchsorted(self.keys, keys, sorter=self.order)
        place = np.full(len(keys), -1)
        inside = where < len(self.keys)
        place[inside] = self.order[where[inside]]
        place[inside] = np.where(self.keys[place[inside]] == keys[inside], place[inside], -1)
        old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        (mine, ends), (theirs, others) = gathered(flat, at, old), gathered(self.bytes, self.at, place[old])
        if not (np.array_equal(ends, others) and np.array_equal(mine, theirs)):
            return None
        if len(new):
            fresh, fresh_at = gathered(flat, at, new)
            done = Solved(self.lat, fresh, fresh_at[:-1])
            place[new] = len(self.keys) + np.arange(len(new))
            self.keys = np.r_[self.keys, keys[new]]
            self.order = np.argsort(self.keys, kind="stable")
            self.bytes, self.at = np.r_[self.bytes, fresh], np.r_[self.at, self.at[-1] + fresh_at[1:]]
            self.path, self.path_at = np.r_[self.path, done.path], np.r_[self.path_at, self.path_at[-1] + done.path_at[1:]]
            self.best, self.regret = np.r_[self.best, done.best], np.r_[self.regret, done.regret]
        return place

    def alternatives(self, wanted: np.ndarray, most: int) -> dict[int, list[tuple[float, tuple[int, ...]]]]:
        """As Solved.alternatives; those found before for as many are not looked for again."""
        new = np.array([c for c in wanted.tolist() if c not in self.ways], np.int64)
        if len(new):
            flat, at = gathered(self.bytes, self.at, new)
            found = Solved(self.lat, flat, at[:-1]).alternatives(np.arange(len(new)), most)
            self.ways |= {int(c): found[k] for k, c in enumerate(new)}
        return self.ways


def backward_search(into: dict[int, list[tuple[int, int, float]]], forward: np.ndarray, first: int, last: int, most: int) -> list[tuple[float, tuple[int, ...]]]:
    """Paths from first to last in order of score. into: for each node (start, id, score) of the edges that end there.

    Of equal sums the path nearer to the start goes first, then the one that was found first.
    """
    agenda: list = [(-float(forward[last]), last, 0, 0.0, None)]
    count, out = 1, []
    while agenda and len(out) < most:
        _, node, _, done, tail = heapq.heappop(agenda)
        if node == first:
            ids = []
            while tail is not None:
                ids.append(tail[0])
                tail = tail[1]
            out.append((done, tuple(ids)))
            continue
        for s, i, w in sorted(into.get(node, ())):
            heapq.heappush(agenda, (-(float(forward[s]) + w + done), s, count, done + w, (i, tail)))
            count += 1
    return out


def combined(best: float, found: list[tuple[int, list[tuple[float, tuple[int, ...]]]]], most: int) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
    """The N best ways to choose one of each list of (place, alternatives in order): (score, {place: ids that aren't the best})."""
    out, seen = [], {(0,) * len(found)}
    lost = [[ways[0][0] - score for score, _ in ways] for _, ways in found]
    agenda = [(0.0, (0,) * len(found))]
    while agenda and len(out) < most:
        loss, pick = heapq.heappop(agenda)
        out.append((best - loss, {found[k][0]: found[k][1][j][1] for k, j in enumerate(pick) if j}))
        for k, j in enumerate(pick):
            if j + 1 < len(found[k][1]):
                other = (*pick[:k], j + 1, *pick[k + 1 :])
                if other not in seen:
                    seen.add(other)
                    heapq.heappush(agenda, (sum(map(list.__getitem__, lost, other)), other))
    return out


def encode_batch(lat: Lattice, column: pa.Array, most: int, known: Known | None = None):
    """ids end to end, bounds of texts, best scores, and for each text its N best as (score, {place of a chunk: other ids}), chunk bounds. known: what was solved for the same number before."""
    flat, offsets = text_buffer(column)
    size = np.diff(offsets)
    full = size > 0
    begins = offsets[:-1] + np.cumsum(full) - full
    padded = np.full(len(flat) + int(full.sum()), 32, np.uint8)
    padded[np.arange(len(flat)) + np.repeat(np.cumsum(full), size)] = flat
    bounds = np.r_[begins, len(padded)]
    starts = lat.chunks(padded, bounds)
    ends = np.r_[starts[1:], len(padded)] if len(starts) else starts
    key = span_hashes(padded, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    length = (ends - starts)[one]
    once_at = np.r_[0, np.cumsum(length)]
    place = np.arange(int(once_at[-1])) - np.repeat(once_at[:-1], length) + np.repeat(starts[one], length)
    once = padded[place]
    same = np.array_equal(gathered(once, once_at, which)[0], padded) if len(starts) else True
    done = known or Known(lat)
    places = done.places(key[one], once, once_at) if same else None
    if places is not None:
        which = places[which]
    else:  # two chunks with one hash: every chunk for itself
        done, which = Solved(lat, padded, starts), np.arange(len(starts))
    ids, chunk_at = gathered(done.path, done.path_at, which)
    text_at = np.searchsorted(starts, bounds)
    best = np.array([done.best[which[a:b]].sum() for a, b in zip(text_at[:-1], text_at[1:], strict=True)], np.float64)
    ways: list = []
    if most > 1:
        loose = []
        for a, b in zip(text_at[:-1], text_at[1:], strict=True):
            regret = done.regret[which[a:b]]
            few = np.argpartition(regret, most - 2)[: most - 1] if len(regret) > most - 1 else np.arange(len(regret))
            few = few[np.isfinite(regret[few])]
            loose.append(a + few[np.lexsort((few, regret[few]))])
        wanted = np.unique(which[np.concatenate(loose)]) if len(loose) else np.zeros(0, int)
        found = done.alternatives(wanted, most)
        ways = [combined(float(x), [(int(p), found[int(which[p])]) for p in places], most) if b > a else [] for x, places, a, b in zip(best, loose, text_at[:-1], text_at[1:], strict=True)]
    return ids, chunk_at[text_at], best, ways, chunk_at, padded, bounds


def n_best_ids(ids: np.ndarray, lo: int, hi: int, changed: dict[int, tuple[int, ...]], chunk_at: np.ndarray) -> np.ndarray:
    """The ids of a text with some chunks encoded otherwise."""
    parts, at = [], lo
    for place in sorted(changed):
        parts += [ids[at : chunk_at[place]], np.array(changed[place], np.int32)]
        at = chunk_at[place + 1]
    return np.concatenate([*parts, ids[at:hi]])


def encode_pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n_best: int = N_BEST, vocabulary: str = VOCABULARY, all_ids: bool = False) -> DataFrame:
    """One row for each row of docs: id_col, n_pieces, score, ids, n_best_scores, n_best_sizes, exact (and n_best_ids with all_ids).

    ids is the best segmentation of the whole text after one blank that is put before it; of equal ones that
    whose pieces from the end on are longest. exact says that all of ids decodes to the text's bytes. Null and
    empty texts have no pieces, score 0 and no further segmentations. Blanks, line ends and every other
    character come back as they were: what has no piece is encoded byte by byte. Repeated rows are rows of their
    own, null ids stay null, an empty table gives no rows; other columns are ignored, whatever their names.
    """
    lists = {"n_best_scores": pa.list_(pa.float64()), "n_best_sizes": pa.list_(pa.int32())} | ({"n_best_ids": pa.list_(pa.list_(pa.int32()))} if all_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary)
        known = Known(lat)
        for b in (part for whole in batches for part in slices(whole, "t", LATTICE)):
            ids, bounds, best, ways, chunk_at, padded, text_bounds = encode_batch(lat, b.column("t"), n_best, known)
            back, back_at = lat.decode(ids, bounds)
            exact = np.array([np.array_equal(back[p:q], padded[x:y]) for p, q, x, y in zip(back_at[:-1], back_at[1:], text_bounds[:-1], text_bounds[1:], strict=True)], bool)
            sizes = [[int(hi - lo + sum(len(v) - (chunk_at[p + 1] - chunk_at[p]) for p, v in changed.items())) for _, changed in w] for w, lo, hi in zip(ways, bounds[:-1], bounds[1:], strict=True)]
            more = [pa.array([[s for s, _ in w] for w in ways], lists["n_best_scores"]), pa.array(sizes, lists["n_best_sizes"])]
            if all_ids:
                whole = [n_best_ids(ids, lo, hi, changed, chunk_at) for w, lo, hi in zip(ways, bounds[:-1], bounds[1:], strict=True) for _, changed in w]
                each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, whole)], dtype=np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *whole]).astype(np.int32)))
                more.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ways)], dtype=np.int32)), each))
            column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(best), column, *more, pa.array(exact)], names=["id", "n_pieces", "score", "ids", *lists, "exact"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    extra = ", n_best_ids array<array<int>>" if all_ids else ""
    return rows.mapInArrow(run, f"id bigint, n_pieces bigint, score double, ids array<int>, n_best_scores array<double>, n_best_sizes array<int>{extra}, exact boolean").withColumnRenamed("id", id_col)


def decode_pieces(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text that ids stand for, without the blank before it. Null stays null; unknown and control ids give nothing; bytes that are no UTF-8 become replacement characters."""

    @arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        lat = lattice(vocabulary)
        bounds = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy())]
        back, at = lat.decode(column.flatten().fill_null(-1).to_numpy().astype(np.int64), bounds)
        texts = [back[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:], strict=True)]
        return pa.array([x[1:] if x.startswith(" ") else x for x in texts], pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))

    return decode(ids)
