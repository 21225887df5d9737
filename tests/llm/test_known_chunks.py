"""Chunks that a task has solved are not solved again, and what comes out is the same."""

import numpy as np
import pyarrow as pa

from threadloom.llm import pieces as P


def toy() -> P.Lattice:
    names = [b" ", b"a", b"b", b"ab", b" a", b" ab", b"ba", b" b"]
    return P.Lattice([(n, -1.0 - k / 8, k) for k, n in enumerate(names)], np.arange(100, 356))


def same(one, two) -> bool:
    return all(np.array_equal(x, y) for x, y in zip(one[:3], two[:3], strict=True)) and one[3] == two[3]


def test_solved_once(monkeypatch):
    lat, solved = toy(), []

    class Counted(P.Solved):
        def __init__(self, lat, flat, starts):
            solved.append(flat.tobytes())
            super().__init__(lat, flat, starts)

    monkeypatch.setattr(P, "Solved", Counted)
    slices = [pa.array(["ab ba abba", None, "abab"]), pa.array(["abba ab é", "", "ba"]), pa.array(["ba ab abba"])]
    known = P.Known(lat)
    ways = []
    for s in slices:
        before = len(solved)
        ways.append(P.encode_batch(lat, s, 1, known))
        solved[before:] = [b"".join(solved[before:])]
    assert solved[1].replace(" é".encode(), b"") == b"" and solved[2] == b""
    assert all(same(w, P.encode_batch(lat, s, 1)) for w, s in zip(ways, slices, strict=True))


def test_same_with_bounded_memory(monkeypatch):
    lat, known = toy(), None
    for bound in (1, 12, 1 << 20):
        monkeypatch.setattr(P, "KNOWN", bound)
        known = P.Known(lat)
        for s in (["ab ba", "abab abba ba"], ["ba ba abé", None], ["abba ab ab", "x"]):
            assert same(P.encode_batch(lat, pa.array(s), 4, known), P.encode_batch(lat, pa.array(s), 4))


def test_colliding_keys(monkeypatch):
    lat = toy()
    right = P.encode_batch(lat, pa.array(["ab ba"]), 4), P.encode_batch(lat, pa.array(["bb ba"]), 4)
    monkeypatch.setattr(P, "span_hashes", lambda flat, starts, ends: np.arange(len(starts), dtype=np.uint64))
    known = P.Known(lat)
    assert same(P.encode_batch(lat, pa.array(["ab ba"]), 4, known), right[0])
    assert same(P.encode_batch(lat, pa.array(["bb ba"]), 4, known), right[1])
