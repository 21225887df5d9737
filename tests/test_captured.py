"""Captured event files: batch and stream agree, files grow, ranges meet at any byte."""

import re

import pytest

from threadloom.sources import captured as C

TEXTS = {
    "a.sse": 'event: message_start\ndata: {"type":"message_start"}\n\nevent: ping\ndata: {"type":"ping"}\n\n',
    "b.sse": 'event: x\r\ndata: {"type":"x","t":"é😀"}\r\n\r\n\n\n\nevent: y\ndata: no json\n\n',
    "c.sse": "", "d/e.sse": "data: 1\n\n" * 50 + "data: last without a blank line", "f.sse": "\n\n\n", "_hidden": "data: no\n\n",
}


def by_hand(text, whole=True):
    parts = re.split(r"\r?\n\r?\n", text)
    return [p.replace("\r\n", "\n") for p in (parts if whole else parts[:-1]) if p.strip()]


@pytest.fixture
def folder(tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(text.encode())
    return tmp_path / "in"


@pytest.mark.parametrize("step,span", [(1 << 20, 64 << 20), (7, 5), (1, 1), (3, 40)])
def test_ranges(folder, monkeypatch, step, span):
    """Whatever the bounds of reads and tasks, each event comes once, from where it begins."""
    monkeypatch.setattr(C, "STEP", step)
    monkeypatch.setattr(C, "SPAN", span)
    reader = C.Whole(str(folder))
    got = sorted(r for p in reader.partitions() for r in reader.read(p))
    for name, text in TEXTS.items():
        mine = [(at, raw) for path, at, raw in got if path.endswith(name)]
        assert [raw.strip("\n") for _, raw in mine] == ([] if name == "_hidden" else [x.strip("\n") for x in by_hand(text)])
        assert all(text.encode()[at:].replace(b"\r\n", b"\n").decode().startswith(raw) for at, raw in mine)


@pytest.mark.parametrize("step", [1 << 20, 2])
def test_growing_files(folder, monkeypatch, step):
    """Offsets stop at the last blank line; what is appended later comes once and whole."""
    monkeypatch.setattr(C, "STEP", step)
    reader, seen, start = C.Growing(str(folder)), [], {}

    def batch():
        nonlocal start
        end = reader.latestOffset()
        seen.extend(raw.strip("\n") for p in reader.partitions(start, end) for _, _, raw in reader.read(p))
        start = end

    batch()
    assert sorted(seen) == sorted(x.strip("\n") for n, t in TEXTS.items() if n != "_hidden" for x in by_hand(t, False))
    with (folder / "d" / "e.sse").open("ab") as f:
        f.write(b" now with\n")
    batch()
    n = len(seen)
    with (folder / "d" / "e.sse").open("ab") as f:
        f.write(b"\ndata: one more\n\ndata: open")
    batch()
    assert seen[n:] == ["data: last without a blank line now with", "data: one more"]
    again = C.Growing(str(folder))  # a restarted query goes on from its checkpoint's offsets
    assert [r for p in again.partitions(start, again.latestOffset()) for r in again.read(p)] == []


def test_batch_and_stream_agree(spark, folder, tmp_path):
    (folder / "d" / "e.sse").write_text("data: 1\n\n" * 50)
    batch = sorted(map(tuple, C.read_events(spark, str(folder)).collect()))
    q = C.read_events(spark, str(folder), stream=True).writeStream.format("memory").queryName("captured").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("captured").collect())) == batch and len(batch) == 54
    finally:
        q.stop()
    assert {r[2] for r in batch} == {"message_start", "ping", "x", "y", ""}
    assert C.read_events(spark, str(tmp_path / "nothing")).count() == 0
