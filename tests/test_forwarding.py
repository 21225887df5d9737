"""The order of taking context out and cleaning."""

from threadloom.config import EngineConfig
from threadloom.plans.forwarding import forwarded

NOISE, CONTEXT = "<system-reminder>noise</system-reminder>", "<system-reminder>\n# claudeMd\nrules</system-reminder>"


def test_context_goes_before_reminders_do(spark):
    """A last row that holds context alone goes; the user row before it is then the last and keeps its reminders."""
    rows = [(1, 0, "user", f"{NOISE} q"), (1, 1, "assistant", "a"), (1, 2, "user", f"{NOISE} keep me"), (1, 3, "assistant", "b"), (1, 4, "user", CONTEXT), (2, 0, "user", f"{CONTEXT} x"), (2, 1, "user", f"{NOISE} y")]
    got = forwarded(spark.createDataFrame(rows, "session_id bigint, idx bigint, role string, text string"), EngineConfig()).select("session_id", "idx", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 0, CONTEXT), (1, 1, "q"), (1, 2, "a"), (1, 3, f"{NOISE} keep me"), (1, 4, "b"), (2, 0, CONTEXT), (2, 1, " x"), (2, 2, f"{NOISE} y")]
