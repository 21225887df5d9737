"""Compaction makes the rows of calls and answers once, and deals them to tasks by their number."""

from threadloom.plans import catalog, ordered


def test_rows_are_dealt_by_number(spark, sf, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 100)
    df = catalog.queries()["g5_compact"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan  # answers are met with their documents before
    parts = ordered.stages(spark, sf).count() // 100 + 1
    assert plan.count(f"RepartitionByExpression [session_id#") >= 3 and f"], {parts}" in plan


def test_rows_are_joined_with_nothing(spark, sf):
    """Written rows are so small as a file that a join would broadcast all of them through the driver."""
    plan = catalog.queries()["g5_compact"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
