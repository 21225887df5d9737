"""All catalogued queries of the conversation engine."""

from __future__ import annotations

from collections.abc import Callable

from threadloom.plans import archived, bodies, measure, ordered, path, recall, registry, state, texts  # noqa: F401


def queries() -> dict[str, Callable]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
