"""Large tables of a worker process.

Workers outlive the stages of a job. A process holds the tables of one operator at a time: asking for those of
another drops them, so that vocabularies, automata and what is known of words do not add up along a pipeline.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

_tables: dict[Hashable, object] = {}


def held(key: Hashable, build: Callable):
    """The table of this key, built where the process does not hold it; all others are dropped."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = build()
    return _tables[key]


def release() -> None:
    """Drop all tables."""
    _tables.clear()
