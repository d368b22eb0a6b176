"""What a Python worker remembers from task to task, for one operator at a time.

Spark keeps a worker for the tasks of later stages. Each operator's memory is bounded, but a pipeline's operators together
would fill a worker with what no later stage asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 1024

_LAST: list[dict] = []


def only(held: dict) -> None:
    """To be called before a task uses held: what the tasks before it remembered in another one is forgotten."""
    if _LAST and _LAST[0] is not held:
        _LAST[0].clear()
        pa.default_memory_pool().release_unused()
    _LAST[:] = [held]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most that many, so that Python objects are made for few rows at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
