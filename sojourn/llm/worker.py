"""What a Python worker process holds from one task to the next.

Spark gives a worker to later tasks, also of other operators, for as long as one follows another within a minute. So what an
operator remembers there, and what its allocators hold on to, adds to what the next operator needs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_kept: dict[str, dict[Hashable, object]] = {}


def kept(owner: str, key: Hashable, make: Callable[[], object]) -> object:
    """``make()``, once per worker and key, until a task of another owner or of none begins."""
    for other in [name for name in _kept if name != owner]:
        del _kept[other]
    own = _kept.setdefault(owner, {})
    if key not in own:
        own[key] = make()
    return own[key]


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def release() -> None:
    """Drops all that is kept."""
    _kept.clear()
    trim()


def keeping_nothing(run: Task) -> Task:
    """The function of a task that needs nothing of earlier tasks and leaves nothing behind."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By these two functions only: what a task function names itself would be copied into it.
        release()
        try:
            yield from run(batches)
        finally:
            trim()

    return task
