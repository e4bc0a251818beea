"""State that a Python worker keeps between tasks: one cache at a time, so that stages don't add up."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_HELD: dict = {}


def held(name, make: Callable):
    """What make() gave when this worker was last asked for name; any other state is let go."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def give_back() -> None:
    """Hand freed memory back to the system; workers stay alive between stages, beside the JVM's own growth."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator], keep_cache: bool = False) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that drops other stages' caches first, unless told, and gives memory back."""

    def task(batches: Iterator) -> Iterator:
        if not keep_cache:
            _HELD.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
