"""What a Python worker keeps from one task to the next.

Spark hands a worker from step to step, so what each step keeps there would add up.  A worker
keeps one thing at a time: a step that keeps another one first gives up what the step before left.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")

_KEPT: dict[tuple[str, ...], object] = {}


def kept(key: tuple[str, ...], build: Callable[[], T]) -> T:
    """What this process keeps by ``key``; if that's something else, it goes before this is built."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _KEPT[key] = build()
    return _KEPT[key]
