"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_HELD: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """The object under ``key``, made at its first use; any other one is let go.

    Workers outlive stages: a cache of an earlier operator would stay in memory
    beside the one at work.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return freed memory to the machine: workers outlive tasks and keep what they once took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        return
