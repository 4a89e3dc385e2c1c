"""What a Python process keeps: one built model at most in a worker, whichever operator it belongs to, and no free memory after a fit."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_held: dict[object, object] = {}


def trim() -> None:
    """Hands free memory back, where Arrow and the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back:
        back(0)


def release() -> None:
    """Lets go of what is kept."""
    if _held:
        _held.clear()
        trim()


def resident(name: object, build: Callable[[], T]) -> T:
    """The model of that name; built if the worker doesn't hold it, in place of any other."""
    if name not in _held:
        release()
        _held[name] = build()
    return _held[name]
