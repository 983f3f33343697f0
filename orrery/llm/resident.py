"""One large cache at a time in a Python worker: workers are used again by later stages."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import cache
from typing import Any

import pyarrow as pa

_held: dict[str, Any] = {}
#: glibc's options, the bytes from which an array has pages of its own that go when it goes, and those of the heap that stay free for smaller ones.
_TRIM_THRESHOLD, _MMAP_THRESHOLD, PAGED, SPARE = -1, -3, 1 << 20, 4 << 20


def _libc(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (AttributeError, OSError):  # not glibc
        pass


@cache
def lean() -> None:
    """Has the process give arrays' memory back: else glibc keeps arrays of up to 32 MB in its heap once some were freed."""
    _libc("mallopt", _MMAP_THRESHOLD, PAGED)
    _libc("mallopt", _TRIM_THRESHOLD, SPARE)
    gc.collect()
    gc.freeze()  # what modules hold stays, and collecting need not look through it each time


def only(name: str, make: Callable[[], Any] = lambda: None) -> Any:
    """What is held under ``name``, made if need be; all else that is held goes, and its memory back to the system."""
    lean()
    if name not in _held:
        if _held:
            _held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            _libc("malloc_trim", 0)
        _held[name] = make()
    return _held[name]
