"""One operator at a time keeps memos in a Python worker: who claims the worker's memory makes the others forget."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_owner: list[str] = []
_forget: dict[str, Callable[[], None]] = {}


def claim(name: str, forget: Callable[[], None]) -> None:
    """Called by an operator's kernel before it fills its memos; forget() empties them when another one claims."""
    if _owner == [name]:
        return
    for other, drop in list(_forget.items()):
        if other != name:
            drop()
            del _forget[other]
    if _owner:  # what the other one has freed goes back to the system
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    _owner[:] = [name]
    _forget[name] = forget
