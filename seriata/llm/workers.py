"""What a Python worker keeps from task to task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import TypeVar

Kept = TypeVar("Kept")

_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], Kept]) -> Kept:
    """The object of ``key``, made if the worker does not hold it.

    Spark uses a worker for one stage after another.  Making an object lets go
    of the one before, so that a worker never holds the remembered words of two
    operators on top of one another.
    """
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Let go of what earlier stages left in the worker; for stages that need no such object."""
    if _KEPT:
        _KEPT.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed, others may not
        if trim is not None:
            trim(0)
