"""What Python workers do besides their work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """function for mapInArrow, after which a worker gives free memory back: workers live on, idle, beside the next tasks."""

    @wraps(function)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not a C library that has it
        pass
