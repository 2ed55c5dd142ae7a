"""What every function over Arrow batches needs."""

from __future__ import annotations

import ctypes
import functools
import gc


def _release() -> None:
    """Gives freed memory back to the system: idle workers of one stage otherwise keep it from the next one."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """run, a generator over batches, after which a worker keeps no memory that it doesn't use."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return whole
