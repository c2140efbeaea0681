"""Workers live on after a task; what they freed should not stay with them."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        return
