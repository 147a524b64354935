"""Give memory back at the end of a task: a Python worker lives on for the tasks of other stages."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)
