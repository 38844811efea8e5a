"""Texts of Arrow batches as flat byte arrays, cut into pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text makes a piece of its own.
PIECE = 1 << 20


_M_MMAP_THRESHOLD, _lean, _libc = -3, False, None


def lean() -> None:
    """Have this worker give large arrays back to the system as soon as they are freed.

    Idle workers stay in memory beside the running ones, so what they keep counts.
    """
    global _lean, _libc
    if not _lean:
        _lean = True
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            _libc = ctypes.CDLL(None)
            _libc.mallopt(_M_MMAP_THRESHOLD, 1 << 17)
            _libc.malloc_trim(0)
        except (OSError, AttributeError):  # another C library: memory is kept longer
            _libc = None


_kept: dict[str, dict] = {}


def kept(owner: str, key: str, make: Callable[[], object]) -> object:
    """What make() gave, kept by this worker from task to task of its owner; a task of any other drops it."""
    own = _kept.setdefault(owner, {})
    if key not in own:
        own[key] = make()
    return own[key]


def _trim() -> None:
    """Give freed memory back. A function of the module's own: one inside tidy() would travel with the driver's _libc, which is None."""
    if _libc is not None:
        _libc.malloc_trim(0)


def _drop_all_but(owner: str) -> None:
    for k in [k for k in _kept if k != owner]:
        del _kept[k]


def tidy(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """A task's function that leaves an idle worker with no more memory than before it, but for what its owner keeps."""

    def whole(batches: Iterator) -> Iterator:
        lean()
        _drop_all_but(owner)
        yield from run(batches)
        _trim()

    return whole


def tidy_group(run: Callable) -> Callable:
    """The same for a function of one group."""

    def whole(pdf):
        lean()
        _drop_all_but("")
        out = run(pdf)
        _trim()
        return out

    return whole


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len + 1 offsets into them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` bytes each, or one text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def binaries(values: list[bytes]) -> pa.Array:
    """Values as an Arrow binary column."""
    return pa.array(values, pa.binary())
