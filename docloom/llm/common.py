"""What the training-data operators share: scratch tables, row batches, hashed words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bound_batches, scratch_path, shared_dir, written

__all__ = ["bound_batches", "scratch_path", "shared_dir", "written"]

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_memories: dict[str, Callable[[], None]] = {}
_user = ""


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Says how a Python worker forgets what an operator remembers between tasks."""
    _memories[owner] = forget


def work_for(owner: str) -> None:
    """Called when a task begins: a worker that served other operators before gives back their memory."""
    global _user
    if owner != _user:
        for name, forget in _memories.items():
            if name != owner:
                forget()
        _powers.clear()
        _user = owner
    give_back()


def give_back() -> None:
    """Called when a task begins, and at the end of one whose memory an idle worker needn't keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it, freed memory goes back to the system
        ctypes.CDLL(None).malloc_trim(0)


def crc32_of_id(col: str = "doc_id"):
    """crc32 of the id written as decimal text, as the hold-out rules use it; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- bytes of a text column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and len + 1 offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def byte_runs(offs: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text makes a range of its own."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `most` bytes of a text column each; a longer text is a run of its own."""
    _, offs = text_bytes(batch.column(column))
    for a, b in byte_runs(offs, most):
        yield batch.slice(a, b - a)


# ---------------------------------------------------------------- hashed words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _randoms(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.int64).view(U64) * U64(2) + U64(1)


_BYTE = _randoms(1, 256)[_LOWER]
#: For word_hashes: bytes as they are.
CASED = _randoms(1, 256)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the largest n seen up to 4 Mi."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(n, U64(base), U64)
        have[:1] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and each row's offsets into them."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased; equal words, equal hashes, on any machine. values: a number for each byte."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(values[data] * _power(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(U64))
