"""Small helpers shared by the text operators: shared scratch tables and Arrow text slices.

Texts arrive in Arrow batches. A batch is cut into slices of about a MB, so that the numpy
temporaries of a task stay small whatever the batch holds; a text is never cut.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.sources.scratch import scratch, written  # noqa: F401

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def release() -> None:
    """Gives the memory that this worker has freed back to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task's batches, with release() at the task's end: a worker that waits for its next task, of
    this stage or of a later one, holds little."""

    @functools.wraps(run)
    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return all_of


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns asked for; every other column stays unread."""
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def held_out(modulus: int, remainder: int, column: str = "doc_id"):
    """True where crc32 of the id as text leaves this remainder; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(True))


@dataclass
class Slice:
    """Bytes of some rows' texts, one after the other: row i has data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's rows in order, in slices of about `most` bytes; a longer text has a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Slice(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


_LETTER = np.zeros(256, bool)
_LETTER[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of certain bytes (all but 20 and 09-0D), and how many each row has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = kinds[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, np.uint64(base % (1 << 64)))
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


class Rolling:
    """Hashes of any ranges of one buffer, of bytes or of 64-bit units, from one prefix sum modulo 2 ** 64."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        code = _BYTE_CODE[data] if data.dtype == np.uint8 else data
        np.cumsum(code * powers(_BASE, len(data)), out=self.sums[1:])
        self.back = powers(_BASE_INVERSE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, size: int) -> np.ndarray:
        """The hash at every place where a gram of this size starts."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words(), of letters, digits, apostrophes and bytes from 80 on."""
    return words(data, offsets, _LETTER)


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the next counts[i] values for each row i; 0 for none."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


def share_kept(rows: int, most: int) -> int:
    """The bound under which 30 hash bits must lie so that about `most` of so many rows stay, all if fewer."""
    return 1 << 30 if rows <= most else (most << 30) // rows


def hashed(column: str):
    """30 bits that depend on the id alone, for a sample that is the same in every run."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << 30))


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] for all i, one after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - first, lengths) + np.arange(total)]
