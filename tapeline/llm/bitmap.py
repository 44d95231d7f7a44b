"""A bitmap of bounded size over 64-bit ids, put together by tasks: a filter before a shuffle, never an answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeline.llm.shared import mixed

MOST_BITS = 1 << 27
_CHUNK = 1 << 16


class Bitmap:
    """May hold ids that were not put in, about one in 32 while there are fewer than MOST_BITS / 32 of them."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __contains__(self, _: object) -> bool:
        raise TypeError("ask for whole arrays by has()")

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = _places(ids, len(self.bits) * 8)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _places(ids: np.ndarray, size: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64, copy=False).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def bitmap(ids: DataFrame) -> Bitmap:
    """The bitmap of a table's only column of longs without nulls; its blocks are joined before they reach the driver."""
    size = min(MOST_BITS, max(_CHUNK, 1 << (32 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_places(np.asarray(batch.column(0)), size)] = True
        blocks = bits.reshape(-1, _CHUNK)
        some = np.flatnonzero(blocks.any(1))
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array([np.packbits(blocks[k]).tobytes() for k in some], pa.binary())], ["block", "bits"])

    def either(rows: pa.Table) -> pa.Table:
        every = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        return pa.table({"block": rows.column("block")[:1], "bits": pa.array([np.bitwise_or.reduce(every, 0).tobytes()], pa.binary())})

    made = ids.coalesce(8).mapInArrow(run, "block long, bits binary").groupBy("block").applyInArrow(either, "block long, bits binary").toPandas()
    out = np.zeros((size // _CHUNK, _CHUNK // 8), np.uint8)
    for k, bits in zip(made["block"], made["bits"], strict=True):
        out[k] = np.frombuffer(bits, np.uint8)
    return Bitmap(out.ravel())
