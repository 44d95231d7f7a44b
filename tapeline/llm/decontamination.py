"""Benchmark decontamination by the q-gram lemma: shared character q-grams are counted in overlapping diagonal
bands, regions that meet the edit-budget bound are retained and verified by banded alignment.

Texts and items are compared in lower case with runs of white space as one space. An item of m characters may
appear with e = floor(edit_share * m) edits; such a region shares at least m - q + 1 - q * e q-grams with it on
diagonals no more than e apart, and so within one of the bands of 2 (e + 1) diagonals that start every e + 1. Grams
have q = min(Q, m / (e + 1)) characters, so that every item, however short, has a bound of one gram or more; items
of fewer than WORDS_ONLY characters count where they stand as whole words alone.

An item is found whole, with its edits; a part of it that misses more than that is no find. One pass over the texts
for each block of items, without a shuffle. A block's items have about BLOCK characters in all, and a block's finds
are written before the next goes to the tasks, so what goes to them is bounded however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.shared import gathered, powers, released, slices, texts, written

Q = 10
EDIT_SHARE = 0.08
#: Items of fewer normalised characters are looked for as whole words: inside of words they say nothing.
WORDS_ONLY = 24
BLOCK = 4_000_000
_BITS = 22
_SLICE = 1 << 20
_HITS = 1 << 20
_CELLS = 1 << 22
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lower, space, word = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        if len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
        space[c], word[c] = chr(c).isspace(), chr(c).isalnum()
    lower[space] = 32
    code = np.random.default_rng(11).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)
    return lower, space, word, code


_LOWER, _SPACES, _WORDS, _CODE = _tables()


def _in_word(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter or digit stands at these places; places outside are taken to the nearest inside."""
    return _WORDS[points[np.clip(at, 0, max(len(points) - 1, 0))] & 0xFFFF] if len(points) else np.zeros(len(at), bool)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 rows as normalised code points with row offsets, each point's place among the row bytes' characters,
    and the characters before each row."""
    points = np.frombuffer(data.tobytes().decode("utf-8", errors="replace").encode("utf-32-le", errors="replace"), np.uint32)
    firsts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    rows = firsts[offsets]
    if len(points) != firsts[-1]:  # bytes that are no UTF-8: count row by row
        rows = np.concatenate([[0], np.cumsum([len(data[a:b].tobytes().decode("utf-8", errors="replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])])
        points = np.frombuffer("".join(data[a:b].tobytes().decode("utf-8", errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)).encode("utf-32-le"), np.uint32)
    low = points & 0xFFFF
    plain = points < 1 << 16
    blank = _SPACES[low] & plain
    again = np.zeros(len(points), bool)
    again[1:] = blank[1:] & blank[:-1]
    again[rows[:-1][rows[:-1] < len(points)]] = False
    kept = np.flatnonzero(~again)
    out = np.where(plain, _LOWER[low], points)[kept]
    return out, np.searchsorted(kept, rows), kept, rows


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points)
    if n < q:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    code = _CODE[points & 0xFFFF]
    high = points >> 16
    if high.any():
        code = code + high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    np.cumsum(code * powers(_BASE, n), out=sums[1:])
    return (sums[q:] - sums[: n - q + 1]) * powers(_BACK, n + 1)[: n - q + 1]


def item_points(text: str) -> np.ndarray:
    raw = np.frombuffer(text.strip().encode(), np.uint8)
    return normalised(raw, np.array([0, len(raw)]))[0]


def gram_size(size: int, q: int, edit_share: float) -> int:
    """The q of an item of this size: at least one gram is left by its edits."""
    return max(1, min(q, size // (int(edit_share * size + 1e-9) + 1)))


@dataclass
class Items:
    """Some items of one gram size, with an index of their q-grams."""

    ids: list[int]
    points: list[np.ndarray]
    q: int = Q
    edit_share: float = EDIT_SHARE
    budget: np.ndarray = field(init=False)
    bound: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = np.array([len(x) for x in self.points], np.int64)
        self.budget = np.floor(self.edit_share * size + 1e-9).astype(np.int64)
        self.bound = size - self.q + 1 - self.q * self.budget
        hashes = [gram_hashes(x, self.q) for x in self.points]
        every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([*[np.arange(len(h)) for h in hashes], np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.many = np.unique(every[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def regions(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and first diagonal of each band that holds enough shared q-grams."""
        none = (np.zeros(0, np.int64),) * 3
        hashes = gram_hashes(points, self.q)
        if not len(hashes) or not len(self.grams):
            return none
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        row = np.searchsorted(bounds, at, side="right") - 1
        good = (self.grams[gram] == hashes[at]) & (at + self.q <= bounds[row + 1])
        at, gram, row = at[good], gram[good], row[good]
        many = self.many[gram]
        most = int(max((len(x) for x in self.points), default=0))
        wide = len(points) + 2 * most + 3
        found, begin = [], 0
        ends = np.cumsum(many)
        while begin < len(at):  # hits of some grams at a time, put together by band
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _HITS, side="right")))
            own = many[begin:end]
            entry = gathered(np.arange(len(self.item)), self.first[gram[begin:end]], own)
            item = self.item[entry]
            diagonal = np.repeat(at[begin:end] - bounds[row[begin:end]], own) - self.place[entry] + most  # from 0
            found.append(np.unique((np.repeat(row[begin:end], own) * len(self.ids) + item) * wide + diagonal // (self.budget[item] + 1) + 1, return_counts=True))
            begin = end
        if not found:
            return none
        key, number = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        count = np.bincount(number, np.concatenate([c for _, c in found]))
        which, inverse = np.unique(np.concatenate([key, key - 1]), return_inverse=True)  # a hit counts in its own band and in the one before
        total = np.bincount(inverse, np.concatenate([count, count])).astype(np.int64)
        pair = which // wide
        item = pair % len(self.ids)
        enough = total >= self.bound[item]
        pair, item, band = pair[enough], item[enough], which[enough] % wide - 1
        return pair // len(self.ids), item, band * (self.budget[item] + 1) - most

    def aligned(self, points: np.ndarray, bounds: np.ndarray, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, edits, start and end (in the row) of the regions whose best alignment within the band keeps the
        budget; as many regions at once as keep their letters within _CELLS."""
        size = np.array([len(x) for x in self.points], np.int64)[item]
        order, found, at = np.argsort(size, kind="stable"), [np.zeros((5, 0), np.int64)], 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * size[order[min(len(order), end + 64) - 1]] <= _CELLS:
                end = min(len(order), end + 64)
            own = order[at:end]
            edits, start, stop = self._band(points, bounds, row[own], item[own], diagonal[own])
            good = edits <= self.budget[item[own]]
            found.append(np.stack([row[own], item[own], edits, start, stop])[:, good])
            at = end
        row, item, edits, start, end = np.concatenate(found, axis=1)
        start, end = np.maximum(start, 0), np.minimum(end, bounds[row + 1] - bounds[row])
        short = np.array([len(x) for x in self.points], np.int64)[item] < WORDS_ONLY
        a, b = bounds[row] + start, bounds[row] + end
        inner = (a > bounds[row]) & _in_word(points, a - 1) & _in_word(points, a) | (b < bounds[row + 1]) & _in_word(points, b) & _in_word(points, b - 1)
        return tuple(x[~(short & inner)] for x in (row, item, edits, start, end))

    def _band(self, points: np.ndarray, bounds: np.ndarray, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edits, start and end (in the row) of each item's best alignment within its band; all regions at once."""
        budget = self.budget[item]
        size = np.array([len(self.points[i]) for i in item])
        width = 2 * (budget + 1)
        wide, long = int(width.max()), int(size.max())
        far = 1 << 40
        letters = np.full((len(item), long), 0xFFFFFFFE, np.uint32)
        for k, i in enumerate(item):
            letters[k, : size[k]] = self.points[i]
        lane = np.arange(wide)
        one = 1 << 20
        ramp = lane * one
        now = np.where(lane < width[:, None], lane, far)  # edits * one + the lane where the alignment starts
        best = np.full((len(item), wide), far)
        begin, end = bounds[row] + diagonal, bounds[row + 1]
        for i in range(long):
            where = begin[:, None] + i + lane
            inside = (where >= bounds[row][:, None]) & (where < end[:, None])
            other = np.where(inside, points[np.clip(where, 0, len(points) - 1)], 0xFFFFFFFF)
            cost = now + np.where(other == letters[:, i : i + 1], 0, one)
            cost[:, :-1] = np.minimum(cost[:, :-1], now[:, 1:] + one)
            now = np.minimum.accumulate(cost - ramp, axis=1) + ramp
            now = np.where(lane < width[:, None], now, far)
            done = size == i + 1
            if done.any():
                best[done] = now[done]
        lane_end = best.argmin(1)
        value = best[np.arange(len(item)), lane_end]
        return value // one, diagonal + value % one, diagonal + size + lane_end


def _apart(row: np.ndarray, item: np.ndarray, edits: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    """Of alignments of one item that overlap in one row, the one of fewest edits, then the first."""
    kept: list[int] = []
    for k in np.lexsort((end, start, item, row)):
        p = kept[-1] if kept else -1
        if p >= 0 and (row[p], item[p]) == (row[k], item[k]) and start[k] < end[p]:
            if edits[k] < edits[p]:
                kept[-1] = k
        else:
            kept.append(k)
    return kept


def indexes(items: list[tuple[int, str]], q: int, edit_share: float) -> list[Items]:
    """The items that have characters, by gram size."""
    groups: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, text in items:
        points = item_points(text)
        if len(points):
            groups.setdefault(gram_size(len(points), q, edit_share), []).append((i, points))
    return [Items([i for i, _ in some], [x for _, x in some], size, edit_share) for size, some in sorted(groups.items())]


def _searched(documents: DataFrame, shared: Broadcast) -> DataFrame:
    """The finds of a broadcast list of Items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text"), _SLICE):
                points, bounds, place, before = normalised(part.data, part.offsets)
                for block in shared.value:
                    row, item, diagonal = block.regions(points, bounds)
                    if not len(row):
                        continue
                    row, item, edits, start, end = block.aligned(points, bounds, row, item, diagonal)
                    k = np.array(_apart(row, item, edits, start, end), np.int64)
                    row, item, edits, start, end = (x[k] for x in (row, item, edits, start, end))
                    first = place[bounds[row] + start] - before[row]
                    last = place[bounds[row] + end - 1] + 1 - before[row]
                    docs = batch.column("doc_id").slice(part.first, len(part)).take(pa.array(row))
                    ids = np.array(block.ids, np.int64)[item]
                    yield pa.record_batch([docs, pa.array(ids), *(pa.array(x.astype(np.int32)) for x in (first, last, edits))], ["doc_id", "item_id", "start", "end", "edits"])

    return texts(documents).mapInArrow(released(run), "doc_id long, item_id long, start int, end int, edits int")


def leaks(documents: DataFrame, benchmark: DataFrame, *, q: int = Q, edit_share: float = EDIT_SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, end, edits: each place where a document has a benchmark item, in characters.

    Null and empty texts have none; null and blank items are not searched; an item given twice is reported under
    each id, equal rows of documents each for itself; an empty benchmark gives no rows. Several alignments of one
    item that overlap count as one. A benchmark of more than `block` characters is dealt by hash into blocks."""
    spark = documents.sparkSession
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block) if total > block else 1)
    dealt, out = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)), None
    for k in range(blocks):
        rows = (items.where(dealt == k) if blocks > 1 else items).orderBy("item_id", "text").collect()  # about `block` characters at most
        shared = spark.sparkContext.broadcast(indexes([(r["item_id"], r["text"]) for r in rows], q, edit_share))
        found = _searched(documents, shared)
        if blocks > 1:
            found = written(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a text of documents has an item of benchmark."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
