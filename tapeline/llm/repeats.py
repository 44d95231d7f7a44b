"""Suffix-array dedup: strings of a given length that occur more than once, by longest-previous-factor arrays.

Strings are of bytes, or of words for passages that documents share. The factor arrays decide: a place starts a
repeat where its longest match with an earlier place (or with an earlier or a later one, or with another document)
is as long as asked for, and the match covers its units. They are read from suffix arrays (suffixes.py) of blocks:

Every window of `length` units has an anchor, its leftmost gram of smallest hash, so equal windows have equal
anchors at equal offsets. The windows of one anchor stand next to each other and are its context. The contexts of
one anchor make a block, and a block has one suffix array, into which a context that occurs several times enters once
and then stands twice, for its first place and for all others. An anchor that occurs once has no repeats. A block of more than
`most` contexts is halved by where its windows start, with a longer common string as its key; parts of contexts
that have become equal are one context again, so that blocks end where they have one window start at the latest.
Nothing is sampled. Anchors, contexts and keys are compared by 64-bit hashes, the strings themselves by their units.

Texts are read in place for each step; only hashes, the different contexts of repeated anchors and, at the end, the
rows that have spans are shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.folds import dealt
from tapeline.llm.bitmap import Bitmap, bitmap
from tapeline.llm.shared import Rolling, lowered, mixed, slices, texts, words, written
from tapeline.llm.suffixes import Suffixes, factors, factors_elsewhere, with_copies

LENGTH = 400
GRAM = 200
#: A passage that documents share has so many words or more.
PASSAGE = 50
#: Contexts that one suffix array may hold.
MOST = 500
_BATCH = 1 << 17
_ROWS = 512
_FEW = 1 << 20
_SLICE = 1 << 20


def anchors(rolling: Rolling, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the leftmost smallest gram of each window that lies within one row, ascending, and the first and
    last start of the windows that have it."""
    grams = rolling.grams(gram)
    wide = length - gram + 1
    size = np.diff(offsets)
    many = np.maximum(size - length + 1, 0)
    if not many.sum():
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(int(len(grams)).bit_length())
    least = _least((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), wide)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.zeros(len(place) + 1, bool)  # where a run of windows begins: those of one anchor, or those across rows
    new[1:-1] = place[1:] != place[:-1]
    new[offsets[:-1][many > 0]] = new[(offsets[:-1] + many)[many > 0]] = new[-1] = True
    edges = np.flatnonzero(new)
    row = np.searchsorted(offsets, edges[:-1], side="right") - 1
    first = np.flatnonzero(edges[:-1] < (offsets[:-1] + many)[row])
    return place[edges[first]], edges[first], edges[first + 1] - 1


def _least(value: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` values that follow each other."""
    least, have = value, 1
    while 2 * have <= wide:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    return np.minimum(least[: len(value) - wide + 1], least[wide - have :]) if have < wide else least


class Layout:
    """Window length and gram in bytes or words; windows start at most `back` units before their anchor."""

    def __init__(self, length: int, gram: int, unit: str = "byte") -> None:
        if not 1 <= gram <= length:
            raise ValueError("a gram is at least a unit and at most a window")
        self.length, self.gram, self.back, self.unit = length, gram, length - gram, unit
        self.kind = np.dtype(np.uint8 if unit == "byte" else np.uint32)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A slice's units, as bytes or as hashes of lower-cased words, and where each row's begin and end."""
        if self.unit == "byte":
            return data, offsets
        data = lowered(data)
        starts, ends, count = words(data, offsets)
        return Rolling(data).of(starts, ends), np.concatenate([[0], np.cumsum(count)])


def _row_id():
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _scan(documents: DataFrame, layout: Layout, emit, schema: str, only=None) -> DataFrame:
    """emit(units, offsets, batch, rolling, at, row, start, end) makes the output of a slice of texts: its anchors
    at `at` of the rows `row`, with their contexts from start to end. Rows that are not in `only` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(only.value.has(np.asarray(batch.column("row")))))
            for part in slices(batch.column("text"), _SLICE):
                units, offsets = layout.units(part.data, part.offsets)
                rolling = Rolling(units)
                at, first, last = anchors(rolling, offsets, layout.length, layout.gram)
                if len(at):
                    row = np.searchsorted(offsets, at, side="right") - 1
                    made = emit(units, offsets, batch.slice(part.first, len(part)), rolling, at, row, first, last + layout.length)
                    if made is not None and made.num_rows:
                        yield made

    return texts(documents, _row_id().alias("row")).mapInArrow(run, schema)


def _place_id(row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mixed(row.astype(np.int64).view(np.uint64) + pos.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _context_id(rolling: Rolling, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed(rolling.of(start, end) + (at - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def repeated_anchors(documents: DataFrame, layout: Layout) -> Bitmap:
    """The anchors that occur more than once, in a bitmap of bounded size that may hold others."""

    def emit(units, offsets, batch, rolling, at, row, start, end):
        anchor, times = np.unique(rolling.of(at, at + layout.gram), return_counts=True)
        return pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(times)], ["anchor", "n"])

    found = _scan(documents, layout, emit, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    return bitmap(written(found, "repeat-anchors"))


def occurrences(documents: DataFrame, layout: Layout, wanted) -> DataFrame:
    """row, doc_id, pos, place, anchor, context of the wanted anchors of every row."""

    def emit(units, offsets, batch, rolling, at, row, start, end):
        anchor = rolling.of(at, at + layout.gram).view(np.int64)
        some = wanted.value.has(anchor)
        at, row, start, end, anchor = at[some], row[some], start[some], end[some], anchor[some]
        pos, take = at - offsets[row], pa.array(row)
        rows = batch.column("row").take(take)
        made = [pos.astype(np.int32), _place_id(np.asarray(rows), pos), anchor, _context_id(rolling, at, start, end)]
        return pa.record_batch([rows, batch.column("doc_id").take(take), *map(pa.array, made)], ["row", "doc_id", "pos", "place", "anchor", "context"])

    return _scan(documents, layout, emit, "row long, doc_id long, pos int, place long, anchor long, context long")


#: A context, or the part of it that belongs to a key: its first place (any one of them, without doc_id and pos, unless
#: "earlier" is asked for), how many places it has and whether in several rows, the units from `shift` before the anchor on, of which windows start between low and high around the anchor.
_STRINGS = "key long, context long, doc_id long, row long, pos int, place long, n long, several boolean, low int, high int, shift int, units binary"
_NAMES = [x.split()[0] for x in _STRINGS.split(", ")]


def _units_of(documents: DataFrame, layout: Layout, wanted, among, only) -> DataFrame:
    """The units of the contexts of wanted places among some anchors, of some rows; what else a row of _STRINGS has is null."""

    def emit(units, offsets, batch, rolling, at, row, start, end):
        rows = np.asarray(batch.column("row"))[row]
        place = _place_id(rows, at - offsets[row])
        anchor = rolling.of(at, at + layout.gram).view(np.int64)
        some = wanted.value.has(place) & among.value.has(anchor)
        at, start, end, place, anchor = at[some], start[some], end[some], place[some], anchor[some]
        small = units.astype(layout.kind)
        return pa.record_batch([
            pa.array(anchor), pa.array(_context_id(rolling, at, start, end)), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), pa.array(place),
            pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.bool_()), pa.array(np.full(len(at), -layout.back, np.int32)), pa.array(np.zeros(len(at), np.int32)), pa.array((at - start).astype(np.int32)),
            pa.array([small[x:y].tobytes() for x, y in zip(start, end, strict=True)], pa.binary()),
        ], _NAMES)

    return _scan(documents, layout, emit, _STRINGS, only)


def _joined(held: pa.Table) -> pa.Table:
    """Rows of _STRINGS that have n and those that have units, put together by key, context and place."""
    known, raw = held.column("n").is_valid().to_numpy(), held.column("units").is_valid().to_numpy()
    if (known & raw).all():
        return held
    ids = [np.asarray(held.column(c)) for c in ("key", "context", "place")]
    order = np.lexsort((~known, *ids[::-1]))
    ids, known = [x[order] for x in ids], known[order]
    same = np.all([x[1:] == x[:-1] for x in ids], axis=0)
    pair = np.flatnonzero(same & known[:-1] & ~known[1:])
    about, units = held.take(pa.array(order[pair])), held.take(pa.array(order[pair + 1]))
    return about.select(_NAMES[:8]).append_column("low", units.column("low")).append_column("high", units.column("high")).append_column("shift", units.column("shift")).append_column("units", units.column("units"))


def _without_repeats(held: pa.Table) -> pa.Table:
    """One row of each (key, context, place) and kind: equal rows of documents give theirs more than once."""
    ids = [np.asarray(held.column(c)) for c in ("key", "context", "place")] + [held.column("n").is_valid().to_numpy()]
    order = np.lexsort(ids[::-1])
    new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in ids], axis=0)])
    return held.take(pa.array(np.sort(order[new])))


def _stream(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    """use() of tables of some whole keys, of a stream in the order of keys."""
    held, weight = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            new = pa.Table.from_batches([batch.slice(at, _ROWS)])
            held = _without_repeats(pa.concat_tables([held, new]) if held is not None else new)
            weight += new.nbytes
            if weight > _BATCH:
                key = np.asarray(held.column("key"))
                if key[0] != key[-1]:
                    cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
                    yield from use(held.slice(0, cut))
                    held = held.slice(cut)
                weight = held.nbytes
    if held is not None and held.num_rows:
        yield from use(held)


_FOUND = "context long, first long, other boolean, low int, high int"


def longest(held: pa.Table, layout: Layout, by: str) -> tuple[np.ndarray, ...]:
    """For every context of some keys: its number twice, for the first place and the others, with where its units
    begin in the buffer, how many there are, and the buffer's longest factors of `length` or more.

    by is "earlier" (matches before a place count), "any" (all other places) or "row" (places of other rows)."""
    part = next(slices(held.column("units"), 1 << 62))
    n, low, high, shift = (np.asarray(held.column(c)).astype(np.int64) for c in ("n", "low", "high", "shift"))
    size = layout.kind.itemsize
    first = np.maximum(low + shift, 0)  # units that the key's windows have
    last = np.minimum(high + shift + layout.length, np.diff(part.offsets) // size)
    lengths = last - first + 1
    begins = np.cumsum(lengths) - lengths
    units = np.zeros(int(lengths.sum()), layout.kind)
    flat = np.frombuffer(part.data.tobytes(), layout.kind)
    at = np.ones(len(units), bool)
    at[begins + lengths - 1] = False
    take = np.repeat(part.offsets[:-1] // size + first - begins, lengths) + np.arange(len(units))
    units[at] = flat[take[at]]
    suffixes = Suffixes(units, np.repeat(begins + lengths - 1, lengths), layout.length)
    order, shared = with_copies(suffixes, suffixes.shared(layout.length), lengths, n > 1, layout.length)
    number = np.repeat(np.arange(len(n)), np.where(n > 1, 2, 1))
    other = np.concatenate([[False], number[1:] == number[:-1]])
    lengths = lengths[number]
    begins = np.cumsum(lengths) - lengths
    long = np.zeros(int(lengths.sum()), bool)  # places of suffixes that can have such factors: they alone are compared
    long[order] = True
    order = (np.cumsum(long) - 1)[order]
    if by == "row":
        rows = np.unique(np.asarray(held.column("row")), return_inverse=True)[1]
        owner = np.where(other & np.asarray(held.column("several"))[number], -1 - np.arange(len(number)), rows[number])
        met = factors_elsewhere(order, shared, np.repeat(owner, lengths)[long])
    else:
        earlier, later = factors(order, shared, layout.length)
        met = earlier if by == "earlier" else np.maximum(earlier, later)
    found = np.zeros(len(long), np.int64)
    found[long] = met
    return number, other, begins, lengths - 1, found, first - shift


def _compared(strings: DataFrame, layout: Layout, by: str) -> DataFrame:
    """context, first (its first place), other (whether for its other places), low, high: the ranges around the anchor
    that longest factors cover. Keys follow each other in a stream; several share one suffix array."""
    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(held: pa.Table) -> Iterator[pa.RecordBatch]:
        held = _joined(held)
        if not held.num_rows:
            return
        held = held.take(pc.sort_indices(held, [(c, "ascending") for c in ("doc_id", "row", "pos", "key", "context")], null_placement="at_start"))
        number, other, begins, lengths, found, from_anchor = longest(held, layout, by)
        hit = found >= layout.length
        a = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))  # separators have no factors and part the strings
        if not len(a):
            return
        cover = np.maximum.reduceat(np.append(np.arange(len(found)) + found, 0), np.stack([a, np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]])) + 1], 1).ravel())[::2]
        string = np.searchsorted(begins, a, side="right") - 1
        shift = from_anchor[number[string]] - begins[string]
        take = pa.array(number[string])
        yield pa.record_batch([
            held.column("context").take(take).combine_chunks(), held.column("place").take(take).combine_chunks(), pa.array(other[string]),
            pa.array((a + shift).astype(np.int32)), pa.array((np.minimum(cover, (begins + lengths)[string]) + shift).astype(np.int32)),
        ], ["context", "first", "other", "low", "high"])

    whole = dealt(strings, "key", parts=parts).sortWithinPartitions("key")
    return whole.mapInArrow(lambda batches: _stream(batches, compare), _FOUND)


def _whole(strings: DataFrame) -> DataFrame:
    """The rows of _STRINGS put together, dealt by key and context: a large block lies in many tasks."""
    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = dealt(strings, "key", "context", parts=parts).sortWithinPartitions("key", "context")
    names = [f"`{x}`" for x in _NAMES]
    return whole.select(*names).mapInArrow(lambda batches: _stream_contexts(batches), _STRINGS)


def _stream_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            new = pa.Table.from_batches([batch.slice(at, _ROWS)])
            held = _without_repeats(pa.concat_tables([held, new]) if held is not None else new)
            key, context = np.asarray(held.column("key")), np.asarray(held.column("context"))
            own = (key != key[-1]) | (context != context[-1])
            if own.any():
                cut = int(np.flatnonzero(own)[-1]) + 1
                yield from _joined(held.slice(0, cut)).to_batches()
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from _joined(held).to_batches()


def _halved(strings: DataFrame, layout: Layout) -> DataFrame:
    """Each row of _STRINGS twice, for the first and the second half of its window starts, under keys of longer
    strings and with the context's own part of them; `parent` is the context that it comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = layout.kind.itemsize
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                units = np.frombuffer(r["units"], layout.kind)
                rolling = Rolling(units if size == 1 else mixed(units.astype(np.uint64)))
                middle = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    first, last = max(low, -r["shift"]), min(high, len(units) - r["shift"] - layout.length)
                    if first > last:
                        continue
                    a, b = first + r["shift"], last + r["shift"] + layout.length
                    own = rolling.of(np.array([a, high + r["shift"]]), np.array([b, low + layout.length + r["shift"]]))
                    key = mixed(own[1:] + np.array([r["key"]]).view(np.uint64) + np.uint64(high - layout.back & 0xFFFF)).view(np.int64)[0]
                    context = mixed(own[:1] + np.array([key]).view(np.uint64) + np.uint64(first + layout.back & 0xFFFF)).view(np.int64)[0]
                    out.append(r | {"parent": r["context"], "key": int(key), "context": int(context), "low": low, "high": high, "shift": -first, "units": r["units"][a * size : b * size]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema.append(pa.field("parent", pa.int64())))

    return strings.mapInArrow(run, _STRINGS + ", parent long")


def _once(halves: DataFrame) -> DataFrame:
    """One row of _STRINGS for each context: the first of its places, with the number of all."""
    first = F.min(F.struct("doc_id", "row", "pos", "place")).alias("first")
    same = halves.groupBy("key", "context", "low", "high", "shift").agg(first, F.sum("n").alias("n"), (F.bool_or("several") | (F.min("row") != F.max("row"))).alias("several"), F.first("units").alias("units"))
    return same.select("key", "context", *(F.col(f"first.{c}").alias(c) for c in ("doc_id", "row", "pos", "place")), "n", "several", "low", "high", "shift", "units")


def repeated_ranges(documents: DataFrame, *, length: int = LENGTH, gram: int = GRAM, unit: str = "byte", by: str = "earlier", most: int = MOST) -> DataFrame:
    """row (xxhash64 of doc_id and text), start, end: the ranges of bytes or words that longest factors of `length` or
    more cover, by matches with an "earlier" place, in order of (doc_id, row, place), with "any" other place, or with
    a place of another "row".

    Ranges of a row may overlap. Rows that are equal in doc_id and text are one row where matches are judged by
    "earlier" or "row"; by "any", the places of one are other places for the next, and they share their ranges."""
    layout = Layout(length, gram, unit)
    spark = documents.sparkSession
    among = spark.sparkContext.broadcast(repeated_anchors(documents, layout))
    places = written(occurrences(documents, layout, among), "repeat-places")
    if by == "earlier":
        own = F.min(F.struct("doc_id", "row", "pos", "place")).alias("first")
    else:  # any of its places will do as the first; aggregates of longs alone need no sort
        own = F.struct(F.lit(None).cast("long").alias("doc_id"), F.min_by("row", "place").alias("row"), F.lit(None).cast("int").alias("pos"), F.min("place").alias("place")).alias("first")
    several = F.min("row") != F.max("row") if by == "row" else F.lit(False)  # asked for by rows alone
    contexts = places.groupBy("context").agg(F.first("anchor").alias("key"), own, F.count("*").alias("n"), several.alias("several"))
    contexts = written(contexts.select("key", "context", *(F.col(f"first.{c}").alias(c) for c in ("doc_id", "row", "pos", "place")), "n", "several"), "repeat-contexts")
    blocks = written(contexts.groupBy("key").agg(F.count("*").alias("contexts"), F.sum("n").alias("n")).where("n > 1"), "repeat-blocks")
    met = written(contexts.join(blocks.select("key"), "key", "left_semi"), "repeat-wanted")
    wanted = spark.sparkContext.broadcast(bitmap(met.select("place")))
    none = {"low": "int", "high": "int", "shift": "int", "units": "binary"}

    def strings(known: DataFrame) -> DataFrame:
        only = spark.sparkContext.broadcast(bitmap(known.select("row")))
        return _units_of(documents, layout, wanted, among, only).unionByName(known.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items())))

    large = blocks.where(F.col("contexts") > most).select("key")
    if large.isEmpty():
        return _placed(places, _compared(strings(met), layout, by), layout)
    large = _few(large)  # so that the strings are shuffled once
    found = _compared(strings(met).join(large, "key", "left_anti"), layout, by)
    rows = written(_whole(strings(met.join(large, "key", "left_semi")).join(large, "key", "left_semi")), "repeat-strings")
    parts, small, roots = rows.select(F.col("context").alias("root"), "context"), [], []
    while not rows.isEmpty():
        halves = written(_halved(rows, layout), "repeat-halves")
        parts = parts.join(halves.select(F.col("parent").alias("context"), F.col("context").alias("part")).distinct(), "context").select("root", F.col("part").alias("context"))
        parts = written(parts, "repeat-parts")
        rows = written(_once(halves), "repeat-strings")
        sizes = written(rows.groupBy("key").agg(F.count("*").alias("contexts"), F.sum("n").alias("n")).where("n > 1"), "repeat-blocks")
        small.append(rows.join(_few(sizes.where(F.col("contexts") <= most).select("key")), "key", "left_semi"))
        roots.append(parts)
        rows = rows.join(_few(sizes.where(F.col("contexts") > most).select("key")), "key", "left_semi")
    # keys and contexts of one halving are none of another's
    halved, parts = (functools.reduce(DataFrame.unionByName, x) for x in (small, roots))
    halved = _compared(halved, layout, by).join(parts, "context").drop("context").withColumnRenamed("root", "context")
    return _placed(places, found.unionByName(halved), layout)


def _few(keys: DataFrame) -> DataFrame:
    """The keys, broadcast by a join unless they are very many."""
    return F.broadcast(keys) if keys.count() <= _FEW else keys


def _placed(places: DataFrame, found: DataFrame, layout: Layout) -> DataFrame:
    """row, start, end of the ranges around the anchors of all places of the contexts."""
    met = places.select("context", "place", "row", "pos").join(found, "context").where((F.col("place") != F.col("first")) == F.col("other"))
    return met.select("row", (F.col("pos") + F.col("low")).alias("start"), (F.col("pos") + F.col("high")).alias("end"))


def _merged(held: pa.Table) -> pa.RecordBatch:
    """row, edges (starts and ends of the maximal ranges of bytes, in turn), shared (units in its passages) of ranges
    in the order of row, passage and start."""
    row, passage, start, end = (np.asarray(held.column(c)).astype(np.int64) for c in ("row", "passage", "start", "end"))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (passage[1:] != passage[:-1])
    far = (np.cumsum(new) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + far) - far  # as far as the ranges up to this one of its row
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    row, passage, start, end = row[first], passage[first] != 0, start[first], reach[np.append(first[1:], len(reach)) - 1]
    rows, own = np.unique(row, return_inverse=True)
    edges = np.stack([start, end], 1)[~passage].ravel().astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(2 * np.bincount(own[~passage], minlength=len(rows)))]).astype(np.int32)
    shared = np.zeros(len(rows), np.int64)
    np.add.at(shared, own[passage], (end - start)[passage])
    return pa.record_batch([pa.array(rows), pa.ListArray.from_arrays(pa.array(offsets), pa.array(edges)), pa.array(shared)], ["row", "edges", "shared"])


def _spans(ranges: DataFrame) -> DataFrame:
    """row, edges and shared of every row that has ranges (row, passage, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            row = np.asarray(held.column("row"))
            cut = int(np.searchsorted(row, row[-1])) if len(row) else 0
            if cut:
                yield _merged(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _merged(held)

    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = dealt(ranges, "row", parts=parts).sortWithinPartitions("row", "passage", "start")
    return whole.mapInArrow(run, "row long, edges array<int>, shared long")


def without_repeats(documents: DataFrame, *, length: int = LENGTH, gram: int = GRAM, by: str = "earlier", most: int = MOST, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed byte ranges, ascending), kept (the other bytes) and
    shared_words of every row. With `passage`, shared_words is how many words of the row lie in passages of so many
    words or more (lower-cased, whatever the white space between them) that another row has too; without, it is null.

    Null texts count as empty; texts shorter than `length` lose nothing. kept is binary, as a cut may part a
    character's bytes. What equal rows lose is said at repeated_ranges(). Texts without ranges are not shuffled."""
    ranges = repeated_ranges(documents, length=length, gram=gram, by=by, most=most).withColumn("passage", F.lit(False))
    if passage:
        more = repeated_ranges(documents, length=passage, gram=max(1, passage // 2), unit="word", by="row", most=most)
        ranges = ranges.unionByName(more.withColumn("passage", F.lit(True)))
    spans = written(_spans(ranges.select("row", "passage", "start", "end")), "repeat-spans")
    some = documents.sparkSession.sparkContext.broadcast(bitmap(spans.select("row")))

    @F.arrow_udf("boolean")
    def has(row: pa.Array) -> pa.Array:
        return pa.array(some.value.has(np.asarray(row)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = batch.column("edges")
            at = np.asarray(edges.offsets)
            cut, at = np.asarray(edges.values)[at[0] : at[-1]], at - at[0]
            raw, kept = batch.column("text").cast(pa.binary()), []
            for k in range(batch.num_rows):
                text = raw[k].as_py()
                own = [0, *cut[at[k] : at[k + 1]].tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(own[::2], own[1::2], strict=True)))
            long = pc.binary_length(raw).cast(pa.int64())
            kept = pa.array(kept, pa.binary())
            pairs = pa.StructArray.from_arrays([pa.array(cut[::2]), pa.array(cut[1::2])], ["start", "end"])
            yield pa.record_batch([
                batch.column("doc_id"), long, pc.subtract(long, pc.binary_length(kept).cast(pa.int64())),
                pa.ListArray.from_arrays(pa.array((at // 2).astype(np.int32)), pairs), kept, batch.column("shared"),
            ], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "shared"])

    rows = texts(documents, _row_id().alias("row"))
    hit = rows.where(has("row")).join(spans, "row", "left").select("doc_id", "text", F.coalesce("edges", F.array().cast("array<int>")).alias("edges"), F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))
    hit = hit.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary, shared long")
    none = F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    left = rows.where(~has("row")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), none, F.col("text").cast("binary").alias("kept"), F.lit(0).cast("long").alias("shared"))
    shared = F.col("shared") if passage else F.lit(None).cast("long")
    return hit.unionByName(left).select("doc_id", "n_bytes", "n_removed", "spans", "kept", shared.alias("shared_words"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents without the 400-byte strings that also start elsewhere, and how many of its words lie
    in passages of PASSAGE words or more that another document has."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), by="any", passage=PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "shared_words")
