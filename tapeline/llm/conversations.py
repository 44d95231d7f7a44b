"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

A dynamic program over turns and grammar states gives each place its cost to the end, from back to front; a walk
from front to back then takes the ASCII-least edit among those that the costs allow. States: 0 at the start, 1 after
a system turn, 2 after a user's, 3 after an assistant's; 0 and 3 may end.

Turns are dealt by range of conversation and turn, so that a long conversation spreads over tasks, and a task handles
a conversation that it has whole by itself. Of others it makes segments with 4 x 4 costs between states; these are
short rows, folded from back to front into the costs behind each segment, and the walk then takes segment by segment.
A digest of a whole conversation is one stream by nature: the last pass reads one in order, a segment at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.folds import fold
from tapeline.llm.shared import written

#: Turns, and characters of them, in a segment.
SEGMENT_ROWS, SEGMENT_CHARS = 5_000, 1 << 20
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SOUND, BLANK, DUPLICATE, CUT = range(4)
NAMES = {"u": "user", "a": "assistant"}
ROLE, NEXT = ("u", "u", "a", "u"), (2, 2, 3, 2)
#: Costs behind the last turn: the turns that are still to insert.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 50

_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_TAIL = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
_LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after the damage that crc32(`conv_id:turn`) % 20 names; nulls of the first
    two stay, but count as a space in that text, and those of role and text become a space."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat_ws(":", *names)) % 20
    kept = F.when(fate == 0, "").when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(role).alias("role"), kept.alias("text"), copies.alias("copies"))


def fault_of(text: str, seen: bool) -> int:
    """A turn's first fault."""
    if not _SOLID.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if _TAIL.search(text)[1] in ".!?" else CUT


def costs(steps: list[tuple[str, str, int]], after: list[int] | tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each step (role, text, fault) the least cost from each state to what `after` tells, `after` the last."""
    found, c = [tuple(after)], after
    for role, _, fault in reversed(steps):
        b = [DELETE + x for x in c]
        if fault in (SOUND, CUT):
            extra = TRUNCATED if fault == CUT else 0
            initial = role[:1]
            for s in range(4):
                b[s] = min(b[s], extra + c[NEXT[s]] + (0 if initial == ROLE[s] else REROLE))
            if initial == "s":
                b[0] = min(b[0], extra + c[1])
        b[2], b[3] = min(b[2], INSERT + b[3]), min(b[3], INSERT + b[2])
        b[0], b[1] = min(b[0], INSERT + b[2]), min(b[1], INSERT + b[2])
        c = tuple(b)
        found.append(c)
    return found[::-1]


class Walk:
    """The forward walk of a conversation: its state, edits, and the digest of the repaired turns."""

    def __init__(self) -> None:
        self.state, self.audit, self.digest, self.turns, self.cost = 0, [], hashlib.sha256(), 0, None

    def put(self, edit: str, role: str | None = None, text: str = "") -> None:
        self.audit.append(edit)
        if role is not None:
            self.digest.update((("\n" if self.turns else "") + f"{role}:{text}").encode())
            self.turns += 1

    def insert(self) -> None:
        self.put("I", NAMES[ROLE[self.state]])
        self.state = NEXT[self.state]

    def take(self, steps: list[tuple[str, str, int]], after: list[int] | tuple[int, ...]) -> None:
        """Goes on over these steps; `after` are the costs behind them."""
        table = costs(steps, after)
        if self.cost is None:
            self.cost = table[0][0]
        for i, (role, text, fault) in enumerate(steps):
            while True:
                s, here, c = self.state, table[i], table[i + 1]
                if DELETE + c[s] == here[s]:
                    self.put("D")
                elif INSERT + here[NEXT[s]] == here[s]:
                    self.insert()
                    continue
                else:
                    extra, initial = TRUNCATED if fault == CUT else 0, role[:1]
                    if initial == ROLE[s] and extra + c[NEXT[s]] == here[s]:
                        self.put("K", role, text)
                        self.state = NEXT[s]
                    elif s == 0 and initial == "s" and extra + c[1] == here[s]:
                        self.put("K", role, text)
                        self.state = 1
                    else:
                        self.put("R", NAMES[ROLE[s]], text)
                        self.state = NEXT[s]
                break

    def end(self) -> tuple[int, str, str]:
        while self.state in (1, 2):
            self.insert()
        return self.cost or 0, "".join(self.audit), self.digest.hexdigest()


class Segment:
    """Some turns of a conversation, one after the other, with what the report counts."""

    def __init__(self, *, cut: bool = False) -> None:
        self.cut, self.steps, self.chars, self.faults = cut, [], 0, [0] * 4
        self.turns, self.low, self.high, self.illegal, self.last = 0, None, None, 0, None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in _LEGAL
        self.last = role[:1]
        gone = fault in (BLANK, DUPLICATE)
        self.steps.append((role[:1] if gone else role, "" if gone else text, fault))
        self.chars += len(text)

    def row(self) -> dict:
        counts = dict(zip(("blank", "duplicate", "truncated"), self.faults[1:], strict=True))
        first = self.steps[0][0][:1] if self.steps else None
        return {"turns": self.turns, "low": self.low, "high": self.high, "illegal": self.illegal, "first": first, "last": self.last, **counts}

    def between(self) -> list[int]:
        """The least costs from each state before to each state behind, row by row."""
        ends = [costs(self.steps, [0 if s == e else FAR for s in range(4)])[0] for e in range(4)]
        return [min(ends[e][s], FAR) for s in range(4) for e in range(4)]


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PARTS = "turns long, low long, high long, first string, last string, between array<long>, roles array<string>, texts array<string>, faults array<int>"
_COLUMNS = [x.split()[0] for x in _RESULT.split(", ")]


def _dealt(rows: DataFrame) -> DataFrame:
    """The turns in order, by range, ahead of the first of each role and text of a conversation a mark with its number.

    Each row has a number of its own, so that even the copies of one turn spread over tasks."""
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = written(rows.select("*", digest.alias("digest"), F.monotonically_increasing_id().alias("own")), "turns")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "own")).alias("first")
    marks = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(first)
    marks = marks.select("conv_id", "first.turn", "role", F.lit("").alias("text"), F.lit(0).alias("copies"), "digest", "first.own", F.lit(True).alias("mark"))
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "digest", "own"]
    both = rows.select("*", F.lit(False).alias("mark")).union(marks)
    return both.repartitionByRange(count, *keys).sortWithinPartitions(*keys, F.desc("mark"))


def _segments(rows: DataFrame, most: int) -> DataFrame:
    """Results of the conversations that a task has whole, and segments of all others (`seg` not null)."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, seg long, {_RESULT}, {_PARTS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, opened, held, out = TaskContext.get().partitionId(), 0, 0, 0, []
        names, types = [x.split()[0] for x in schema.split(", ")], None
        key, segment, first = None, None, None

        def closed(whole: bool) -> dict:
            nonlocal number
            row = {"conv_id": key[0], **segment.row()}
            if whole:
                walk = Walk()
                walk.take(segment.steps, END)
                return row | dict(zip(("cost", "audit", "repaired_sha256"), walk.end(), strict=True)) | {"gaps": _gaps(segment.low, segment.high, segment.turns)}
            number += 1
            roles, texts, faults = ([s[k] for s in segment.steps] for k in range(3))
            return row | {"seg": (part << 32) + number, "between": segment.between(), "roles": roles, "texts": texts, "faults": faults}

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in zip(names, types, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            types = types or [_arrow(t, batch.schema.field("conv_id").type) for t in schema.split(", ")]
            for conv, turn, role, own, text, copies, mark in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "own", "text", "copies", "mark")), strict=True):
                if key != (conv,):
                    if key is not None:  # the first conversation of a task may have begun in another one
                        out.append(closed(whole=opened > 1 and not segment.cut))
                    key, segment, first, opened = (conv,), Segment(), None, opened + 1
                if mark:
                    first = own
                for k in range(copies):
                    if len(segment.steps) >= most or segment.chars > SEGMENT_CHARS:
                        out.append(closed(whole=False))
                        held += segment.chars
                        segment = Segment(cut=True)
                    segment.add(turn, role, text, fault_of(text, seen=bool(k) or own != first))
                if out and (held > 8 * SEGMENT_CHARS or len(out) > 2_000):
                    held = 0
                    yield flushed()
        if key is not None:  # the last one may go on in the next
            out.append(closed(whole=False))
            yield flushed()

    return rows.mapInArrow(run, schema)


def _arrow(field: str, conv: pa.DataType) -> pa.DataType:
    name, kind = field.split()
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    return conv if name == "conv_id" else kinds[kind]


def _behind(segments: DataFrame) -> DataFrame:
    """conv, seg, after: the costs behind each segment, from short rows folded from back to front."""

    def step(state: list, seg: int, between) -> tuple:
        after = list(state)
        state[:] = [min(int(between[4 * s + e]) + after[e] for e in range(4)) for s in range(4)]
        return seg, after

    return fold(segments.withColumn("back", -F.col("seg")), ["conv"], ["back"], ["seg", "between"], lambda: list(END), step, "seg long, after array<long>")


def _joined(segments: DataFrame, conv: str) -> DataFrame:
    """The results of conversations in segments, each read in order as a stream."""
    schema = f"conv_id {conv}, {_RESULT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        names, types = [x.split()[0] for x in schema.split(", ")], None

        def result() -> pa.RecordBatch:
            row = total | dict(zip(("cost", "audit", "repaired_sha256"), walk.end(), strict=True)) | {"gaps": _gaps(total["low"], total["high"], total["turns"])}
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, types, strict=True)], names)

        total = {}
        for batch in batches:
            types = [_arrow(t, batch.schema.field("conv_id").type) for t in schema.split(", ")]
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if walk is None or row["conv"] != total["conv"]:
                    if walk is not None:
                        yield result()
                    walk, total = Walk(), {"conv": row["conv"], "conv_id": row["conv_id"], "low": None, "high": None, "last": None, **dict.fromkeys(("turns", "illegal", "blank", "duplicate", "truncated"), 0)}
                walk.take(list(zip(row["roles"], row["texts"], row["faults"], strict=True)), row["after"])
                for c in ("illegal", "blank", "duplicate", "truncated"):
                    total[c] += row[c]
                if row["first"] is not None:
                    total["illegal"] += total["last"] is not None and total["last"] + row["first"] not in _LEGAL
                    total["last"] = row["last"]
                if row["low"] is not None:
                    total["turns"] += row["turns"] - (row["low"] == total["high"])
                    total["low"], total["high"] = row["low"] if total["low"] is None else total["low"], row["high"]
        if walk is not None:
            yield result()

    return segments.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(run, schema)


def repaired(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """conv_id and the report of each conversation of rows (conv_id, turn, role, text, copies): gaps, blank,
    duplicate, truncated, illegal, cost, audit and the digest of the repaired turns.

    Turns are in order of turn, nulls first, then of role and of a digest of role and text. Rows of no copies keep
    their conversation alone. A null conv_id is a conversation like others; role and text must not be null."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    made = written(_segments(_dealt(rows), segment_rows), "conversations")
    whole = made.where("seg IS NULL").select("conv_id", *_COLUMNS)
    segments = made.where("seg IS NOT NULL").withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    return whole.union(_joined(segments.join(_behind(segments), ["conv", "seg"]), conv).select("conv_id", *_COLUMNS))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's damage and its repair. Null and blank texts are blank turns, repeated rows duplicates, an
    unknown or null role is one that no grammar state expects; other columns stay unread; no rows give none."""
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
