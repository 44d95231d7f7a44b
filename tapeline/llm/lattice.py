"""LM scoring by a subword lattice: the scores of an existing vocabulary weight all segmentations of a text, and
a forward recursion in log space gives the text's marginal probability.

Pieces don't cross white space, so a text's probability is the product of its words' marginals and one end. The
recursion runs once for each distinct word of the corpus. Vocabulary scores are merge ranks; their first weights
fall as 1 / rank and are then re-estimated from the expected piece counts of all training words (expectation
maximisation), so that the piece probabilities sum to one with the end.

Counts are shuffled by word. Words that make up more than one in HOT of all training tokens, HOT at most, go to
every task; the rest of a text's distinct words meet their counts in a join and come back as sums for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.shared import Rolling, gathered, held_out, lowered, slices, sums_by_row, texts, words, written

HOT = 1 << 20
ROUNDS = 2
SMOOTH = 0.5
END = b" "  # stands for the end of a text among words
_START = "▁".encode()
_SLOT_BITS = 22
_CELLS = 400_000
#: Longer words, in bytes, go through the recursion one by one, their arcs found for so many places at a time.
LONG = 256
_PLACES = 1 << 16
_SCALED = 16


@dataclass
class Pieces:
    """Pieces as bytes with natural-log weights, and tables that find a byte range's piece by its hash."""

    strings: list[bytes]
    weight: np.ndarray
    hashes: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)
    lengths: list[int] = field(init=False)

    def __post_init__(self) -> None:
        ends = np.cumsum([len(x) for x in self.strings])
        starts = ends - [len(x) for x in self.strings]
        self.hashes = Rolling(np.frombuffer(b"".join(self.strings), np.uint8)).of(starts, ends)
        self.lengths = sorted({len(x) for x in self.strings})
        self.first, self.second = (np.full(1 << _SLOT_BITS, -1, np.int32) for _ in range(2))
        top, low = self._slots(self.hashes)
        own = np.arange(len(top), dtype=np.int32)
        self.first[top] = own
        lost = own[self.first[top] != own]
        self.second[low[lost]] = lost
        if (self.find(self.hashes) != own).any():
            raise ValueError("two pieces share both slots")

    def __reduce__(self):
        return Pieces, (self.strings, self.weight)  # the tables are large and soon made

    @staticmethod
    def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), (h & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 for none."""
        top, low = self._slots(h)
        a, b = self.first[top], self.second[low]
        return np.where(self.hashes[a] == h, a, np.where(self.hashes[b] == h, b, -1)) if len(h) else a


def vocabulary(path: str) -> Pieces:
    """The pieces of a sentencepiece file without its control pieces; a byte's piece stands for that byte."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    strings, rank = [], []
    for i in range(file.get_piece_size()):
        if file.is_control(i) or file.is_unknown(i) or file.is_unused(i):
            continue
        piece = file.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if file.is_byte(i) else piece.encode()
        if raw.rfind(_START) > 0 or raw == _START * (len(raw) // 3) and len(raw) > 3:
            continue  # white space inside
        strings.append(raw)
        rank.append(file.get_piece_size() if file.is_byte(i) else 1 - file.get_score(i))
    known: dict[bytes, float] = {}
    for raw, r in zip(strings, rank, strict=True):
        known[raw] = known.get(raw, 0) + 1 / r
    weight = np.array([*known.values()])
    return Pieces([*known], np.log(weight / weight.sum()))


def _chunks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in order of length, in groups whose padded matrix stays small."""
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = at + 1
        step = max(1, _CELLS // (int(lengths[order[at]]) + 8))
        end = min(len(order), at + step)
        while end > at + 1 and (end - at) * (lengths[order[end - 1]] + 1) > 2 * _CELLS:
            end = at + (end - at) // 2
        yield order[at:end]
        at = end


def marginals(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural-log marginal probability of each word in the buffer, and the pieces' expected counts when the words
    occur so many times."""
    lengths = np.diff(offsets)
    short = np.flatnonzero(lengths <= LONG)
    out = np.zeros(len(lengths))
    expected = None if times is None else np.zeros(len(pieces.strings))
    out[short] = _together(pieces, data, offsets[:-1][short], lengths[short], None if times is None else times[short], expected)
    for i in np.flatnonzero(lengths > LONG):
        out[i] = _alone(pieces, data[offsets[i] : offsets[i + 1]], None if times is None else float(times[i]), expected)
    return out, expected


def _arcs(pieces: Pieces, letters: np.ndarray, low: int, high: int, by_start: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece of the arcs that end (or start) in low < place <= high (low <= place < high), in order."""
    far = pieces.lengths[-1]
    first, last = (low, min(len(letters), high + far)) if by_start else (max(0, low - far), high)
    rolling = Rolling(letters[first:last])
    found = [np.zeros((3, 0), np.int64)]
    for length in pieces.lengths:
        start = np.arange(low, min(high, last - length + 1)) if by_start else np.arange(max(low + 1, length), high + 1) - length
        piece = pieces.find(rolling.of(start - first, start - first + length))
        hit = piece >= 0
        found.append(np.stack([start[hit], start[hit] + length, piece[hit].astype(np.int64)]))
    start, end, piece = np.concatenate(found, axis=1)
    order = np.argsort(start if by_start else end, kind="stable")
    return start[order], end[order], piece[order]


def _recursion(pieces: Pieces, letters: np.ndarray, backward: bool) -> np.ndarray:
    """The natural log of each place's sum over the paths from the first place (or to the last), in time linear in the
    letters: the last places' sums are kept near 1, with what they were multiplied by in `shift`."""
    n, far = len(letters), pieces.lengths[-1]
    out, value, shift = np.full(n + 1, -np.inf), [0.0] * (n + 1), 0.0
    value[n if backward else 0] = 1.0
    out[n if backward else 0] = 0.0
    for turn in range(0, n, _PLACES):
        low, high = (max(0, n - turn - _PLACES), n - turn) if backward else (turn, min(n, turn + _PLACES))
        start, end, piece = _arcs(pieces, letters, low, high, backward)
        share = np.exp(pieces.weight[piece]).tolist()
        here, there = (start, end) if backward else (end, start)
        steps = range(high, low, -_SCALED) if backward else range(low, high, _SCALED)
        for step in steps:
            a, b = (max(low, step - _SCALED), step) if backward else (step + 1, min(high, step + _SCALED) + 1)  # places a <= place < b
            i, j = np.searchsorted(here, [a, b])
            arcs = zip(here[i:j].tolist(), there[i:j].tolist(), share[i:j], strict=True)
            for x, y, p in reversed([*arcs]) if backward else arcs:
                value[x] += value[y] * p
            with np.errstate(divide="ignore"):
                out[a:b] = np.log(value[a:b]) + shift
            near = range(a, min(n + 1, a + far + 1)) if backward else range(max(0, b - far - 1), b)
            most = max(value[x] for x in near)
            if 0 < most < 1e-30:
                for x in near:
                    value[x] /= most
                shift += float(np.log(most))
    return out


def _alone(pieces: Pieces, word: np.ndarray, times: float | None, expected: np.ndarray | None) -> float:
    """The marginal of one word of any length; adds to the expected counts if the word occurs `times` times."""
    letters = np.concatenate([np.frombuffer(_START, np.uint8), word])
    alpha = _recursion(pieces, letters, backward=False)
    total = float(alpha[-1])
    if expected is not None and times and np.isfinite(total):
        beta = _recursion(pieces, letters, backward=True)
        for low in range(0, len(letters), _PLACES):
            start, end, piece = _arcs(pieces, letters, low, min(len(letters), low + _PLACES), False)
            expected += np.bincount(piece, times * np.exp(alpha[start] + pieces.weight[piece] + beta[end] - total), len(expected))
    return total


def _together(pieces: Pieces, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, times: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
    """The marginals of many short words, place by place for all words of like length at once."""
    out = np.zeros(len(lengths))
    for rows in _chunks(lengths):
        size = lengths[rows]
        n, most = len(rows), int(size[-1]) + len(_START)
        letters = np.zeros((n, most), np.uint8)
        letters[:, : len(_START)] = np.frombuffer(_START, np.uint8)
        inner = np.arange(most - len(_START)) < size[:, None]
        letters[:, len(_START) :][inner] = gathered(data, starts[rows], size)
        whole = size + len(_START)
        rolling = Rolling(letters.ravel())
        base = np.arange(n) * most
        from_row = np.searchsorted(whole, np.arange(most + 1))  # rows are in order of length
        alpha = np.full((n, most + 1), -np.inf)
        alpha[:, 0] = 0
        arcs = []
        for end in range(1, most + 1):
            a = from_row[end]
            for length in pieces.lengths:
                start = end - length
                if start < 0:
                    break
                at = base[a:] + start
                piece = pieces.find(rolling.of(at, at + length))
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                piece, hit = piece[hit], hit + a
                alpha[hit, end] = np.logaddexp(alpha[hit, end], alpha[hit, start] + pieces.weight[piece])
                if times is not None:
                    arcs.append((start, end, hit, piece))
        total = alpha[np.arange(n), whole]
        out[rows] = total
        if times is not None:
            beta = np.full((n, most + 1), -np.inf)
            beta[np.arange(n), whole] = 0
            weight = np.log(times[rows]) - total
            for start, end, hit, piece in reversed(arcs):
                onward = pieces.weight[piece] + beta[hit, end]
                expected += np.bincount(piece, np.exp(alpha[hit, start] + onward + weight[hit]), len(expected))
                beta[hit, start] = np.logaddexp(beta[hit, start], onward)
    return out


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)


def word_counts(documents: DataFrame, train: Column) -> DataFrame:
    """word (binary), key (its hash), c: each word's occurrences in the texts that meet `train`, 0 if only others
    have it. The word of one space counts those texts: an end for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = np.asarray(batch.column("train"))
            for part in slices(batch.column("text")):
                data = lowered(part.data)
                starts, ends, count = words(data, part.offsets)
                use = learn[part.first : part.first + len(part)]
                keys, first, number = _distinct(data, starts, ends)
                c = np.bincount(number, np.repeat(use, count), len(keys)).astype(np.int64)
                size = ends[first] - starts[first]
                letters = gathered(data, starts[first], size)
                bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                made = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
                yield pa.record_batch([made, pa.array(keys.view(np.int64)), pa.array(c)], ["word", "key", "c"])
                yield pa.record_batch([pa.array([END], pa.binary()), pa.array([0], pa.int64()), pa.array([int(use.sum())])], ["word", "key", "c"])

    rows = texts(documents, train.alias("train")).select("text", "train").mapInArrow(run, "word binary, key long, c long")
    return rows.groupBy("word", "key").agg(F.sum("c").alias("c"))


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    part = next(slices(column, 1 << 62), None)
    return (part.data, part.offsets) if part is not None else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def expected_counts(counts: DataFrame, pieces: Pieces) -> np.ndarray:
    """The pieces' expected counts over all training words; a sum for each task, then one for each piece."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.strings))
        for batch in batches:
            total += marginals(shared.value, *_buffer(batch.column("word")), np.asarray(batch.column("c"), np.float64))[1]
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some])], ["piece", "times"])

    found = counts.where((F.col("c") > 0) & (F.col("word") != END)).select("word", "c").mapInArrow(run, "piece long, times double")
    rows = found.groupBy("piece").agg(F.sum("times").alias("times")).toPandas()  # no more than the vocabulary has
    out = np.zeros(len(pieces.strings))
    out[rows["piece"]] = rows["times"]
    return out


def trained(counts: DataFrame, pieces: Pieces, n_texts: int, rounds: int = ROUNDS) -> tuple[Pieces, float]:
    """Pieces re-estimated from the counts, and the natural-log probability of an end."""
    for _ in range(rounds):
        times = expected_counts(counts, pieces) + SMOOTH
        total = times.sum() + n_texts + SMOOTH
        pieces = Pieces(pieces.strings, np.log(times / total))
    share = (n_texts + SMOOTH) / total if rounds else 1 / 32
    return pieces, float(np.log(share))


def lm_scores(documents: DataFrame, vocabulary_file: str, *, train: Column, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens (words and one end), n_known (seen in training), train_tokens, base_score (log10, add-one
    word unigram) and score (log10 lattice marginal) of every row; texts that meet `train` teach both.

    Null and empty texts are one end. Rows that repeat a doc_id are scored each by itself. With no training
    texts every token is unknown and the pieces keep the weights of the vocabulary."""
    spark = documents.sparkSession
    counts = written(word_counts(documents, train), "word-counts")
    known = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v, n_texts = known["n"], known["v"], known["ends"]
    pieces, end = trained(counts, vocabulary(vocabulary_file), n_texts, rounds if n else 0)
    shared = spark.sparkContext.broadcast(pieces)

    def with_marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = marginals(shared.value, *_buffer(batch.column("word")))[0] / np.log(10)
            yield pa.record_batch([batch.column("key"), batch.column("c"), pa.array(score)], ["key", "c", "marginal"])

    table = written(counts.where(F.col("word") != END).mapInArrow(with_marginal, "key long, c long, marginal double"), "word-marginals")
    often = table.where((F.col("c") > 0) & (F.col("c") >= n / hot)).toPandas().sort_values("key", ignore_index=True)  # at most `hot` rows
    common = spark.sparkContext.broadcast((often["key"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63), often["c"].to_numpy(), often["marginal"].to_numpy()))
    log_total = float(np.log10(n + v + 1))
    end_base, end_score = float(np.log10(n_texts + 1)) - log_total, end / np.log(10)
    names = ["uid", "doc_id", "key", "times", "tokens", "known", "base", "score"]
    form = "uid long, doc_id long, key long, times long, tokens long, known long, base double, score double"

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c_of, score_of = common.value
        base_of = np.log10(c_of + 1) - log_total
        for batch in batches:
            for part in slices(batch.column("text")):
                uid = np.asarray(batch.column("uid").slice(part.first, len(part)))
                doc_id = batch.column("doc_id").slice(part.first, len(part))
                data = lowered(part.data)
                starts, ends, count = words(data, part.offsets)
                own, _, number = _distinct(data, starts, ends)
                signed = own ^ np.uint64(1 << 63)  # in the order of signed keys
                at = np.minimum(np.searchsorted(keys, signed), max(len(keys) - 1, 0))
                hit = keys[at] == signed if len(keys) else np.zeros(len(own), bool)
                pick = lambda values: np.where(hit, values[at], 0) if len(keys) else np.zeros(len(own))
                zero = np.zeros(len(part))
                yield pa.record_batch([
                    pa.array(uid), doc_id, pa.array(uid * 0x9E3779B1 + 1), pa.array(zero.astype(np.int64)), pa.array(count + 1),
                    pa.array(sums_by_row(hit[number].astype(np.int64), count) + int(n_texts > 0)),
                    pa.array(sums_by_row(pick(base_of)[number], count) + end_base), pa.array(sums_by_row(pick(score_of)[number], count) + end_score),
                ], names)
                row = np.repeat(np.arange(len(part)), count)
                rare = ~hit[number]
                pair, times = np.unique(row[rare] * len(own) + number[rare], return_counts=True)
                if len(pair):
                    of, word = pair // len(own), pair % len(own)
                    none, nil = pa.array(np.zeros(len(pair), np.int64)), pa.array(np.zeros(len(pair)))
                    yield pa.record_batch([pa.array(uid[of]), doc_id.take(pa.array(of)), pa.array(own[word].view(np.int64)), pa.array(times), none, none, nil, nil], names)

    rows = texts(documents).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(by_text, form)
    seen = F.coalesce("c", F.lit(0))
    met = rows.join(table, "key", "left").select(
        "uid", "doc_id", "tokens",
        (F.col("known") + F.when(seen > 0, F.col("times")).otherwise(0)).alias("known"),
        F.when(F.col("times") > 0, F.col("times") * (F.log10(seen + 1) - log_total)).otherwise(F.col("base")).alias("base"),
        F.when(F.col("times") > 0, F.col("times") * F.col("marginal")).otherwise(F.col("score")).alias("score"),
    )
    sums = met.groupBy("uid", "doc_id").agg(*(F.sum(x).alias(x) for x in ("tokens", "known", "base", "score")))
    return sums.select("doc_id", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-unigram and lattice scores of every text of documents."""
    import public_tokenizers

    held = held_out(7, 2)
    scores = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), train=~held)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
