"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy, so that unseen
misspellings share character n-gram vectors.

A word's vector is the mean of the vectors of itself and of its 3- to 5-character n-grams (with word ends
marked), hashed into a fixed number of rows; a text's vector is the mean of its words'. The model is fitted on
a bounded sample of labelled texts. As everything after the embedding is linear, a scorer needs one number for
each hashed row, and texts are scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.quality import labelled
from tapeline.llm.shared import Rolling, Slice, gathered, hashed, held_out, letter_words, lowered, release, released, slices, sums_by_row, texts, written

#: About so many labelled texts fit the model, a third of them of the rarer label where there are enough.
TRAIN_ROWS = 6_000
#: Bytes of all texts of the sample, and of one: longer ones are not in it.
TRAIN_BYTES, TRAIN_TEXT = 32 << 20, 1 << 20
BUCKET_BITS = 17
DIMENSIONS = 4
_CHUNK = 1 << 15
GRAMS = (3, 4, 5)
_MARK = np.frombuffer(b"<>", np.uint8)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words in one buffer: the hashed rows of each word's subwords, one word after the other, and how many it has."""
    n = len(offsets) - 1
    lengths = np.diff(offsets) + 2
    ends = np.cumsum(lengths)
    marked = np.empty(int(lengths.sum()), np.uint8)
    inner = np.ones(len(marked), bool)
    inner[ends - 1] = inner[ends - lengths] = False
    marked[inner] = data
    marked[ends - lengths], marked[ends - 1] = _MARK
    begins = np.flatnonzero((marked & 0xC0) != 0x80)
    of_word = np.searchsorted(ends, begins, side="right")
    edges = np.concatenate([begins, [len(marked)]])
    rolling = Rolling(marked)
    hashes, owners = [rolling.of(ends - lengths, ends)], [np.arange(n)]
    for size in GRAMS:
        if len(begins) >= size:
            same = of_word[: len(begins) - size + 1] == of_word[size - 1 :]
            at = np.flatnonzero(same)
            hashes.append(rolling.of(edges[at], edges[at + size]))
            owners.append(of_word[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    rows = (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return rows[order], np.bincount(owner, minlength=n)


@dataclass
class Scorer:
    """What a fitted model comes to: a bias, and for each hashed row its share in the log-odds of label 1."""

    bias: float
    row: np.ndarray

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, buffer, lengths, number, count = _bag(Slice(0, data, offsets))
        if not len(lengths):
            return np.full(len(count), 1 / (1 + np.exp(-self.bias)))
        rows, many = subwords(buffer, np.concatenate([[0], np.cumsum(lengths)]))
        word = sums_by_row(self.row[rows].astype(np.float64), many) / many
        odds = self.bias + sums_by_row(word[number], count) / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _bag(part: Slice) -> tuple[np.ndarray, ...]:
    """Of a slice of texts: the hashes, letters and lengths of the distinct words, each word's number among them, and
    how many words each text has."""
    data = lowered(part.data)
    starts, ends, count = letter_words(data, part.offsets)
    hashes, first, number = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
    lengths = ends[first] - starts[first]
    return hashes, gathered(data, starts[first], lengths), lengths, number.astype(np.int32), count


def _begins(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _summed(table: np.ndarray, rows: np.ndarray, begins: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of table[k][rows], times weight, over segments, none of them empty, for each k."""
    out = np.empty((len(table), len(begins)), table.dtype)
    for k, values in enumerate(table):
        values = values[rows]
        np.add.reduceat(values if weight is None else values * weight, begins, out=out[k])
    return out


def fit(many: list[str], y: np.ndarray, weight: np.ndarray, *, steps: int = 100, rate: float = 1.0, power: float = 0.25, seed: int = 7) -> Scorer:
    """Embeddings and softmax trained together on all texts in each step. No texts score 0.5.

    A step is a momentum step whose size adapts to each parameter's past gradients, but only by their power of
    a quarter relative to the table's mean: subwords that many texts share stay ahead of those of a single one."""
    table = 1 << BUCKET_BITS
    parts = [_bag(part) for part in slices(pa.array(many, pa.large_string()))]
    count = np.concatenate([np.zeros(0, np.int64), *(c for *_, c in parts)])
    if not count.any() or y.min() == y.max():
        mean = (y.sum() + 0.5) / (len(y) + 1)
        return Scorer(float(np.log(mean / (1 - mean))), np.zeros(table, np.float32))
    hashes, letters, lengths = (np.concatenate([part[k] for part in parts]) for k in range(3))
    _, first, number_of = np.unique(hashes, return_index=True, return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(lengths[first])])
    buffer = gathered(letters, (np.cumsum(lengths) - lengths)[first], lengths[first])
    del hashes, letters, lengths
    cuts = [*range(0, len(bounds) - 1, _CHUNK), len(bounds) - 1]
    place, grams = [], []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        rows, many_rows = subwords(buffer[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        place.append(rows.astype(np.int32))
        grams.append(many_rows)
    place, grams = np.concatenate(place), np.concatenate(grams)
    seen = np.bincount(place, minlength=table) > 0
    used = np.flatnonzero(seen)
    place = (np.cumsum(seen, dtype=np.int32) - 1)[place]
    of_words = _begins(grams)
    by_row = np.argsort(place, kind="stable").astype(np.int32)
    of_uses = _begins(np.bincount(place))
    word_of = np.repeat(np.arange(len(grams), dtype=np.int32), grams)[by_row]
    del by_row, buffer
    pairs, before, texts_before = [], 0, 0
    for own, _, _, number, many_words in parts:
        row = np.repeat(np.arange(len(many_words)) + texts_before, many_words)
        pair, times = np.unique(row * len(grams) + number_of[before + number], return_counts=True)
        pairs.append(((pair // len(grams)).astype(np.int32), (pair % len(grams)).astype(np.int32), times.astype(np.int32)))
        before, texts_before = before + len(own), texts_before + len(many_words)
    del parts, number_of
    pair_doc, pair_word, times = (np.concatenate(x) for x in zip(*pairs, strict=True))
    share = (times / count[pair_doc]).astype(np.float32)
    by_word = np.argsort(pair_word, kind="stable")
    of_pairs = _begins(np.bincount(pair_word))
    filled = np.unique(pair_doc)
    of_texts = np.searchsorted(pair_doc, filled)
    per_word = (1 / grams).astype(np.float32)
    share_by_word, doc_by_word = share[by_word], pair_doc[by_word]
    del pairs, times, by_word
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.01, (DIMENSIONS, len(used))).astype(np.float32), rng.normal(0, 1, (2, DIMENSIONS)).astype(np.float32), np.zeros((2, 1), np.float32)]
    momentum, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    weight = (weight / weight.sum()).astype(np.float32)
    for step in range(1, steps + 1):
        e, w, b = parts
        word = _summed(e, place, of_words) * per_word
        text = np.zeros((DIMENSIONS, len(many)), np.float32)
        text[:, filled] = _summed(word, pair_word, of_texts, share)
        odds = w @ text + b
        p = np.exp(odds - odds.max(0))
        p /= p.sum(0)
        p[y, np.arange(len(y))] -= 1
        d_odds = p * weight
        d_word = _summed(w.T @ d_odds, doc_by_word, of_pairs, share_by_word) * per_word
        for k, g in enumerate((_summed(d_word, word_of, of_uses), d_odds @ text.T, d_odds.sum(1, keepdims=True))):
            momentum[k] += 0.1 * (g - momentum[k])
            square[k] += 0.02 * (g * g - square[k])
            size = square[k] / (1 - 0.98**step)
            scale = float(size.mean()) ** (0.5 - power) * size**power
            parts[k] = parts[k] - rate * (momentum[k] / (1 - 0.9**step)) / (scale + 1e-12)
    e, w, b = parts
    row = np.zeros(table, np.float32)
    row[used] = (w[1] - w[0]) @ e
    return Scorer(float(b[1, 0] - b[0, 0]), row)


def _sample(documents: DataFrame, labels: DataFrame, train: Column, train_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, label of the labelled texts that a model is fitted on, and how many rows each label has in all."""
    known = labels.where(train)
    total = {r["toxic"]: r["count"] for r in known.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    rare = min(total, key=lambda k: (total[k], k), default=1)
    most = {rare: train_rows // 3, 1 - rare: train_rows - train_rows // 3}
    short = texts(documents).where(F.octet_length("text") <= TRAIN_TEXT)
    found = [labelled(short, known.where(F.col("toxic") == k), "toxic", F.lit(True), most[k]) for k in (0, 1)]
    one = F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("x")
    rows = written(found[0].unionByName(found[1]).groupBy("doc_id").agg(one).select("doc_id", "x.*", hashed("doc_id").alias("place")), "toxicity-sample")
    sizes = rows.select("place", F.octet_length("text").alias("bytes")).toPandas().sort_values("place")  # about train_rows numbers
    last = sizes["place"][sizes["bytes"].cumsum() <= TRAIN_BYTES].max()
    return rows.where(F.col("place") <= (int(last) if len(sizes) else 0)).select("doc_id", "text", "label"), total


def _weights(y: np.ndarray, total: dict[int, int]) -> np.ndarray:
    return np.array([total.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])[y] if len(y) else np.zeros(0)


def toxicity_model(documents: DataFrame, labels: DataFrame, *, train: Column, train_rows: int = TRAIN_ROWS) -> Scorer:
    """A scorer fitted on about train_rows labelled texts that meet the condition `train`, chosen by a hash of
    doc_id for each label; their weights restore the labels' shares.

    Of several texts of a doc_id one is taken, whichever rows there are, texts above TRAIN_TEXT bytes are not, and
    of the others those of smallest hash that TRAIN_BYTES hold, so that the part of whoever fits has a bound in bytes:
    the driver here, a task in toxicity_scorer()."""
    rows, total = _sample(documents, labels, train, train_rows)
    sample = rows.toPandas().sort_values("doc_id", ignore_index=True)
    y = sample["label"].to_numpy(np.int64)
    return fit(sample.pop("text").tolist(), y, _weights(y, total))


def toxicity_scorer(documents: DataFrame, labels: DataFrame, *, train: Column, train_rows: int = TRAIN_ROWS) -> Scorer:
    """The scorer of toxicity_model(), fitted in a task: the driver gets a number for each hashed row, and no text."""
    rows, total = _sample(documents, labels, train, train_rows)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            sample = pa.Table.from_batches(held).sort_by("doc_id")
            y = sample.column("label").to_numpy().astype(np.int64)
            scorer = fit(sample.column("text").to_pylist(), y, _weights(y, total))
            yield pa.record_batch([pa.array([scorer.bias]), pa.array([scorer.row.tobytes()])], ["bias", "row"])

    made = rows.coalesce(1).mapInArrow(released(fitted), "bias double, row binary").first()
    return Scorer(made["bias"], np.frombuffer(made["row"], np.float32)) if made else fit([], np.zeros(0, np.int64), np.zeros(0))


def toxicity_of(spark: SparkSession, scorer: Scorer, text: Column) -> Column:
    """The probability of label 1 of a text column; null and empty texts get the bias alone. Only the text goes to
    Python; a row's other columns stay in the JVM."""
    shared = spark.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        parts = [shared.value.probability(part.data, part.offsets) for part in slices(column)]
        release()
        return pa.array(np.concatenate([*parts, np.zeros(0)]))

    return probability(F.coalesce(text, F.lit("")))


def with_toxicity(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of documents with `toxicity`, the probability of label 1. A column of that name is an error."""
    if "toxicity" in documents.columns:
        raise ValueError("a column toxicity is already there")
    return documents.withColumn("toxicity", toxicity_of(documents.sparkSession, scorer, F.col("text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text of documents."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = with_toxicity(documents.select("doc_id", "text"), toxicity_scorer(documents, labels, train=~held_out(5, 0)))
    return scores.select("doc_id", held_out(5, 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
