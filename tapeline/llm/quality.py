"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for
vectorised numpy traversal.

One pass over the texts makes a narrow table of statistics in the shared folder. The trees are fitted on a
sample of labelled rows, bounded by TRAIN_ROWS, and then score the narrow table; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.shared import Rolling, hashed, held_out, lowered, share_kept, slices, sums_by_row, texts, words, written

#: About so many labelled rows, chosen by a hash of doc_id, fit the trees.
TRAIN_ROWS = 40_000
STATISTICS = [
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "punctuation", "symbols", "bars", "bangs", "non_ascii",
    "lines_a_word", "line_length", "longest_word", "distinct_words", "distinct_pairs", "distinct_lines", "short_words", "long_words", "top_word", "letter_words", "ends_in_stop",
]


def _kinds() -> dict[str, np.ndarray]:
    table = {k: np.zeros(256, bool) for k in ("letters", "upper", "digits", "punctuation", "symbols", "bars", "bangs", "non_ascii", "stops")}
    table["letters"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    table["upper"][65:91] = True
    table["digits"][48:58] = True
    table["punctuation"][[*b".,;:'\"()-"]] = True
    table["symbols"][[*b"#$%&*@^~<>{}[]\\/_=+"]] = True
    table["bars"][[*b"|"]] = True
    table["bangs"][[*b"!?"]] = True
    table["non_ascii"][128:] = True
    table["stops"][[*b".!?:"]] = True
    return table


_KINDS = _kinds()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; shares of nothing are 0."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    share = lambda a, b: a / np.maximum(b, 1)
    out = dict.fromkeys(STATISTICS)
    for k in ("letters", "upper", "digits", "punctuation", "symbols", "bars", "bangs", "non_ascii"):
        out[k] = share(sums_by_row(_KINDS[k][data], size), size)
    starts, ends, count = words(data, offsets)
    length = ends - starts
    small = lowered(data)
    hashes = Rolling(small).of(starts, ends)
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(count)
    out["word_length"] = share(sums_by_row(length, count), count)
    out["short_words"] = share(sums_by_row(length <= 3, count), count)
    out["long_words"] = share(sums_by_row(length >= 13, count), count)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    out["ends_in_stop"] = share(sums_by_row(_KINDS["stops"][last], count), count)
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    out["letter_words"] = share(sums_by_row(_KINDS["letters"][first] & _KINDS["letters"][last], count), count)
    bound = np.concatenate([[0], np.cumsum(count)])
    breaks = np.flatnonzero(data == 10)
    lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    out["lines_a_word"], out["line_length"] = share(lines - 1, count), np.log1p(size / lines)
    rolling = Rolling(data)
    each = np.zeros((n, 5))
    line_at = np.searchsorted(breaks, offsets)
    for i in range(n):
        h, k = hashes[bound[i] : bound[i + 1]], count[i]
        if k:
            _, times = np.unique(h, return_counts=True)
            pairs = h[1:] * np.uint64(3) + h[:-1]
            each[i, :4] = length[bound[i] : bound[i + 1]].max(), len(times) / k, len(np.unique(pairs)) / max(k - 1, 1), times.max() / k
        cut = breaks[line_at[i] : line_at[i + 1]]
        line_starts, line_ends = np.concatenate([[offsets[i]], cut + 1]), np.concatenate([cut, [offsets[i + 1]]])
        each[i, 4] = len(np.unique(rolling.of(line_starts, line_ends))) / len(line_starts)
    out["longest_word"], out["distinct_words"], out["distinct_pairs"], out["top_word"], out["distinct_lines"] = np.log1p(each[:, 0]), *each[:, 1:].T
    return np.stack([np.asarray(out[k], np.float32) for k in STATISTICS], 1)


def with_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and `statistics`, an array of floats in the order of STATISTICS. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                made = statistics(part.data, part.offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(made.ravel()))
                yield pa.record_batch([batch.column("doc_id").slice(part.first, len(part)), lists], ["doc_id", "statistics"])

    return texts(documents).mapInArrow(run, "doc_id long, statistics array<float>")


@dataclass
class Trees:
    """Complete binary trees in flat arrays: node i of a tree has the children 2i + 1 and 2i + 2; a row goes
    right where its value is above the node's threshold. leaves holds the last level's log-odds."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaves: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaves in zip(self.feature, self.threshold, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            odds += leaves[node - (len(leaves) - 1)]
        return 1 / (1 + np.exp(-odds))


def fit_trees(x: np.ndarray, y: np.ndarray, *, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 2.0, least: int = 10) -> Trees:
    """Boosted trees for 0/1 labels under logistic loss, with splits from per-node gradient histograms.

    No rows give a score of 0.5 and one label everywhere a score near that label. Ties between splits go to
    the first feature and the lowest bin, so that equal rows give equal trees."""
    nodes, ends = (1 << depth) - 1, 1 << depth
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    trees = Trees(base, depth, np.zeros((0, nodes), np.int64), np.zeros((0, nodes), np.float32), np.zeros((0, ends)))
    if not len(y) or y.min() == y.max():
        return trees
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    odds, made = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf, np.float32)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            slot = (node - first) * bins
            best, where = np.zeros(wide), [(0, -1)] * wide
            for j in range(x.shape[1]):
                key = slot + binned[:, j]
                sums = [np.cumsum(np.bincount(key, w, wide * bins).reshape(wide, bins), 1) for w in (g, h, None)]
                (gl, hl, nl), (ga, ha, na) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
                gain[(nl < least) | (na - nl < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(wide), top] > best + 1e-9):
                    best[k], where[k] = gain[k, top[k]], (j, top[k])
            for k, (j, b) in enumerate(where):
                if b >= 0:
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            chosen = feature[node]
            right = x[np.arange(len(y)), chosen] > threshold[node]
            node = 2 * node + 1 + right
        leaf = node - nodes
        value = rate * np.bincount(leaf, g, ends) / (np.bincount(leaf, h, ends) + smooth)
        odds += value[leaf]
        made.append((feature, threshold, value))
    return Trees(base, depth, *(np.stack([m[k] for m in made]) for k in range(3)))


def labelled(rows: DataFrame, labels: DataFrame, label: str, condition: Column, most: int) -> DataFrame:
    """The rows that have a label, under the condition, with it as `label`; about `most`, chosen by a hash of doc_id.

    Several labels of one doc_id count as 1 if their mean is at least a half; null labels don't count."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(condition)
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    bound = share_kept(known.count(), most)
    return rows.join(F.broadcast(known.where(hashed("doc_id") < bound)), "doc_id")  # about `most` rows


def quality_scores(documents: DataFrame, labels: DataFrame, *, train: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and score, the probability of label 1, of every row; the labels under the condition `train` teach it."""
    table = written(with_statistics(documents), "quality-statistics")
    found = labelled(table, labels, "quality", train, train_rows).select("statistics", "label").toPandas()
    x = np.stack(found["statistics"]).astype(np.float32) if len(found) else np.zeros((0, len(STATISTICS)), np.float32)
    order = np.lexsort(x.T) if len(found) else slice(0)
    trees = fit_trees(x[order], found["label"].to_numpy(np.float64)[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("statistics").flatten()).reshape(-1, len(STATISTICS))
            yield pa.record_batch([batch.column("doc_id"), pa.array(trees.probability(x))], ["doc_id", "score"])

    return table.mapInArrow(run, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every text of documents."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_scores(documents, labels, train=~held_out(5, 0))
    return scores.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
