"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form of each.

Words within one edit at position i share what is before i and what is after it. In a block of words, that is a
rectangle: an interval of the forward order by the prefix, and one of the reverse order by the suffix. A wavelet
tree over the block's points reports what is inside, so every reported point is a near word or the word itself.

A block holds the words that agree on a prefix of `a` and a suffix of `size - b` code points and looks for edits
at positions a to b - 1. Words first stand in the two halves of their positions; a block above MOST words is
halved again, until the positions are one, when no more words fit into it than letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.shared import written
from tapeline.llm.wavelet import WaveletTree

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of a block that one tree takes.
MOST = 50_000
#: Words, and bytes of them, that a task holds at once besides the last block.
CHUNK_ROWS, CHUNK_BYTES = 100_000, 4 << 20
#: Bytes of words that a task counts before it passes them on.
COUNTED_BYTES = 48 << 20
STRETCH = 1 << 20

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_NO_LETTER = re.compile("[^a-zÀ-ÿ]")


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about a million code points, cut between runs."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            gap = _NO_LETTER.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def word_counts(documents: DataFrame, modulus: int = 97, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: runs of letters in whole texts, A-Z in lower case, of `least_length` code points or more.

    Where `modulus` divides the crc32 h of `<doc_id>:<run>`, the run has lost its code point h % length. A null
    doc_id counts as an empty one, a null text has no runs. Tasks count their own rows before words are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        held = 0

        def flushed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in stretches(text.as_buffer().to_pybytes().lower().decode()):
                    for word, n in Counter(_RUN.findall(part)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % modulus == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        if word not in total:
                            held += len(word) + 100
                        total[word] += n
                    if held > COUNTED_BYTES:
                        yield flushed()
                        total.clear()
                        held = 0
        if total:
            yield flushed()

    return documents.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(words: DataFrame, ranges) -> DataFrame:
    """word, n, kind, size, a, b and the block's hash for each struct (kind, size, a, b) of the array `ranges`."""
    rows = words.select("word", "n", F.inline(ranges))
    key = F.xxhash64("kind", "size", "a", "b", F.expr("substring(word, 1, a)"), F.expr("right(word, size - b)"))
    return rows.withColumn("block", key)


def _halves(kind: int, size):
    middle = F.floor(size / 2).cast("int")
    return [F.struct(F.lit(kind).alias("kind"), size.cast("int").alias("size"), a.cast("int").alias("a"), b.cast("int").alias("b")) for a, b in ((F.lit(0), middle), (middle, size))]


def blocks(words: DataFrame, most: int = MOST) -> DataFrame:
    """The words in blocks of `most` or fewer, those of one position excepted, as a table of the shared folder.

    kind 0 is for replacements among words of `size` code points, kind 1 for insertions into words of size - 1.
    Blocks are told apart by 64 bits: two with equal ones share a tree, whose intervals still keep them apart."""
    length = F.length("word")
    rows = written(_blocks(words, F.array(*_halves(0, length), *_halves(1, length), *_halves(1, length + 1))), "spelling-blocks")
    done = []
    while True:
        large = rows.groupBy("block").agg(F.count(F.lit(1)).alias("many"), F.max(F.col("b") - F.col("a")).alias("wide")).where((F.col("many") > most) & (F.col("wide") > 1)).select("block")
        large = written(large, "spelling-large")
        if large.isEmpty():
            for other in done:
                rows = other.union(rows)
            return rows
        done.append(rows.join(large, "block", "left_anti").select(rows.columns))
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        parts = F.array(*(F.struct("kind", "size", x.alias("a"), y.alias("b")) for x, y in ((F.col("a"), middle), (middle, F.col("b")))))
        again = rows.join(large, "block", "left_semi").select("word", "n", parts.alias("parts"))
        rows = written(_blocks(again, F.col("parts")).where("a < b"), "spelling-blocks")


class _Order:
    """Rows sorted by block and letters; intervals of those that share a block and their first letters."""

    def __init__(self, block: np.ndarray, letters: np.ndarray) -> None:
        n, size = letters.shape
        self.order = np.lexsort((np.ascontiguousarray(letters).view(f"S{size}")[:, 0], block))
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        rows, blocks = letters[self.order], block[self.order]
        other = rows[1:] != rows[:-1]
        same = np.where(other.any(1), other.argmax(1), size)
        same[blocks[1:] != blocks[:-1]] = -1
        self.same = np.concatenate([[-1], same])

    def interval(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(self.same < length)
        k = np.searchsorted(starts, places, side="right")
        return starts[k - 1], np.append(starts, len(self.same))[k]


def near_pairs(letters: np.ndarray, lengths: np.ndarray, kind: int, size: int, block: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers (of a word, of a word near to it), each pair in both directions once.

    letters are rows of Latin-1 bytes padded with zeros. An insertion next to an equal letter has several positions:
    the first one counts."""
    backwards = np.zeros_like(letters)
    for n in np.unique(lengths):
        own = lengths == n
        backwards[own, :n] = letters[own, :n][:, ::-1]
    forward, reverse = _Order(block, letters), _Order(block, backwards)
    tree = WaveletTree(reverse.place[forward.order])
    asking = lengths == size - kind
    found = [(np.zeros(0, np.int64),) * 2]
    for i in range(int(a.min()), int(b.max())):
        rows = np.flatnonzero(asking & (a <= i) & (i < b))
        left, right = forward.interval(forward.place[rows], i)
        low, high = reverse.interval(reverse.place[rows], size - 1 - i)
        many = (right - left > 1) & (high - low > 1)
        rows, left, right, low, high = (x[many] for x in (rows, left, right, low, high))
        query, value = tree.report(left, right, low, high)
        one, two = rows[query], reverse.order[value]
        if kind == 0:
            found.append((one[one != two], two[one != two]))
        else:
            keep = lengths[two] == size
            if i:
                keep &= letters[two, i - 1] != letters[two, i]
            one, two = one[keep], two[keep]
            found += [(one, two), (two, one)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _nearest(words: list[str], n: np.ndarray, kind: int, size: int, block: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For each word of one kind and size with near words, their number and the one of largest n."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.array([w.encode("latin-1") for w in words], f"S{size}").view(np.uint8).reshape(len(words), size)
    one, two = near_pairs(letters, lengths, kind, size, block, a, b)
    alphabetic = np.empty(len(words), np.int64)
    alphabetic[np.argsort(letters.view(f"S{size}")[:, 0], kind="stable")] = np.arange(len(words))
    order = np.lexsort((alphabetic[two], -n[two], one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.diff(one, prepend=-1))
    many = np.diff(np.append(first, len(one)))
    texts = np.array(words, object)
    return pa.record_batch([pa.array(texts[one[first]], pa.string()), pa.array(many, pa.int64()), pa.array(texts[two[first]], pa.string()), pa.array(n[two[first]])], ["word", "n_near", "near", "near_n"])


def nearest(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, n_near and, null without near words, near and near_n: the near word of largest n, of several the
    smallest in code-point order. `words` has each word once, of letters of Latin-1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = None, 0
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            held += batch.column("word").nbytes
            if len(rest) > CHUNK_ROWS or held > CHUNK_BYTES:
                block = rest.column("block").to_numpy()
                cut = int(np.flatnonzero(block == block[-1])[0])
                if cut:
                    yield from trees(rest.slice(0, cut))
                    rest, held = rest.slice(cut), rest.slice(cut).column("word").nbytes
        if rest is not None:
            yield from trees(rest)

    def trees(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block = rows.column("block").to_numpy()
        _, which, many = np.unique(block, return_inverse=True, return_counts=True)
        rows = rows.filter(pa.array(many[which] > 1))
        kinds = rows.column("kind").to_numpy().astype(np.int64) << 32 | rows.column("size").to_numpy()
        for k in np.unique(kinds):
            own = rows.filter(pa.array(kinds == k))
            n, block, a, b = (own.column(c).to_numpy() for c in ("n", "block", "a", "b"))
            out = _nearest(own.column("word").to_pylist(), n, int(k >> 32), int(k & 0xFFFFFFFF), block, a, b)
            if len(out):
                yield out

    dealt = blocks(words, most).repartition("block").sortWithinPartitions("kind", "size", "block")
    found = dealt.mapInArrow(run, "word string, n_near long, near string, near_n long")
    best = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    both = both.union(found.select("word", F.lit(None).cast("long"), "n_near", "near", "near_n"))
    whole = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
    return whole.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """All columns of (word, form, ...) and `root`, the end of the chain of forms from the word; the word itself
    where its form is null. Chains must not be cycles. Each round halves them, in the shared folder."""
    links = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not links.where("moved").isEmpty():
        upper = links.select(F.col("word").alias("root"), F.col("root").alias("above"))
        links = written(links.join(upper, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-roots")
    return forms.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_forms(words: DataFrame, factor: int = 2, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n: the form of a word is its near word of largest n if that is `factor`
    times its own or more, else null; with a factor above 1 counts rise along a chain of forms, so that it ends."""
    near = nearest(words, most)
    common = F.col("near_n") >= factor * F.col("n")
    forms = near.select("word", F.when(common, F.col("near")).alias("form"), "n", "n_near", F.when(common, F.col("near_n")).alias("form_n"))
    return with_roots(written(forms, "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms. Null, empty and letterless texts add none, equal rows count each
    time, other columns stay unread, no documents give no rows; a text or a run of any length is taken whole."""
    counts = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spelling_forms(written(counts.where(F.col("n") >= LEAST_COUNT), "spelling-words"))
