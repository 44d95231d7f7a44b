"""N-gram Jaccard join with signature trees: nodes hold OR-combined token bitmaps and size ranges, and a dual
traversal prunes node pairs by their maximum possible overlap.

All documents can't stand under one tree. Any two sets of a Jaccard similarity t or more share a token among the
first |x| - ceil(t |x|) + 1 of each in any common order of tokens, and their sizes differ by 1 / t at most, so that
documents meet in blocks, one for each such token and size class, and every block of two or more sets is a tree.
Bitmaps are as wide as a class's sizes ask for; a set just above a class's sizes is a guest in it with its bitmap
folded. The order of tokens is by hash, with the most frequent ones last (a list of bounded size) and before them
those that more than HEAVY sets have among their first by hash (a bitmap of bounded size), so that a passage common
to many documents makes no block. Equal sets are one row throughout. All pairs come from the trees:

1. A tree's sets stand in order of size, FANOUT to a node. Each set is paired with the first set of its node, and
   that with the first of the node above; of a set's pairs that pass the bitmap bound, the one of most blocks is
   verified on the whole sets. The links make first components.
2. In blocks of more than HEAVY sets that still hold several components, trees in an order of hashes, whose nodes mix
   components, give the pairs of each node's children, by the first set of each, on every level: some eight for a set
   in all. These are verified, so that a large group of near copies comes to one component without all its pairs.
3. Blocks that still hold several components are traversed from their roots. A pair of nodes goes on unless all
   below has one component, or sizes or bitmaps leave no link possible, and every pair of sets across components
   that is left is verified. Nothing is left out: pairs within a component need no more links.

Tables of rows, blocks, links and labels stay in the shared folder; nothing of them goes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.bitmap import Bitmap, bitmap
from tapeline.llm.components import components
from tapeline.llm.shared import Rolling, lowered, mixed, released, slices, texts, words, written

WORDS = 5
PERCENT = 80
#: Tokens in more than one of RARE documents come last in the order.
RARE = 1_000
#: Tokens in the prefixes of more sets come after the others; larger blocks are linked within nodes first.
HEAVY = 16
#: Bits of a bitmap as powers of two: at least, at most; four times the largest size of a class in between.
SIGNATURE_BITS = (8, 13)
FANOUT = 16
#: Blocks of more than LIGHT sets are linked within nodes first, in so many turns of other orders.
LIGHT, TURNS = 4, 2
_STEPS = [pow(0xA24BAED4963EE407, k, 1 << 64) for k in range(1, 64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct word shingles as ascending 64-bit hashes, one row after the other, and how many it has.
    A row of fewer words has its whole sequence as one; a row without words has none."""
    data = lowered(data)
    starts, ends, count = words(data, offsets)
    word = Rolling(data).of(starts, ends)
    bound = np.concatenate([[0], np.cumsum(count)])
    grams = np.zeros(max(len(word) - size + 1, 0), np.uint64)
    for k in range(size):
        grams += word[k : k + len(grams)] * np.uint64(_STEPS[k])
    grams = mixed(grams)
    out, sizes = [], np.zeros(len(count), np.int64)
    for i, k in enumerate(count.tolist()):
        a = bound[i]
        if k >= size:
            own = np.sort(grams[a : a + k - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif k:
            own = mixed((word[a : a + k] * np.array(_STEPS[size : size + k], np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(k))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate([*out, np.zeros(0, np.uint64)]), sizes


def _step(percent: int) -> int:
    """Bits between size classes: the ratio of two classes is at least that of two sizes that may link."""
    return max(1, (-(-100 // percent) - 1).bit_length())


def size_class(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each size's class, and whether it is so near the class's least that it may link with sets of the class below."""
    k = (np.frexp(np.maximum(n, 1).astype(np.float64))[1].astype(np.int64) - 1) // _step(percent)
    return k, (k > 0) & (percent * n.astype(np.int64) < np.int64(100) << np.minimum(k * _step(percent), 40))


def signature_bytes(k: int, percent: int) -> int:
    return 1 << min(max((int(k) + 1) * _step(percent) + 2, SIGNATURE_BITS[0]), SIGNATURE_BITS[1]) - 3


def signature(own: np.ndarray, percent: int = PERCENT) -> bytes:
    """The set's bitmap: one bit for each token, by its low bits, as wide as its class's."""
    size = signature_bytes((max(len(own), 1).bit_length() - 1) // _step(percent), percent) * 8
    bits = np.zeros(size, np.uint8)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(many: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of `size` bytes or wider ones as rows of 64-bit words of that size: halves are put together by OR."""
    out = np.empty((len(many), size // 8), np.uint64)
    lengths = np.array([len(x) for x in many])
    for wide in np.unique(lengths):
        rows = np.flatnonzero(lengths == wide)
        bits = np.frombuffer(b"".join(many[i] for i in rows), np.uint64).reshape(len(rows), -1, size // 8)
        out[rows] = np.bitwise_or.reduce(bits, axis=1)
    return out


def set_id(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def row_sets(documents: DataFrame, rare: int = RARE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, fp (the set's identity), sig, and on some rows the tokens that are frequent among the rows of an
    Arrow batch with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                values, sizes = shingle_sets(part.data, part.offsets)
                bound = np.concatenate([[0], np.cumsum(sizes)])
                sets = [values[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
                token, times = np.unique(values, return_counts=True)
                often = times > max(2, len(part) // rare)
                rows = len(part)
                yield pa.record_batch([
                    batch.column("doc_id").slice(part.first, rows), pa.array(sizes.astype(np.int32)), pa.array([set_id(s) for s in sets]), pa.array([signature(s, percent) for s in sets], pa.binary()),
                    pa.array([token[often].view(np.int64)] + [None] * (rows - 1), pa.list_(pa.int64())), pa.array([times[often]] + [None] * (rows - 1), pa.list_(pa.int64())),
                ], ["doc_id", "n", "fp", "sig", "often", "times"])

    return texts(documents).mapInArrow(released(run), "doc_id long, n int, fp long, sig binary, often array<long>, times array<long>")


def frequent_tokens(rows: DataFrame, rare: int = RARE) -> np.ndarray:
    """Tokens that the batches report for more than one in 2 * rare sets, ascending: at most 2 * rare times the mean set."""
    n = rows.count()
    pairs = rows.where(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "times")).alias("x"))
    total = pairs.groupBy(F.col("x.often").alias("token")).agg(F.sum("x.times").alias("n")).where(F.col("n") * 2 * rare > n)
    return np.sort(total.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def block_rows(documents: DataFrame, last: np.ndarray, heavy: Bitmap | None = None, percent: int = PERCENT) -> DataFrame:
    """token, k, fp, n: a row for each token of each set's prefix and each size class in which the set is, with the
    tokens of `heavy` after the others and those of `last` at the end. Without `heavy`, rows of the set's own class
    alone. Equal sets of one slice give their rows once."""
    shared = documents.sparkSession.sparkContext.broadcast((last, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, heavy = shared.value
        for batch in batches:
            for part in slices(batch.column("text")):
                values, sizes = shingle_sets(part.data, part.offsets)
                at = np.minimum(np.searchsorted(often, values), max(len(often) - 1, 0))
                late = 2 * (often[at] == values).astype(np.int8) if len(often) else np.zeros(len(values), np.int8)
                if heavy is not None:
                    late[(late == 0) & heavy.has(values.view(np.int64))] = 1
                bound = np.concatenate([[0], np.cumsum(sizes)])
                tokens, ids, ns, seen = [], [], [], set()
                for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                    if a == b or (fp := set_id(values[a:b])) in seen:
                        continue
                    seen.add(fp)
                    n = b - a
                    prefix = n - -(-percent * n // 100) + 1
                    tokens.append(values[a:b][np.argsort(late[a:b], kind="stable")[:prefix]])
                    ids.append(np.full(prefix, fp))
                    ns.append(np.full(prefix, n, np.int32))
                if not tokens:
                    continue
                token, fp, n = (np.concatenate(x) for x in ([t.view(np.int64) for t in tokens], ids, ns))
                k, guest = size_class(n, percent)
                rows = np.arange(len(token))
                if heavy is not None:
                    rows, k = np.concatenate([rows, rows[guest]]), np.concatenate([k, k[guest] - 1])
                yield pa.record_batch([pa.array(token[rows]), pa.array(k.astype(np.int8)), pa.array(fp[rows]), pa.array(n[rows])], ["token", "k", "fp", "n"])

    return texts(documents).mapInArrow(released(run), "token long, k byte, fp long, n int")


def heavy_tokens(rows: DataFrame) -> Bitmap:
    """The tokens of more than HEAVY block rows, in a bitmap of bounded size: an order, so that its errors cost no link."""
    return bitmap(written(rows.groupBy("token").count().where(F.col("count") > HEAVY).select("token"), "heavy-tokens"))


def shared_blocks(rows: DataFrame) -> DataFrame:
    """token, k, fp, n, head, leader: the rows of blocks (token, k) of several sets, once for each set. head is the
    block's first set in order of size; leader is the set that the tree pairs it with: the first one of its node, or
    for that one the first of the lowest node above that starts elsewhere. The head is its own.

    Rows are dealt and sorted by (token, k, n, fp) and read as a stream that keeps one row and the first sets of the
    nodes that are open: a block of any size is never gathered."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "token").sortWithinPartitions("token", "k", "n", "fp")
    names = ["token", "k", "fp", "n", "head", "leader"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int8, np.int64, np.int32)]  # the last row, not yet written
        held_written, at, opened = False, 0, {}  # of the block that goes on: sets before, first sets of open nodes
        for batch in _then_none(batches):
            new = [np.asarray(x) for x in batch.columns] if batch is not None else [h[:0] for h in held]
            token, k, fp, n = (np.concatenate([h, x]) for h, x in zip(held, new, strict=True))
            if not len(token):
                continue
            fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])])
            token, k, fp, n = token[fresh], k[fresh], fp[fresh], n[fresh]
            begins = np.concatenate([[True], (token[1:] != token[:-1]) | (k[1:] != k[:-1])])
            place = np.arange(len(token))
            begin = np.maximum.accumulate(np.where(begins, place, 0))
            index = place - begin + np.where(begin == 0, at, 0)  # in the block
            leader, head = fp.copy(), fp[begin]
            if at:
                head[begin == 0] = opened[-1]
            size, todo = 1, index > 0
            while todo.any():
                own = np.flatnonzero(todo & (index // size % FANOUT > 0))
                todo[own] = False
                of = begin[own] + index[own] // (size * FANOUT) * (size * FANOUT) - np.where(begin[own] == 0, at, 0)
                leader[own] = np.where(of >= 0, fp[np.maximum(of, 0)], opened.get(size, opened.get(-1, 0)))
                size *= FANOUT
            same_before = ~begins
            same_before[0] = held_written
            same_after = np.concatenate([~begins[1:], [False]])
            keep = same_before | same_after
            if batch is not None:
                keep[-1] = False
                held = [token[-1:], k[-1:], fp[-1:], n[-1:]]
                held_written = bool(same_before[-1])
                if begin[-1] > 0:
                    opened = {}
                start, at, size = begin[-1] - (0 if begin[-1] else at), int(index[-1]), 1
                opened[-1] = head[-1]
                while True:  # the first set of the node that holds the last row, on each level
                    of = start + at // (size * FANOUT) * (size * FANOUT)
                    if of >= 0:
                        opened[size] = fp[of]
                    if at < size * FANOUT:
                        break
                    size *= FANOUT
            some = np.flatnonzero(keep)
            if len(some):
                yield pa.record_batch([pa.array(x[some]) for x in (token, k, fp, n, head, leader)], names)

    return dealt.select("token", "k", "fp", "n").mapInArrow(released(run), "token long, k byte, fp long, n int, head long, leader long")


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def possible(n_a: np.ndarray, sig_a: np.ndarray, n_b: np.ndarray, sig_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and bitmaps may have the similarity: their overlap is at most the common bits
    and the tokens that share a bit with another of their own set."""
    common = np.bitwise_count(sig_a & sig_b).sum(1, dtype=np.int64)
    extra = np.minimum(n_a - np.bitwise_count(sig_a).sum(1, dtype=np.int64), n_b - np.bitwise_count(sig_b).sum(1, dtype=np.int64))
    most = np.minimum(np.minimum(n_a, n_b), common + extra)
    return (100 + percent) * most >= percent * (n_a + n_b)


class SignatureForest:
    """A tree over each block's sets, in order of size, component and bitmap or as asked for, FANOUT to a node, level by level. A node
    has the OR of its bitmaps, the least and largest size, the most tokens that share a bit, its component if all
    below have the same, and whether all below are guests of the block. levels[0] holds the sets."""

    def __init__(self, block: np.ndarray, n: np.ndarray, sig: np.ndarray, component: np.ndarray, guest: np.ndarray, by: np.ndarray | None = None) -> None:
        self.order = np.lexsort((sig[:, 0], component, n, block) if by is None else (by, block))
        block, n, sig, component, guest = (x[self.order] for x in (block, n, sig, component, guest))
        extra = n - np.bitwise_count(sig).sum(1, dtype=np.int64)
        self.levels = [(sig, n, n, extra, component, guest)]
        self.first: list[np.ndarray] = [np.arange(len(n) + 1)]  # where each node's children begin, on the level below
        while (block[1:] == block[:-1]).any():
            new = np.concatenate([[True], block[1:] != block[:-1]])
            place = np.arange(len(block))
            place -= np.maximum.accumulate(np.where(new, place, 0))
            cut = np.flatnonzero(place % FANOUT == 0)
            sig, low, high, extra, component, guest = self.levels[-1]
            least, most = np.minimum.reduceat(component, cut), np.maximum.reduceat(component, cut)
            component = np.where((least != most) | (most == _MIXED), _MIXED, least)
            self.levels.append((np.bitwise_or.reduceat(sig, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(extra, cut), component, np.logical_and.reduceat(guest, cut)))
            self.first.append(np.append(cut, len(block)))
            block = block[cut]

    def _may_link(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether sets of different components below two nodes may link, by sizes and bitmaps."""
        sig, low, high, extra, component, guest = self.levels[level]
        fine = ~((component[a] == component[b]) & (component[a] != _MIXED)) & ~(guest[a] & guest[b])
        fine &= (percent * low[b] <= 100 * high[a]) & (percent * low[a] <= 100 * high[b])
        at = np.flatnonzero(fine)
        x, y = a[at], b[at]
        common = np.bitwise_count(sig[x] & sig[y]).sum(1, dtype=np.int64) + np.minimum(extra[x], extra[y])
        most = np.minimum(common, np.minimum(high[x], high[y]))
        fine[at] = (100 + percent) * most >= percent * (low[x] + low[y])
        return fine

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a child of a and one of b, each once where both are one node."""
        first = self.first[level]
        many = first[b + 1] - first[b]
        count = (first[a + 1] - first[a]) * many
        each = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        many = np.repeat(many, count)
        x, y = np.repeat(first[a], count) + each // many, np.repeat(first[b], count) + each % many
        real = (x <= y) | np.repeat(a != b, count)
        return x[real], y[real]

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of all pairs of different components that pass the bound, by dual traversal from each root with
        itself. Some thousand node pairs go down at a time."""
        top = len(self.levels) - 1
        nodes = np.arange(len(self.levels[top][1]))
        todo = [(top, nodes[i : i + _TURN], nodes[i : i + _TURN]) for i in range(0, len(nodes), _TURN)][::-1]
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                a, b = a[a != b], b[a != b]
            fine = self._may_link(level, a, b, percent)
            a, b = a[fine], b[fine]
            if level == 0:
                if len(a):
                    yield self.order[a], self.order[b]
            elif len(a):
                x, y = self._children(level, a, b)
                todo += [(level - 1, x[i : i + _TURN], y[i : i + _TURN]) for i in range(0, len(x), _TURN)]

    def node_pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of the pairs of each node's children, by the first set below each, that pass the bound."""
        leaf = np.arange(len(self.levels[0][1]))  # the first set below each node of the level
        for level in range(1, len(self.levels)):
            nodes = np.arange(len(self.levels[level][1]))
            for i in range(0, len(nodes), _TURN // 8):  # the bitmaps of all pairs are compared
                x, y = self._children(level, nodes[i : i + _TURN // 8], nodes[i : i + _TURN // 8])
                x, y = leaf[x[x != y]], leaf[y[x != y]]
                fine = self._may_link(0, x, y, percent)
                if fine.any():
                    yield self.order[x[fine]], self.order[y[fine]]
            leaf = leaf[self.first[level][:-1]]


#: So many node pairs go down at a time: each may have FANOUT * FANOUT pairs of children.
_TURN = 1 << 11
_MIXED = np.iinfo(np.int64).max
#: Blocks of one head go to at most so many tasks, where pairs that come up again are counted in groups of _PAIRS.
_DEALS = 32
_PAIRS = 1 << 18
#: About so many bytes of bitmaps stand in one forest; a block is never cut.
_FOREST = 2 << 20


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, siga, b, nb, sigb) that pass the bitmap bound."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("siga", "sigb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, a, b = (np.asarray(batch.column("na")), np.asarray(batch.column("nb")), batch.column("siga").to_pylist(), batch.column("sigb").to_pylist())
            width = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
            good = np.zeros(len(width), bool)
            for wide in np.unique(width):
                at = np.flatnonzero(width == wide)
                good[at] = possible(na[at], folded([a[i] for i in at], wide), nb[at], folded([b[i] for i in at], wide), percent)
            yield batch.drop_columns(["siga", "sigb"]).filter(pa.array(good))

    return pairs.mapInArrow(released(run), ", ".join(columns))


def _forests(batches: Iterator[pa.RecordBatch], percent: int, turn: int | None = None) -> Iterator[tuple[SignatureForest, np.ndarray, np.ndarray]]:
    """Forests of the blocks of a stream in the order of (k, token), with fp and n of their sets. A block stays whole,
    or else, with a turn, may be several trees, in an order of hashes that differs between turns."""
    held: pa.Table | None = None

    def made(rows: pa.Table):
        token, k, fp, n, component = (np.asarray(rows.column(c)) for c in ("token", "k", "fp", "n", "component"))
        n = n.astype(np.int64)
        block = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
        sig = folded(rows.column("sig").to_pylist(), signature_bytes(k[0], percent))
        return SignatureForest(block, n, sig, component, size_class(n, percent)[0] != k[0], None if turn is None else mixed(fp.view(np.uint64) + np.uint64(turn))), fp, n

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            new = pa.Table.from_batches([batch.slice(at, 4096)])
            held = pa.concat_tables([held, new]) if held is not None else new
            k = np.asarray(held.column("k"))
            for end in [*(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]:
                done = len(k) - held.num_rows
                yield made(held.slice(0, end - done))
                held = held.slice(end - done)
            if held.nbytes > _FOREST:
                token = np.asarray(held.column("token"))
                end = held.num_rows if turn is not None else int(np.flatnonzero(token != token[-1])[-1]) + 1 if token[0] != token[-1] else 0
                if end:
                    yield made(held.slice(0, end))
                    held = held.slice(end)
    if held is not None and held.num_rows:
        yield made(held)


_SETS = ["token", "k", "fp", "n", "component", "sig"]


def _node_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """a, b: the pairs of different components among each node's children in the blocks' trees that pass the bound.

    Rows are dealt by range, so that a large block lies in several tasks, as a tree in each."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(_SETS).repartitionByRange(parts, "k", "token", "fp").sortWithinPartitions("k", "token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forest, fp, _ in _forests(batches, percent, turn):
            for a, b in forest.node_pairs(percent):
                pairs = np.unique(np.stack([np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b])], 1), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.mapInArrow(released(run), "a long, b long").distinct()


def _traversed(rows: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb, blocks: by the traversal of each block's tree, the pairs of different components that may link, and
    in how many of some blocks each came up."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("head", *_SETS).repartition(parts, "head", F.pmod("token", F.lit(_DEALS))).sortWithinPartitions("k", "head", "token").select(_SETS)

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        """a, b, na, nb and in how many blocks each pair came up."""
        every = np.concatenate(found, axis=1)
        order = np.lexsort((every[1], every[0]))
        a, b = every[0][order], every[1][order]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return pa.record_batch([*(pa.array(x[order[cut]]) for x in every), pa.array(np.diff(np.concatenate([cut, [len(order)]])))], ["a", "b", "na", "nb", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for forest, fp, n in _forests(batches, percent):
            for a, b in forest.pairs(percent):
                a, b = np.where(fp[a] < fp[b], a, b), np.where(fp[a] < fp[b], b, a)
                found.append(np.stack([fp[a], fp[b], n[a], n[b]]))
                if sum(x.shape[1] for x in found) > _PAIRS:
                    yield counted(found)
                    found = []
        if found:
            yield counted(found)

    return dealt.mapInArrow(released(run), "a long, b long, na long, nb long, blocks long")


def _cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of different components that may link.

    Of two similar sets x and y with at least o tokens in common, the first min(|prefix x| - |x| + o, |prefix y| -
    |y| + o) common ones are in both prefixes, so that a pair must come up in at least so many blocks of its class."""
    found = _traversed(rows, percent).groupBy("a", "b", "na", "nb").agg(F.sum("blocks").alias("blocks"))
    common = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    outside = [F.col(n) - (F.col(n) - F.ceil(percent * F.col(n) / 100) + 1) for n in ("na", "nb")]
    return found.where(F.col("blocks") >= common - F.greatest(*outside)).select("a", "b")


def sets_of(documents: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, tokens of the wanted sets, each from the document of smallest id that has it.

    A bitmap of fixed size keeps most other documents from being read into sets; the join then leaves the rest."""
    own = rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("own_id"))
    own = written(own, "set-owners")
    bits = documents.sparkSession.sparkContext.broadcast(bitmap(own.where("own_id is not null").select("own_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            batch = batch.filter(pa.array(bits.value.has(np.asarray(ids.fill_null(0))) | np.asarray(ids.is_null())))
            for part in slices(batch.column("text")) if batch.num_rows else ():
                values, sizes = shingle_sets(part.data, part.offsets)
                bound = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(values.view(np.int64)))
                ids = pa.array([set_id(values[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)], pa.int64())
                yield pa.record_batch([batch.column("doc_id").slice(part.first, len(part)), ids, lists], ["doc_id", "fp", "tokens"])

    found = texts(documents).mapInArrow(released(run), "doc_id long, fp long, tokens array<long>")
    return found.join(own.withColumnRenamed("fp", "set"), found["doc_id"].eqNullSafe(F.col("own_id")) & (F.col("fp") == F.col("set"))).groupBy("fp").agg(F.first("tokens").alias("tokens"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, compared token by token."""
    left = sets.select(F.col("fp").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("tokens").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            (fx, ox), (fy, oy) = ((np.asarray(c.values).view(np.uint64), np.asarray(c.offsets)) for c in (x, y))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                own, other = fx[ox[i] : ox[i + 1]], fy[oy[i] : oy[i + 1]]
                both = np.sort(np.concatenate([own, other]))
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (len(own) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(released(run), "a long, b long")


def jaccard_classes(documents: DataFrame, *, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) of every row.

    Two rows link when 100 times their sets' intersection is at least `percent` times the union; rows with equal
    sets do. Null, empty and blank texts have no set and link with nothing: component_id is their own doc_id.
    Rows that repeat a doc_id are rows like others; a null doc_id is no component_id."""
    all_rows = written(row_sets(documents, rare, percent), "shingle-rows")
    rows = all_rows.select("doc_id", "n", "fp", "sig")
    last = frequent_tokens(all_rows, rare)
    heavy = heavy_tokens(block_rows(documents, last, percent=percent))
    live = written(shared_blocks(block_rows(documents, last, heavy, percent)), "shared-blocks")
    sizes = rows.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    sizes = written(sizes.join(live.select("fp").distinct(), "fp", "left_semi"), "signatures")

    a = sizes.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("sig").alias("siga"))
    b = sizes.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sigb"))
    near = live.where("fp != leader").groupBy(F.col("leader").alias("a"), F.col("fp").alias("b")).agg(F.count("*").alias("blocks"))
    close = _bounded(near.join(b, "b").join(a, "a").where(f"{percent} * na <= 100 * nb and {percent} * nb <= 100 * na"), percent)
    first = close.groupBy("b").agg(F.max_by("a", F.struct("blocks", "a")).alias("a")).select("a", "b")
    first = written(first, "first-pairs")
    ends = first.select(F.col("a").alias("fp")).union(first.select(F.col("b").alias("fp"))).distinct()
    links = written(verified(first, sets_of(documents, rows, ends), percent), "links")

    def placed(labels: DataFrame) -> DataFrame:
        return sizes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "sig", F.coalesce("label", "fp").alias("component"))

    def undecided(labels: DataFrame, least: int) -> DataFrame:
        """The rows of the blocks of more than `least` sets and of several components."""
        where = placed(labels)
        several = live.join(where.select("fp", "component"), "fp").groupBy("token", "k").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("sets"))
        split = written(several.where(f"low != high and sets > {least}").select("token", "k"), "split-blocks")
        return live.join(split, ["token", "k"], "left_semi").select("token", "k", "fp", "n", "head").join(where, "fp")

    def joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """The components with those of the pairs that are links: a set's label stands for all its links so far."""
        ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
        links = written(verified(pairs, sets_of(documents, rows, ends), percent), "links")
        return components(links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))

    labels = components(links)
    for turn in range(TURNS):
        labels = joined(labels, written(_node_pairs(undecided(labels, LIGHT), percent, turn), "node-pairs"))
    labels = joined(labels, written(_cross_pairs(undecided(labels, 1), percent), "cross-pairs"))

    smallest = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = smallest.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = written(named, "classes")
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(heads, "label").select("fp", "component_id")
    out = rows.select("doc_id", "n", "fp").join(classes, "fp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of near-duplicate texts of documents."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
