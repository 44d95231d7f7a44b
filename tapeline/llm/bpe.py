"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, skipping
stale entries; decoding by concatenating vocabulary strings.

Each Python worker keeps the encodings of the words it has met in a table bounded in bytes, so the queue runs
once for a word; ids of a slice of texts are then gathered by numpy. No shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.shared import Slice, gathered, released, slices, texts

#: Fixed value: the published pattern that splits a text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker forgets its words when their table is larger: text, ids and about WORD_BYTES for the entry of each.
KEPT_BYTES = 48 << 20
WORD_BYTES = 150
_SHIFT = 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary file; encodes and decodes one text or many."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab: dict[str, int] = file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        letters = byte_letters()
        self.byte_id = [vocab[x] for x in letters]
        back = {x: i for i, x in enumerate(letters)}
        self.merges = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << _SHIFT | vocab[b]] = (rank, vocab[a + b])
        strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            strings[i] = bytes(back[x] for x in token)
        for token, i in self.special.items():
            strings[i] = token.encode()
        self.strings = strings
        self.string_bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.string_length = np.array([len(x) for x in strings], np.int64)
        self.string_start = np.cumsum(self.string_length) - self.string_length
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat, self.start, self.length = array("I"), array("q"), array("q")
        for i in self.special.values():
            self._keep(None, [i])

    def _keep(self, word: str | None, ids: list[int]) -> int:
        slot = len(self.start)
        self.start.append(len(self.flat))
        self.length.append(len(ids))
        self.flat.extend(ids)
        if word is not None:
            self.known[word] = slot
            self.held += WORD_BYTES + 4 * (len(word) + len(ids))
        return slot

    def merged(self, word: str) -> list[int]:
        """The ids of one word: the adjacent pair of lowest rank is merged first, the leftmost of equals."""
        symbols = [self.byte_id[b] for b in word.encode()]
        n = len(symbols)
        if n < 2:
            return symbols
        merges, shift = self.merges, _SHIFT
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        queue = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << shift | symbols[i + 1])
            if found:
                queue.append((found[0], i))
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if j < 0 or symbols[i] < 0:
                continue
            found = merges.get(symbols[i] << shift | symbols[j])
            if not found or found[0] != rank:
                continue
            symbols[i], symbols[j] = found[1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if right := merges.get(symbols[i] << shift | symbols[k]):
                    heapq.heappush(queue, (right[0], i))
            if (h := before[i]) >= 0 and (left := merges.get(symbols[h] << shift | symbols[i])):
                heapq.heappush(queue, (left[0], h))
        return [x for x in symbols if x >= 0]

    def _add_slots(self, text: str, out: list[int]) -> None:
        """Appends, for each piece of the text, the slot that holds its ids."""
        parts = self.split.split(text) if self.split and any(x in text for x in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append([*self.special].index(part))
                continue
            pieces, before = self.pattern.findall(part), len(out)
            try:
                out.extend(map(self.known.__getitem__, pieces))
            except KeyError:
                for piece in set(pieces).difference(self.known):
                    self._keep(piece, self.merged(piece))
                out[before:] = map(self.known.__getitem__, pieces)

    def encode_many(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if self.held > KEPT_BYTES:
            self._forget()
        found: list[int] = []
        ends = [0]
        for text in many:
            self._add_slots(text, found)
            ends.append(len(found))
        slots = np.array(found, np.int64)
        lengths = np.frombuffer(self.length, np.int64)[slots]
        ids = gathered(np.frombuffer(self.flat, np.uint32), np.frombuffer(self.start, np.int64)[slots], lengths)
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[ends])

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        return gathered(self.string_bytes, self.string_start[ids], self.string_length[ids]).tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The vocabulary of a file, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _encoded(bpe: ByteBpe, part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a slice's texts one after the other, and where each text's begin and end."""
    ids, lengths = bpe.encode_many([part.bytes(i).decode("utf-8", errors="replace") for i in range(len(part))])
    return ids, np.concatenate([[0], np.cumsum(lengths)])


def _decoded(bpe: ByteBpe, ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """n_tokens, ids_sha256 and the text of each run of ids."""
    runs = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    digests = [hashlib.sha256(x.astype("<u4", copy=False).tobytes()).hexdigest() for x in runs]
    return [pa.array([len(x) for x in runs], pa.int64()), pa.array(digests, pa.string()), pa.array([bpe.decode(x) for x in runs], pa.string())]


def encoded(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text. Null and empty texts have no ids; strings of special
    tokens in a text become their ids, as the vocabulary's own library does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            for part in slices(batch.column("text")):
                ids, bounds = _encoded(bpe, part)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.record_batch([batch.column("doc_id").slice(part.first, len(part)), lists], ["doc_id", "ids"])

    return texts(documents).mapInArrow(released(run), "doc_id long, ids array<int>")


_TEXTS = "doc_id long, n_tokens long, ids_sha256 string, text string"
_NAMES = ["doc_id", "n_tokens", "ids_sha256", "text"]


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit), text: the ids' strings concatenated.
    Null and empty id lists give an empty text; bytes that are no UTF-8 become the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            lists = batch.column("ids")
            bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            row = 0
            while row < len(lists):
                end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + (1 << 18), side="right")) - 1)
                end = min(end, len(lists))
                yield pa.record_batch([batch.column("doc_id").slice(row, end - row), *_decoded(bpe, flat, bounds[row : end + 1])], _NAMES)
                row = end

    tokens = tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return tokens.mapInArrow(released(run), _TEXTS)


def round_trip(documents: DataFrame, vocabulary: str) -> DataFrame:
    """What decoded() gives for encoded(): both in one pass of one Python worker for each task, in which the ids of
    about a MB of texts exist at a time. Nulls and odd texts as in those two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            for part in slices(batch.column("text")):
                yield pa.record_batch([batch.column("doc_id").slice(part.first, len(part)), *_decoded(bpe, *_encoded(bpe, part))], _NAMES)

    return texts(documents).mapInArrow(released(run), _TEXTS)


def digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again. Every row gives one,
    rows without a text or doc_id and rows that repeat another too."""
    return round_trip(documents, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded again."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
