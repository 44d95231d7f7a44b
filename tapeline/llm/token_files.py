"""Token ids in flat unsigned integer files with 64-bit document offsets, memory-mapped for reading.

A file set has, for each partition k of the ascending doc_id order, `part-k.bin` (ids, little-endian, 16 bits
where the vocabulary fits and 32 otherwise), `part-k.off` (n + 1 offsets into it, counted in ids, 64 bits) and
`part-k.doc` (doc_ids, 64 bits), and a Parquet manifest with a row for each partition. The position of a
document in the whole sequence is its partition's base, a prefix sum over the manifest, plus its own offset.

Texts are range-partitioned by doc_id before they are encoded, so that ids are never shuffled. A task writes
under a name of its own attempt and renames at the end: a repeated task replaces equal files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.llm.shared import gathered, lowered, scratch, slices, texts

KEPT_WORDS = 1_000_000
NO_ID = -(1 << 63)
MANIFEST = "part int, n_docs long, n_tokens long, width int"


_LETTERS, _STOPS = np.zeros(256, bool), np.zeros(256, bool)
_LETTERS[97:123] = True
_STOPS[[*b".,!?;:"]] = True


class _Slots(dict):
    """Numbers for words in the order they are first asked for; those asked for since the last look are in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self)
        self.new.append(word)
        return slot


class WordIds:
    """Ids of whole texts by a tokenizers file that lowers letters, drops white space and splits letters from signs.

    Such a file encodes what stands between two ASCII white-space characters by itself, and a run of signs after
    an ASCII letter apart from it, so the library is asked once for each such piece and texts are put together
    from the pieces' ids. Pieces go to the library some hundred at a time, between a special token.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark_id, mark = min(self.tokenizer.get_added_tokens_decoder().items())
        self.mark = mark.content
        self._forget()

    def _forget(self) -> None:
        self.known = _Slots()
        self.flat, self.start, self.length = array("I"), array("q"), array("q")

    def _keep(self, ids: np.ndarray) -> None:
        self.start.append(len(self.flat))
        self.length.append(len(ids))
        self.flat.frombytes(ids.astype(np.uint32).tobytes())

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, end: int | None) -> None:
        """Ids for the new pieces, in the order of their numbers; the piece of one space stands for the end id."""
        new, self.known.new = self.known.new, []
        for at in range(0, len(new), 256):
            some = [x.decode("utf-8", errors="replace") for x in new[at : at + 256]]
            if any("<" in x or x == " " for x in some):  # special tokens' strings may be among them
                for x in some:
                    self._keep(np.array([end]) if x == " " else self._encode(x))
                continue
            ids = self._encode(self.mark.join(some))
            cuts = np.flatnonzero(ids == self.mark_id)
            starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]])
            plain = np.delete(ids, cuts)
            self.start.extend((len(self.flat) + starts - np.arange(len(starts))).tolist())
            self.length.extend((ends - starts).tolist())
            self.flat.frombytes(plain.tobytes())

    def encode_many(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by `end`, and how many each has."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        special = ((data[:-1] == 60) & (data[1:] == 124)).any()  # "<|": a special token's string is matched as it is written
        small = data if special else lowered(data)
        cut = np.flatnonzero(_STOPS[small[1:]] & _LETTERS[small[:-1]]) + 1
        spaced = np.insert(small, cut, 32).tobytes()
        bounds = (offsets + np.searchsorted(cut, offsets, side="left")).tolist()
        found: list[int] = []
        ends = [0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            found.extend(map(self.known.__getitem__, spaced[a:b].split()))
            if end is not None:
                found.append(self.known[b" "])
            ends.append(len(found))
        self._learn(end)
        slots = np.array(found, np.int64)
        lengths = np.frombuffer(self.length, np.int64)[slots]
        ids = gathered(np.frombuffer(self.flat, np.uint32), np.frombuffer(self.start, np.int64)[slots], lengths)
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[ends])


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def id_width(vocabulary: str) -> int:
    """Bytes for an id: 2 where every id of the vocabulary is below 65,536."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4


def write_token_files(documents: DataFrame, path: str, vocabulary: str, end_id: int, width: int | None = None) -> DataFrame:
    """Writes the file set of all texts under path, in ascending doc_id order, and returns its manifest.

    Null and empty texts have the end id alone. Rows of one doc_id stand in the order of their texts; null
    doc_ids come first, are written as the smallest 64-bit integer and read as null again. An empty table gives an empty manifest."""
    spark = documents.sparkSession
    width = width or id_width(vocabulary)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(documents).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, store, root = word_ids(vocabulary), *fs.FileSystem.from_uri(path)
        own = f"{root}/tmp-{part}-{uuid.uuid4().hex}"
        names = [f"{own}.{x}" for x in ("bin", "off", "doc")]
        n_docs = n_tokens = 0
        with store.open_output_stream(names[0]) as ids_out, store.open_output_stream(names[1]) as off_out, store.open_output_stream(names[2]) as doc_out:
            off_out.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                for some in slices(batch.column("text")):
                    ids, lengths = encoder.encode_many(some.data, some.offsets, end_id)
                    ids_out.write(ids.astype(f"<u{width}").tobytes())
                    off_out.write((n_tokens + np.cumsum(lengths)).astype("<u8").tobytes())
                    docs = batch.column("doc_id").slice(some.first, len(some)).fill_null(NO_ID)
                    doc_out.write(docs.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    n_docs += len(some)
                    n_tokens += len(ids)
        if n_docs:
            for name in names:
                store.move(name, f"{root}/part-{part}.{name[-3:]}")
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n_docs]), pa.array([n_tokens]), pa.array([width], pa.int32())], ["part", "n_docs", "n_tokens", "width"])
        else:
            for name in names:
                store.delete_file(name)

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The partitions of a file set with `base`, the ids of all partitions before; as many rows as partitions."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the memory-mapped files of the set.

    start counts the ids of all documents before it; the checksum is of the ids as 32-bit integers."""
    parts = manifest(spark, path)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def mapped(store: fs.FileSystem, name: str, kind: str) -> np.ndarray:
        if isinstance(store, fs.LocalFileSystem):
            with pa.memory_map(name) as f:
                return np.frombuffer(f.read_buffer(), kind)
        with store.open_input_file(name) as f:
            return np.frombuffer(f.readall(), kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        for rows in batches:
            for part, width, base in zip(rows["part"], rows["width"], rows["base"], strict=True):
                name = f"{root}/part-{part}"
                ids, offsets, docs = mapped(store, f"{name}.bin", f"<u{width}"), mapped(store, f"{name}.off", "<u8").astype(np.int64), mapped(store, f"{name}.doc", "<i8")
                for at in range(0, len(docs), 10_000):
                    bounds = offsets[at : at + 10_001]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pd.DataFrame({"doc_id": docs[at : at + 10_000], "start": base + bounds[:-1], "n_tokens": np.diff(bounds), "ids_crc32": sums})

    rows = parts.repartition(count, "part").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents in a file set of the shared folder, and each document read back from it."""
    import public_tokenizers

    path = scratch(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path)
