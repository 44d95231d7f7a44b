"""Media columns: Netpbm and BMP images in binary columns, decoded to numpy arrays, area-resized by
integral images and kept as NPY tiles with difference hashes.

One row in, one row out, in Arrow batches without a shuffle: memory is that of a batch and one image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.shared import texts

WIDTH = 64
TILE = 16


def to_pgm(image: np.ndarray) -> bytes:
    """A grey (height, width) or colour (height, width, 3) uint8 array as binary Netpbm."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + image.tobytes()


def to_bmp(image: np.ndarray) -> bytes:
    """A grey uint8 array as an 8-bit BMP with a grey palette, rows from the bottom, padded to four bytes."""
    height, width = image.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    at, fields = 2, []
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    if most > 255:
        raise ValueError("samples of more than 8 bits")
    shape = (height, width) if data[:2] == b"P5" else (height, width, 3)
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", data, 10)[0]
    size, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24):
        raise ValueError("only plain 8- and 24-bit BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows[:, : 3 * width].reshape(abs(height), width, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
    pixels = palette[:, :3][rows[:, :width]]
    grey = (pixels[..., 0] == pixels[..., 1]).all() and (pixels[..., 1] == pixels[..., 2]).all()
    return pixels[..., 0] if grey else pixels[..., ::-1]


def decoded(data: bytes) -> np.ndarray:
    """The uint8 array of a P5, P6 or plain BMP image; ValueError for anything else."""
    if data[:2] in (b"P5", b"P6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _edges(sums: np.ndarray, parts: int) -> np.ndarray:
    """A prefix sum along axis 0 read at the edges of equal parts, between samples by the share of the sample."""
    at = np.linspace(0, len(sums) - 1, parts + 1)
    low = np.minimum(at.astype(np.int64), len(sums) - 1)
    high = np.minimum(low + 1, len(sums) - 1)
    share = (at - low).reshape(-1, *[1] * (sums.ndim - 1))
    return sums[low] * (1 - share) + sums[high] * share


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, from the integral image; colour is averaged to grey first.

    The integral image is summed along x in blocks of rows and kept only at the target's column edges.
    """
    if image.ndim == 3:
        image = image.mean(2)
    h, w = image.shape
    columns = np.empty((h, width + 1))
    for row in range(0, h, 8192):
        block = image[row : row + 8192]
        sums = np.zeros((w + 1, len(block)))
        np.cumsum(block.T, axis=0, dtype=np.float64, out=sums[1:])
        columns[row : row + 8192] = _edges(sums, width).T
    both = np.zeros((h + 1, width + 1))
    np.cumsum(columns, axis=0, out=both[1:])
    corners = _edges(both, height)
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 9 x 8 area means is below its right neighbour."""
    small = np.round(resized(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def payload_images(documents: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes and zeros up to a positive multiple of 64, as a grey
    image 64 wide. Null and empty texts make one row of zeros; equal texts make equal images."""
    build = {"pgm": to_pgm, "bmp": to_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column("text").cast(pa.binary()):
                raw = text.as_py()
                sizes.append(len(raw))
                raw += bytes(-len(raw) % WIDTH if raw else WIDTH)
                media.append(build(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(documents).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, tile: int = TILE) -> DataFrame:
    """The rows of media with what its `media` column decodes to: height, width, payload_bytes, payload_sha256,
    tail_crc32, tile_npy (an NPY file of the area-resized image) and dhash.

    A null or unreadable image gives nulls in these columns; the row stays."""
    fields = "height int, width int, payload_bytes long, payload_sha256 string, tail_crc32 long, tile_npy binary, dhash string"
    names = [x.split()[0] for x in fields.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    clash = set(names) & set(media.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")

    def one(data: bytes | None) -> tuple:
        try:
            image = decoded(data or b"")
        except (ValueError, struct.error, IndexError):
            return (None,) * len(names)
        raw = image.tobytes()
        thumb = np.clip(np.round(resized(image, tile, tile)), 0, 255).astype(np.uint8) if image.size else np.zeros((tile, tile), np.uint8)
        return *image.shape[:2], len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), npy(thumb), difference_hash(image) if image.size else "0" * 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column("media")]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
            yield pa.record_batch([*batch.columns, *made], [*batch.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{own}, {fields}")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored as a PGM image, read back, with its digests."""
    stored = payload_images(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = media_features(stored)
    return back.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.sha2("tile_npy", 256)).alias("feature"),
    )
