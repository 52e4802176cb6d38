"""Media columns: Netpbm and BMP decoded, area-resized and written as NPY tiles.

Images are decoded to numpy arrays, reduced to grey, resized by exact area
means taken from an integral image, and stored as an NPY tile with a
difference hash (each bit tells whether a cell is brighter than its left
neighbour). All work is per image within a task; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

TILE = 16
WIDTH = 64

_HEADER = re.compile(rb"P([2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode(data: bytes) -> np.ndarray:
    """uint8 array of (height, width) or (height, width, 3) of an 8-bit PGM, PPM or BMP.

    Samples of a smaller maximum are scaled to 255. Anything else, and damaged
    images, raise ValueError.
    """
    if data[:2] == b"BM":
        return _decode_bmp(data)
    m = _HEADER.match(data)
    if not m:
        raise ValueError("neither PGM, PPM nor BMP")
    kind, width, height, most = map(int, m.groups())
    if most > 255 or most == 0 or width == 0 or height == 0:
        raise ValueError("not 8-bit samples")
    shape = (height, width) if kind in (2, 5) else (height, width, 3)
    n = height * width * (1 if kind in (2, 5) else 3)
    if len(data) - m.end() < n:
        raise ValueError("truncated")
    if kind in (5, 6):
        out = np.frombuffer(data, np.uint8, n, m.end())
    else:
        out = np.array(data[m.end() :].split()[:n], dtype=np.int64)
        if len(out) < n:
            raise ValueError("truncated")
    if out.min() < 0 or out.max() > most:
        raise ValueError("a sample above the maximum")
    if most < 255:
        out = (out.astype(np.int64) * 510 + most) // (2 * most)  # to the full range, rounded
    return out.astype(np.uint8, copy=False).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("truncated")
    start, header, width, height, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if header < 40 or start < 14 + header or bits not in (8, 24) or packed or width <= 0 or height == 0:
        raise ValueError("not an uncompressed BMP of 8 or 24 bits")
    rows, stride = abs(height), (width * bits // 8 + 3) // 4 * 4
    if len(data) < start + rows * stride:
        raise ValueError("truncated")
    pixels = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)[:, : width * bits // 8]
    if height > 0:
        pixels = pixels[::-1]
    if bits == 24:
        return pixels.reshape(rows, width, 3)[:, :, ::-1]
    n = (start - 14 - header) // 4
    palette = np.frombuffer(data, np.uint8, 4 * n, 14 + header).reshape(n, 4)[:, 2::-1]
    if pixels.max() >= n:
        raise ValueError("a pixel beyond the palette")
    return palette[pixels]


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """A payload of a whole number of rows as binary PGM."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell's area of a grey image, in 1/256ths, by an integral image.

    Sums are of integers, so equal images have equal results on any machine.
    """
    h, w = image.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(image, axis=0, dtype=np.int64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
    # cell edges are i*h/height; the integral between pixels is linear
    ys, xs = np.arange(height + 1) * h, np.arange(width + 1) * w
    y, x = ys // height, xs // width
    rows = total[y] * height + (total[np.minimum(y + 1, h)] - total[y]) * (ys % height)[:, None]
    at = rows[:, x] * width + (rows[:, np.minimum(x + 1, w)] - rows[:, x]) * (xs % width)[None, :]
    cells = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]  # scaled by height * width
    return cells * 256 // (h * w)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.int64) @ np.array([299, 587, 114]) // 1000)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: each of 8 x 9 cells against its right neighbour."""
    cells = area_resize(image, 8, 9)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, (area_resize(image, side, side) // 256).astype(np.uint8))
    return out.getvalue()


def media_tiles(media: DataFrame, data_col: str = "media", side: int = TILE) -> DataFrame:
    """``media`` with width, height, tile (NPY bytes), dhash and error.

    A null or undecodable image has null in the four and says why in
    ``error``. Columns of ``media`` with these names are replaced; repeated
    rows stay; an empty table gives an empty result.
    """
    added = ["width", "height", "tile", "dhash", "error"]
    kept = media.drop(*added)
    schema = kept.select("*", F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(b"").alias("tile"), F.lit("").alias("dhash"), F.lit("").alias("error")).schema
    for name in added:
        schema[name].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(data_col).to_pylist():
                try:
                    if data is None:
                        raise ValueError("null")
                    image = decode(data)
                    one = grey(image)
                    out.append((image.shape[1], image.shape[0], npy_tile(one, side), difference_hash(one), None))
                except ValueError as e:
                    out.append((None, None, None, None, str(e)))
            columns = [list(c) for c in zip(*out)] or [[]] * 5
            types = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*batch.schema.names, *added])

    return kept.mapInArrow(run, schema)


def store_text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a PGM image, in a table that is written to the shared folder.

    The UTF-8 bytes and zeros up to a positive multiple of ``width`` are the
    samples. Null text counts as empty: one row of zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1):
            texts = [x or b"" for x in some.column(1).cast(pa.binary()).to_pylist()]
            images = [encode_pgm(x + bytes(-len(x) % width or (0 if x else width)), width) for x in texts]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(docs.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def read_text_media(stored: DataFrame, side: int = TILE) -> DataFrame:
    """Digests of what was stored and of what is read back from it, the difference hash as ``feature``, and the NPY tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 2):
            rows = []
            for media in some.column(2).to_pylist():
                image = decode(media)
                back = image.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), npy_tile(image, side)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, side: int = TILE) -> DataFrame:
    """Each text stored as a PGM image, and what is read back from the store.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (difference hash), tile (NPY). One row
    per row of ``docs``, repeated rows and null ids too; null text counts as
    empty; an empty table gives an empty result; further columns are not read.
    """
    return read_text_media(store_text_media(docs, id_col, text_col, width), side)
