"""Media columns: Netpbm and BMP images in numpy arrays, area-resized, with NPY tiles and hashes.

Resizing averages areas by an integral image: the sum under any rectangle is four reads, also where
its edges fall inside samples. The difference hash compares neighbours in a row of the image at
9 x 8 samples.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, utf8

#: Samples in a row of an image that stores bytes, and in a square block of them.
WIDTH, BLOCK = 24, 576
#: Side of a tile.
TILE = 16
#: A field of a Netpbm header, after blanks and comments.
FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for (rows, columns), P6 for (rows, columns, 3); 8-bit samples."""
    rows, columns = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if image.ndim == 3 else 5, columns, rows) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6; bitmaps as 0 (black) and 255, samples of two bytes as uint16."""
    kind, at = data[:2], 2
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    fields = []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := FIELD.match(data, at)):
            raise ValueError("a Netpbm header ends early")
        fields.append(int(m[1]))
        at = m.end()
    columns, rows, top = (*fields, 1)[:3]
    bands = 3 if kind in (b"P3", b"P6") else 1
    count = rows * columns * bands
    if kind == b"P1":
        flat = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:count], np.uint8) == ord("0")
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:count], dtype=np.uint16)
    elif kind == b"P4":
        packed = np.frombuffer(data, np.uint8, rows * ((columns + 7) // 8), at + 1).reshape(rows, -1)
        flat = np.unpackbits(packed, axis=1)[:, :columns].reshape(-1) == 0
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at + 1)
    if flat.dtype == bool:
        flat = flat.astype(np.uint8) * 255
    elif top < 256:
        flat = flat.astype(np.uint8)
    else:
        flat = flat.astype(np.uint16)
    return flat.reshape((rows, columns, 3) if bands == 3 else (rows, columns))


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey with a palette for (rows, columns), 24-bit for (rows, columns, 3); the last row first."""
    rows, columns = image.shape[:2]
    grey = image.ndim == 2
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.empty(0, np.uint8)
    line = (image if grey else image[:, :, ::-1]).reshape(rows, -1).astype(np.uint8)
    body = np.pad(line[::-1], ((0, 0), (0, -line.shape[1] % 4))).tobytes()
    at = 54 + palette.nbytes
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + len(body), 0, 0, at, 40, columns, rows, 1, 8 if grey else 24, 0, len(body), 2835, 2835, 256 if grey else 0, 0) + palette.tobytes() + body


def decode_bmp(data: bytes) -> np.ndarray:
    """1, 4, 8, 24 and 32 bits without compression; a grey palette gives (rows, columns)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, header, columns, rows, _, bits, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("a kind of BMP that isn't supported")
    up, rows = rows > 0, abs(rows)
    stride = (columns * bits + 31) // 32 * 4
    lines = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    lines = lines[::-1] if up else lines
    if bits >= 24:
        size = bits // 8
        return lines[:, : columns * size].reshape(rows, columns, size)[:, :, 2::-1].copy()
    each = np.unpackbits(lines, axis=1).reshape(rows, -1, bits)[:, :columns] if bits < 8 else None
    index = lines[:, :columns] if bits == 8 else np.packbits(np.pad(each, ((0, 0), (0, 0), (8 - bits, 0))), axis=2)[:, :, 0]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
    colours = palette[index]
    grey = bool((palette == palette[:, :1]).all())
    return colours[:, :, 0].copy() if grey else colours


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.mean(axis=2)


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The mean of each of rows x columns equal areas of a grey image, as doubles."""
    high, wide = image.shape
    total = np.zeros((high + 1, wide + 1))
    np.cumsum(np.cumsum(image, axis=1, dtype=np.float64), axis=0, out=total[1:, 1:])

    def cut(table: np.ndarray, size: int, parts: int) -> np.ndarray:
        at = np.arange(parts + 1) * size / parts
        low = np.minimum(at.astype(np.int64), size - 1)
        return table[low] + (at - low)[:, None] * (table[low + 1] - table[low])

    corner = cut(cut(total, high, rows).T, wide, columns).T
    area = (high / rows) * (wide / columns)
    return (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]) / area


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: a bit is set where a sample of the 9 x 8 image is less than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray) -> bytes:
    """The image at TILE x TILE 8-bit samples, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.clip(np.rint(area_resize(image, TILE, TILE)), 0, 255), np.uint8))
    return out.getvalue()


def store(payload: bytes, form: str = "pgm") -> bytes:
    """Bytes as the samples of a grey image, padded by 255 to a positive multiple of BLOCK."""
    size = max(1, -(-len(payload) // BLOCK)) * BLOCK
    image = np.frombuffer(payload.ljust(size, b"\xff"), np.uint8).reshape(-1, WIDTH)
    return encode_bmp(image) if form == "bmp" else encode_netpbm(image)


def images(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_bytes, media, tile, feature.

    media is the text's UTF-8 bytes stored as an image, tile the NPY tile and feature the difference
    hash of the image decoded from media. A null text is empty; its image is one block of 255. Null
    ids and repeated rows are kept; other columns, whatever their names, are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            media = [store(t, form) for t in texts]
            read = [grey(decode(m)) for m in media]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary()), pa.array(list(map(npy_tile, read)), pa.binary()), pa.array(list(map(difference_hash, read)), pa.string())],
                ["doc_id", "n_bytes", "media", "tile", "feature"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")), run, "doc_id long, n_bytes long, media binary, tile binary, feature string", 256)


def write_tiles(docs: DataFrame, path: str, form: str = "pgm") -> None:
    """Write the tiles of images() as Parquet below path: doc_id, tile (an NPY file's bytes) and feature."""
    images(docs, form).select("doc_id", "tile", "feature").write.parquet(path)


def digests(docs: DataFrame, form: str = "pgm", other: str = "bmp") -> DataFrame:
    """As images(), with digests of the stored form and of what it decodes to in place of the bytes.

    The image is stored in another form too; other_sha256 is that form's digest, and same says whether it
    decodes to the same samples.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                media = store(text, form)
                image = decode(media)
                back = image.tobytes()
                second = store(text, other)
                digest = [hashlib.sha256(x).hexdigest() for x in (back, media, npy_tile(image), second)]
                same = np.array_equal(decode(second), image)
                rows.append((len(text), len(back), digest[0], zlib.crc32(back[-32:]), len(media), digest[1], difference_hash(image), digest[2], digest[3], same))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], [c.split()[0] for c in schema.split(", ")])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string, other_sha256 string, same boolean"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")), run, schema, 256)
