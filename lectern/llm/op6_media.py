"""Media columns: Netpbm and BMP to numpy, area resize, NPY tiles, difference hashes.

``decode`` reads P1 to P6 and BMP of 1, 4, 8 and 24 bits into arrays;
``area_resize`` averages exact boxes through an integral image; ``tile`` is the
NPY form of the resized image and ``difference_hash`` its 64-bit gradient hash.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import stage

UNIT = 576
WIDTH = 24
TILE = 32


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + image.astype(np.uint8).tobytes()


def encode_ppm(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    return b"P6\n%d %d\n255\n" % (w, h) + image.astype(np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey or 24-bit colour, rows from the bottom up, padded to four bytes."""
    h, w = image.shape[:2]
    grey = image.ndim == 2
    flat = image[::-1] if grey else image[::-1, :, ::-1]
    flat = flat.reshape(h, -1).astype(np.uint8)
    flat = np.pad(flat, ((0, 0), (0, -flat.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros((0, 4), np.uint8)
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + flat.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, flat.size, 2835, 2835, 256 * grey, 0)
    return head + info + palette.tobytes() + flat.tobytes()


_TOKEN = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    w, h, most = (*numbers, 1)[:3]
    planes = 3 if kind in (3, 6) else 1
    if kind == 1:
        values = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8)[: w * h] - 48
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * planes], dtype=np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        values = np.unpackbits(rows, axis=1)[:, :w].ravel()
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * planes, at + 1)
    if len(values) < w * h * planes:
        raise ValueError("netpbm data")
    if kind in (1, 4):
        values = (1 - values.astype(np.int64)) * 255  # one is black
    elif most != 255:
        values = values.astype(np.int64) * 255 // most
    out = values.astype(np.uint8)
    return out.reshape(h, w) if planes == 1 else out.reshape(h, w, 3)


def _decode_bmp(data: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", data, 10)[0]
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (1, 4, 8, 24, 32):
        raise ValueError("bmp kind")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    if bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(abs(h), -1, bits)
        rows = each @ (1 << np.arange(bits - 1, -1, -1))
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
    image = palette[rows[:, :w]]
    return np.ascontiguousarray(image[:, :, 0]) if (palette == palette[:, :1]).all() else image


def decode(data: bytes) -> np.ndarray:
    """A (height, width) or (height, width, 3) array of bytes."""
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each target box, by an integral image read at fractional places."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), len(table) - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    corners = at(xs, at(ys, total).T).T
    return np.diff(np.diff(corners, axis=0), axis=1) / (h / height * (w / width))


def difference_hash(image: np.ndarray) -> int:
    small = area_resize(image, 8, 9)
    # Sums in another order differ in the last bits; equal boxes are not a step.
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1] + 1e-6).tobytes(), "big")


def tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The area-resized image as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image, side, side)).astype(np.uint8))
    return out.getvalue()


def payload(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """The text's bytes filled with 255 up to a positive multiple of ``unit``, and their number before."""
    raw = text.encode() if text else b""
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), len(raw)


def to_media(data: bytes) -> bytes:
    """Store a payload without loss as colour BMP, PGM or PPM, by a digest of its bytes."""
    samples = np.frombuffer(data, np.uint8)
    kind = zlib.crc32(data) % 3
    if kind == 0:
        return encode_bmp(samples.reshape(-1, 8, 3))
    if kind == 1:
        return encode_ppm(samples.reshape(-1, 8, 3))
    return encode_pgm(samples.reshape(-1, WIDTH))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an image file in a binary column.

    Null and empty texts become one unit of filling. Null ids and repeated rows
    keep their rows; further columns are not read; an empty table stays empty.
    """

    def run(batches):
        for b in stage.slices(batches, "text"):
            made = [payload(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([to_media(p) for p, _ in made], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage.map_batches(rows, run, "doc_id long, n_bytes long, media binary")


def with_tiles(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with the NPY tile of each image.

    Null ids and repeated rows keep their rows; further columns are not read;
    a null or undecodable image is an error; an empty table stays empty.
    """

    def run(batches):
        for b in stage.slices(batches, "media"):
            images = [decode(m) for m in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(map(tile, images), pa.binary())],
                names=[*b.schema.names, "tile"],
            )

    return stage.map_batches(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, media binary, tile binary")


def features(stored: DataFrame) -> DataFrame:
    """Digests of each stored image, its difference hash, and digests of its NPY tile, all of what is read back.

    Takes (doc_id, n_bytes, media, tile); null ids, repeated rows,
    further columns and an empty table are as for :func:`with_tiles`.
    """

    def run(batches):
        for b in stage.slices(batches, "media"):
            rows = []
            for doc_id, n, m, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                image = decode(m)
                data = image.tobytes()
                small = np.load(io.BytesIO(t))
                feature = f"dhash={difference_hash(image):016x};tile={zlib.crc32(small.tobytes()):08x};mean={small.mean():.3f}"
                rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stage.map_batches(stored.select("doc_id", "n_bytes", "media", "tile"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media and NPY tiles are written to the shared folder; all digests are of what is read from there."""
    return features(stage.written(with_tiles(store_media(stage.table(spark, sf_dir, "documents"))), "media"))
