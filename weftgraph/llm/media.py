"""Media columns: Netpbm and BMP decoding, area resizing, NPY tiles, difference hashes.

``decode`` turns the bytes of a Netpbm (P1 to P6) or uncompressed BMP image into
a numpy array; ``area_sums`` resizes by an integral image in exact integer
arithmetic; ``npy_bytes`` writes the tile; ``difference_hash`` compares
neighbouring cells. ``store_payloads`` and ``read_payloads`` keep arbitrary bytes
as samples of a PGM image and read them back.

Samples are scaled to the full range of a byte, or of two where maxval exceeds 255, before features are taken.

Defined results: a null medium and one that cannot be decoded (cut short, sizes or palette places out of
range, numbers too large) give null features and an ``error`` text; a null or empty text is stored as one row of 64 zero samples;
equal inputs give equal values; other columns pass by untouched.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import materialize, table

ROW_SAMPLES = 64
TILE = 16

_NETPBM_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A two-dimensional uint8 array as binary PGM (P5)."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def _netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """Samples and the greatest possible one."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    place, header = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _NETPBM_TOKEN.match(data, place)
        if not found:
            raise ValueError("short Netpbm header")
        if not found[1].isdigit() or len(found[1]) > 9:
            raise ValueError("bad Netpbm header")
        header.append(int(found[1]))
        place = found.end()
    width, height, top = header[0], header[1], header[2] if len(header) == 3 else 1
    if width <= 0 or height <= 0 or not 0 < top < 65536:
        raise ValueError("bad Netpbm header")
    planes = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * planes
    # A sample takes a bit at least, so nothing is set aside for a size that the data cannot have.
    if count > 8 * len(data):
        raise ValueError("short Netpbm raster")
    kind_of = np.uint8 if top < 256 else np.uint16
    if kind == b"P1":
        bits = re.sub(rb"#[^\r\n]*|\s", b"", data[place:])
        if bits[:count].strip(b"01"):
            raise ValueError("bad Netpbm sample")
        values = 1 - (np.frombuffer(bits, np.uint8)[:count] - ord("0"))
    elif kind in (b"P2", b"P3"):
        found = re.sub(rb"#[^\r\n]*", b"", data[place:]).split()[:count]
        if any(not x.isdigit() or len(x) > 5 for x in found):
            raise ValueError("bad Netpbm sample")
        values = np.array(found, dtype=np.int64)
    elif kind == b"P4":
        stride = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, stride * height, place + 1).reshape(height, stride)
        values = 1 - np.unpackbits(packed, axis=1)[:, :width].reshape(-1)
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, place + 1).astype(kind_of, copy=False)
    if len(values) != count:
        raise ValueError("short Netpbm raster")
    if values.max(initial=0) > top:
        raise ValueError("sample over maxval")
    return values.astype(kind_of, copy=False).reshape((height, width, 3) if planes == 3 else (height, width)), top


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (h, w) or (h, w, 3); uint8, or uint16 where maxval exceeds 255.

    Bitmaps give 0 for black and 1 for white.
    """
    return _netpbm(data)[0]


def encode_bmp(samples: np.ndarray) -> bytes:
    """A uint8 array as BMP: (h, w) with a grey palette, (h, w, 3) as 24 bits."""
    height, width = samples.shape[:2]
    grey = samples.ndim == 2
    rows = samples[::-1] if grey else samples[::-1, :, ::-1].reshape(height, width * 3)
    stride = -(-rows.shape[1] // 4) * 4
    raster = np.zeros((height, stride), np.uint8)
    raster[:, : rows.shape[1]] = rows
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros(0, np.uint8)
    start = 54 + palette.nbytes
    head = struct.pack("<2sIHHI", b"BM", start + raster.nbytes, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, raster.nbytes, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette.tobytes() + raster.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (h, w) for grey palettes, else (h, w, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    start, size, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing != 0 or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    upward, height = height > 0, abs(height)
    stride = (width * bits + 31) // 32 * 4
    if start + stride * height > len(data):
        raise ValueError("short BMP raster")
    raster = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    if upward:
        raster = raster[::-1]
    if bits >= 24:
        return raster[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    if 14 + size + 4 * used > len(data):
        raise ValueError("short BMP palette")
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    if bits == 8:
        index = raster[:, :width]
    else:
        unpacked = np.unpackbits(raster, axis=1).reshape(height, -1, bits)
        index = (unpacked @ (1 << np.arange(bits - 1, -1, -1)))[:, :width]
    if index.max(initial=0) >= used:
        raise ValueError("place beyond the BMP palette")
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][index] if grey else palette[index]


def decode(data: bytes) -> np.ndarray:
    """Netpbm or BMP, told apart by their first bytes."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def full_range(data: bytes) -> np.ndarray:
    """The decoded image with its samples scaled to 0 to 255, or to 65535 where maxval exceeds 255, rounded half up."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    image, top = _netpbm(data)
    full = 255 if top < 256 else 65535
    return image if top == full else (2 * image.astype(np.int64) * full + top) // (2 * top)


def grey_of(image: np.ndarray) -> np.ndarray:
    """Integer luma of a colour image, a grey one as it is."""
    if image.ndim == 2:
        return image.astype(np.int64)
    return (image.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000


def _edges(integral: np.ndarray, cells: int) -> np.ndarray:
    """Rows of an integral image at the cell borders k * size / cells, times cells: linear between rows, in integers."""
    size = integral.shape[0] - 1
    border = np.arange(cells + 1) * size
    low, part = border // cells, border % cells
    high = np.minimum(low + 1, size)
    return integral[low] * (cells - part)[:, None] + integral[high] * part[:, None]


def area_sums(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area resize: sums of the samples under each target cell, times height * width, exact.

    Every cell covers the same area, so the mean is the sum divided by the number of samples.
    """
    integral = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    np.cumsum(grey, axis=0, out=integral[1:, 1:])
    np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])
    across = _edges(np.ascontiguousarray(_edges(integral, height).T), width).T
    return np.diff(np.diff(across, axis=0), axis=1)


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the samples under each target cell, rounded half up."""
    samples = grey.shape[0] * grey.shape[1]
    return (2 * area_sums(grey, height, width) + samples) // (2 * samples)


def npy_bytes(tile: np.ndarray) -> bytes:
    """The array in NPY format."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), allow_pickle=False)
    return out.getvalue()


def difference_hash(grey: np.ndarray) -> str:
    """64 bits as hex: is a cell of the 8 x 9 resize darker than its right neighbour?"""
    cells = area_sums(grey, 8, 9)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def features(media: bytes, tile: int = TILE) -> tuple[bytes, str]:
    """NPY tile and difference hash of an image."""
    grey = grey_of(full_range(media))
    small = area_resize(grey, tile, tile)
    return npy_bytes(small.astype(np.uint8 if small.max(initial=0) < 256 else np.uint16)), difference_hash(grey)


def _binaries(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def media_tiles(df: DataFrame, media: str = "media", tile: int = TILE) -> DataFrame:
    """df with tile (NPY bytes), dhash and error for a column of Netpbm or BMP bytes. One pass, no shuffle."""
    if clash := {"tile", "dhash", "error"} & set(df.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data in _binaries(batch.column(media)):
                try:
                    out.append((*features(data, tile), None) if data is not None else (None, None, "null"))
                except (ValueError, IndexError, OverflowError, struct.error) as problem:
                    out.append((None, None, str(problem) or type(problem).__name__))
            extra = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "tile", "dhash", "error"])

    schema = T.StructType([*df.schema.fields]).add("tile", "binary").add("dhash", "string").add("error", "string")
    return df.mapInArrow(run, schema)


def store_payloads(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as PGM rows of 64 samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, media = [], []
            for data in _binaries(batch.column(1)):
                data = data or b""
                rows = max(1, -(-len(data) // ROW_SAMPLES))
                lengths.append(len(data))
                media.append(encode_pgm(np.frombuffer(data.ljust(rows * ROW_SAMPLES, b"\0"), np.uint8).reshape(rows, ROW_SAMPLES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def read_payloads(stored: DataFrame, key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """Digests, features and NPY tiles of the payloads that the stored media decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media in _binaries(batch.column(2)):
                image = decode(media)
                payload = image.tobytes()
                grey = grey_of(image)
                small = npy_bytes(area_resize(grey, tile, tile).astype(np.uint8))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(grey), small))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            extra = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *extra], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])

    kind = stored.schema[key].dataType.simpleString()
    return stored.select(key, "n_bytes", "media").mapInArrow(
        run,
        f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, tile binary",
    )


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as PGM in a Parquet media column, read back with digests, NPY tile and difference hash."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_payloads(materialize(store_payloads(documents), "media"))
