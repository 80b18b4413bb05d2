"""Media columns: Netpbm and BMP images as arrays, resized by area, hashed, and written as NPY tiles.

Formats: PGM and PPM (P2, P3, P5, P6; 8 bits) and uncompressed BMP of 8 or 24 bits a pixel. Resizing
takes the exact area mean of each target cell from an integral image, so any source shape maps to
any target shape. The difference hash compares neighbours in a 9 x 8 reduction.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .workspace import whole

TILE = 64


def encode_pgm(image: np.ndarray) -> bytes:
    """A binary PGM of an 8-bit image (height, width)."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """An uncompressed BMP: 8 bits with a grey palette, or 24 bits (height, width, 3 as RGB)."""
    h, w = image.shape[:2]
    bits = 8 if image.ndim == 2 else 24
    rows = image[::-1] if bits == 8 else image[::-1, :, ::-1].reshape(h, w * 3)
    pad = -rows.shape[1] % 4
    body = np.pad(rows, ((0, 0), (0, pad))).astype(np.uint8).tobytes()
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if bits == 8 else b""
    start = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(body), 2835, 2835, len(palette) // 4, 0) + palette + body


def decode(data: bytes | None) -> np.ndarray | None:
    """Image bytes -> uint8 array, (height, width) or (height, width, 3); None if they are no whole
    image of a known format; samples above the format's or the header's largest are not."""
    try:
        if data and data[:2] == b"BM":
            return _decode_bmp(data)
        if data and data[:2] in (b"P2", b"P3", b"P5", b"P6"):
            return _decode_netpbm(data)
    except (ValueError, IndexError, OverflowError, struct.error):
        pass
    return None


def _decode_netpbm(data: bytes) -> np.ndarray:
    at, fields = 2, []
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, most = fields
    depth = 3 if data[:2] in (b"P3", b"P6") else 1
    if not 0 < most < 256:
        raise ValueError("only samples of 8 bits")
    if data[:2] in (b"P5", b"P6"):
        samples = np.frombuffer(data, np.uint8, w * h * depth, at + 1)
    else:
        words = data[at:].split()[: w * h * depth]
        if not all(x.isdigit() and len(x) < 10 for x in words):
            raise ValueError("a sample is no number")
        samples = np.array([int(x) for x in words], np.int64)
    if samples.size and int(samples.max()) > most:
        raise ValueError("a sample is above the largest")
    samples = samples.astype(np.uint8)
    shape = (h, w) if depth == 1 else (h, w, 3)
    return samples.reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", data, 10)[0]
    head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24):
        raise ValueError("only plain BMP of 8 or 24 bits")
    line = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 24:
        return rows.reshape(abs(h), w, 3)[:, :, ::-1].copy()
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][rows]
    return palette[rows]


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means (float64) of a grey image over a height x width grid, fractional edges included."""
    h, w = image.shape

    def integral_at(sums: np.ndarray, edges: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), len(sums) - 2)
        part = edges - low
        return sums[low] + (sums[low + 1] - sums[low]) * part[:, None]

    # integral image, first over whole rows at the wanted edges, then over columns
    rows = np.zeros((h + 1, w), np.float64)
    np.cumsum(image, axis=0, dtype=np.float64, out=rows[1:])
    band = np.diff(integral_at(rows, np.arange(height + 1) * h / height), axis=0)
    columns = np.zeros((w + 1, height), np.float64)
    np.cumsum(band.T, axis=0, out=columns[1:])
    cells = np.diff(integral_at(columns, np.arange(width + 1) * w / width), axis=0).T
    return cells * (height * width) / (h * w)


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as 16 hex digits: is each cell of a 9 x 8 reduction darker than its right neighbour."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(images: DataFrame, key: str, column: str, height: int = TILE, width: int = TILE) -> DataFrame:
    """Every row's image as a NPY tile.

    Returns key, height long, width long, channels long, tile binary (NPY, uint8, area-resized to
    grey height x width) and dhash string. Images that are null, empty, cut short or of an
    unknown format give nulls but keep their row; so do images without pixels. Other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data in batch.column(1):
                image = decode(data.as_py())
                if image is None or not image.size:
                    out.append((None,) * 5)
                    continue
                tile = np.clip(np.rint(area_resize(grey(image), height, width)), 0, 255).astype(np.uint8)
                out.append((image.shape[0], image.shape[1], 1 if image.ndim == 2 else 3, npy(tile), difference_hash(image)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[key, "height", "width", "channels", "tile", "dhash"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, whole(images, column, "binary").alias("image")).mapInArrow(run, f"{key} {kind}, height long, width long, channels long, tile binary, dhash string")


def texts_as_images(docs: DataFrame, width: int = TILE) -> DataFrame:
    """Every whole text as a PGM of ``width`` columns, one byte a pixel, and what is read back.

    The text's UTF-8 bytes (null: none) are filled with zero bytes to a positive multiple of
    ``width``. Returns doc_id long, n_bytes long, payload_bytes long, payload_sha256 string,
    tail_crc32 long (last ``width`` bytes), media_bytes long, media_sha256 string, feature string
    (difference hash and the sum of a 64 x 64 NPY tile's CRC-32), all but n_bytes from the stored
    form as decoded. Repeated rows come back as often; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = value.as_buffer() if value.is_valid else None
                n = raw.size if raw is not None else 0
                pixels = np.zeros(max(width, -(-n // width) * width), np.uint8)
                if n:
                    pixels[:n] = np.frombuffer(raw, np.uint8)
                stored = encode_pgm(pixels.reshape(-1, width))
                image = decode(stored)
                payload = image.tobytes()
                tile = np.clip(np.rint(area_resize(image, TILE, TILE)), 0, 255).astype(np.uint8)
                feature = f"{difference_hash(image)}-{zlib.crc32(npy(tile)):08x}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-width:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds[1:], strict=True))], names=names)

    return docs.select(whole(docs, "doc_id", "long").alias("doc_id"), whole(docs, "text", "string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
