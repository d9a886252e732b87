"""Media columns: Netpbm and BMP images in binary columns.

``decode_image`` reads P1 to P6 and uncompressed BMP into numpy arrays,
``area_resize`` averages exact areas by integral images, ``npy_bytes`` writes a
tile, and ``difference_hash`` compares neighbouring cells of a resized grey
image.  ``encode_payload`` stores any byte string losslessly as an 8-bit RGB
image of fixed width.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, table

#: A payload fills whole rows of 64 RGB pixels.
WIDTH = 64
ROW_BYTES = WIDTH * 3
#: Side of the NPY tiles; values of an image that are summed at once.
TILE, STRIP = 16, 1 << 18

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode_netpbm(raw: bytes) -> np.ndarray:
    """Height x width (PBM, PGM) or height x width x 3 (PPM); PBM bits become 0 (black) and 255."""
    kind = raw[:2]
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(raw, at)
        if not m:
            raise ValueError("truncated Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    maxval = head[2] if len(head) > 2 else 1
    if width < 1 or height < 1 or not 0 < maxval < 65536:
        raise ValueError("Netpbm size or maxval out of range")
    planes = 3 if kind in (b"P3", b"P6") else 1
    here = max(0, len(raw) - at)  # no header may ask for more than the bytes that are there can hold
    least = {b"P4": (width + 7) // 8 * height, b"P1": width * height, b"P2": 2 * width * height - 1, b"P3": 6 * width * height - 1}
    if least.get(kind, width * height * planes * (1 if maxval < 256 else 2)) > here:
        raise ValueError("Netpbm raster is shorter than its header says")
    if kind == b"P4":
        stride = (width + 7) // 8
        bits = np.frombuffer(raw, np.uint8, stride * height, at + 1).reshape(height, stride)
        return (1 - np.unpackbits(bits, axis=1)[:, :width]) * np.uint8(255)
    n = width * height * planes
    if kind == b"P1":
        digits = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", raw[at:]), np.uint8)[:n] - 48
        if len(digits) < n:
            raise ValueError("truncated PBM raster")
        return ((1 - digits) * 255).astype(np.uint8).reshape(height, width)
    if kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*\n", b" ", raw[at:]).split()[:n], dtype=np.int64)
        if len(values) < n:
            raise ValueError("truncated raster")
        values = values.astype(np.uint8 if maxval < 256 else np.uint16)
    elif kind in (b"P5", b"P6"):
        values = np.frombuffer(raw, np.uint8 if maxval < 256 else ">u2", n, at + 1)
    else:
        raise ValueError(f"not Netpbm: {kind!r}")
    return values.reshape((height, width, 3) if planes == 3 else (height, width))


def decode_bmp(raw: bytes) -> np.ndarray:
    """Height x width x 3, RGB; 1, 4 and 8 bits by palette, 24 and 32 bits direct, no compression."""
    offset, size = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<I", raw, 14)[0]
    if size < 40:
        raise ValueError("BMP header version not read")
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", raw, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("BMP compression or depth not read")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if width < 1 or rows < 1 or stride * rows > len(raw) - offset:
        raise ValueError("BMP raster is shorter than its header says")
    grid = np.frombuffer(raw, np.uint8, stride * rows, offset).reshape(rows, stride)
    if height > 0:
        grid = grid[::-1]
    if bits >= 24:
        step = bits // 8
        return np.ascontiguousarray(grid[:, : width * step].reshape(rows, width, step)[:, :, 2::-1])
    colours = min(struct.unpack_from("<I", raw, 46)[0] or 1 << bits, 1 << bits)
    palette = np.frombuffer(raw, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = grid
    else:
        spread = np.unpackbits(grid, axis=1).reshape(rows, -1, bits)
        index = (spread * (1 << np.arange(bits - 1, -1, -1))).sum(2)
    return palette[index[:, :width]]


def decode_image(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def encode_ppm(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, bottom row first."""
    height, width, _ = pixels.shape
    stride = (width * 3 + 3) // 4 * 4
    grid = np.zeros((height, stride), np.uint8)
    grid[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + grid.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, grid.size, 2835, 2835, 0, 0)
    return head + grid.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area (fractions of pixels count), as float64.

    The integral image is interpolated linearly at the cells' edges.  Only its
    rows at those edges are held, and pixels are read in strips, so that no
    image needs many times its own memory.
    """
    if image.shape[1] > image.shape[0]:
        return area_resize(image.swapaxes(0, 1), width, height).swapaxes(0, 1)
    x = image[:, :, None] if image.ndim == 2 else image
    h, w, planes = x.shape
    edges = np.arange(height + 1) * (h / height)
    low = np.minimum(edges.astype(np.int64), h - 1)
    part = (edges - low)[:, None, None]
    rows, above = np.empty((height + 1, w, planes)), np.zeros((1, w, planes))
    strip = max(1, STRIP // (w * planes))
    for a in range(0, h, strip):
        pixels = x[a : a + strip].astype(np.float64)
        sums = np.concatenate([above, above + np.cumsum(pixels, 0)])
        own = np.flatnonzero((low >= a) & (low < a + len(pixels)))
        rows[own] = sums[low[own] - a] + pixels[low[own] - a] * part[own]
        above = sums[-1:]
    total = np.concatenate([np.zeros((height + 1, 1, planes)), np.cumsum(rows, 1)], 1)
    edges = np.arange(width + 1) * (w / width)
    low = np.minimum(edges.astype(np.int64), w - 1)
    part = (edges - low)[None, :, None]
    cells = total[:, low] * (1 - part) + total[:, low + 1] * part
    out = (cells[1:, 1:] - cells[:-1, 1:] - cells[1:, :-1] + cells[:-1, :-1]) / ((h / height) * (w / width))
    return out[:, :, 0] if image.ndim == 2 else out


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each of 8 x 8 grey cells is darker than its right neighbour."""
    small = area_resize(image, 8, 9)  # grey is linear in the colours: the mean of the grey is the grey of the mean
    small = np.round(small if image.ndim == 2 else small @ np.array([0.299, 0.587, 0.114]), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with spaces to a positive multiple of ROW_BYTES, and the length before padding."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b" "), len(raw)


def store_texts(docs: DataFrame, form: str = "ppm") -> DataFrame:
    """doc_id, n_bytes and media: each text's payload as an image of 64 RGB pixels a row.

    A null text is stored as the empty text (one row of spaces).  Repeated rows
    and null ids stay as they are; other columns are left out.  ``form`` is ``ppm`` or ``bmp``.
    """
    small_batches(docs.sparkSession)
    encode = {"ppm": encode_ppm, "bmp": encode_bmp}[form]

    def work(batches):
        for b in batches:
            media, sizes = [], []
            for text in b.column(1):
                payload, n = payload_of(text.as_py())
                media.append(encode(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(work), "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, tile: int = TILE) -> DataFrame:
    """For each row of doc_id, n_bytes, media: digests of the pixels read back, a tile and a difference hash.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last
    16 payload bytes), media_bytes, media_sha256, height, width, tile (NPY file of
    uint8, tile x tile [x 3]), feature.  A null or unreadable image (one whose header
    asks for more pixels than there are bytes for is) gives null
    features with its own sizes and digest (null for null).
    """
    small_batches(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "height", "width", "tile", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def features(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 9
        stored = (len(raw), hashlib.sha256(raw).hexdigest())
        try:
            image = decode_image(raw)
        except (ValueError, struct.error, IndexError, OverflowError):
            return None, None, None, *stored, None, None, None, None
        payload = image.tobytes()
        small = np.clip(np.rint(area_resize(image, tile, tile)), 0, 255).astype(np.uint8)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, *image.shape[:2], npy_bytes(small), difference_hash(image))

    def work(batches):
        for b in batches:
            rows = [features(x.as_py()) for x in b.column(2)]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), types[2:])] if rows else [pa.array([], t) for t in types[2:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, tile binary, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(released(work), schema)


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    found = media_features(store_texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"))
