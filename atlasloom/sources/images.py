"""Uploads and images as tables: multipart bodies, PNG rasters, sizes and focal lengths from headers.

JPEG pixels need a codec that Spark does not bring; their sizes and tags are read, their rasters arrive decoded.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by PNG colour type (fixed values).
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
FOCAL_35MM, FOCAL, ORIENTATION = 0xA405, 0x920A, 0x0112
EXIF_DIRECTORY, PLANE_RESOLUTION, PLANE_UNIT = 0x8769, 0xA20E, 0xA210
#: Diagonal of a full frame in millimetres, millimetres of a resolution unit, plausible fields of view in degrees (fixed values).
FULL_FRAME_DIAGONAL = 43.27
UNIT_MM = {2: 25.4, 3: 10.0, 4: 1.0, 5: 0.001}
LEAST_VIEW, MOST_VIEW = 10.0, 150.0


def chunks(data: bytes):
    """(kind, content) of each chunk; raises on a wrong checksum or a short file."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind.decode('latin1')} chunk")
        yield kind.decode("latin1"), body
        at += 12 + n


def decode_png(data: bytes) -> np.ndarray:
    """Raster of rows, columns and channels (none for one), 8 or 16 bits."""
    parts = list(chunks(data))
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if bits not in (8, 16) or colour not in CHANNELS or interlaced:
        raise ValueError("unsupported PNG layout")
    step = CHANNELS[colour] * bits // 8
    lines = np.frombuffer(zlib.decompress(b"".join(b for k, b in parts if k == "IDAT")), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width * step), np.uint8)
    for k in range(height):
        out[k + 1] = _unfiltered(int(lines[k, 0]), lines[k, 1:], out[k], step)
    samples = out[1:].view(">u2").astype(np.uint16) if bits == 16 else out[1:]
    return samples.reshape((height, width) if CHANNELS[colour] == 1 else (height, width, CHANNELS[colour]))


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line without its prediction: none, left, above, their mean, or the nearest of three neighbours."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step).astype(np.int64), axis=0).astype(np.uint8).ravel()
    if kind == 2:
        return line + above
    out, up = line.astype(np.int64), above.astype(np.int64)
    for k in range(len(out)):
        a, b, c = (out[k - step], up[k], up[k - step]) if k >= step else (0, up[k], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k] = (out[k] + guess) & 255
    return out.astype(np.uint8)


def encode_png(raster: np.ndarray, texts: dict[str, str] | None = None) -> bytes:
    """Lossless PNG of an 8- or 16-bit raster, with text chunks."""
    height, width = raster.shape[:2]
    channels = 1 if raster.ndim == 2 else raster.shape[2]
    colour = next(c for c, n in CHANNELS.items() if n == channels)
    bits = 8 * raster.dtype.itemsize
    rows = np.ascontiguousarray(raster.astype(">u2") if bits == 16 else raster).view(np.uint8).reshape(height, -1)
    body = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    make = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    notes = [make(b"tEXt", k.encode("latin1") + b"\0" + v.encode("latin1")) for k, v in (texts or {}).items()]
    return b"".join([SIGNATURE, make(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)), *notes, make(b"IDAT", zlib.compress(body)), make(b"IEND", b"")])


def _segments(data: bytes):
    """(kind, start, end) of a JPEG's segments before its pixels; `start` is where the segment's length stands."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        n = struct.unpack_from(">H", data, at + 2)[0]
        yield data[at + 1], at + 2, at + 2 + n
        at += 2 + n


def size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG or JPEG, wherever it lies; None where they are not there."""
    if head[:8] == SIGNATURE:
        return struct.unpack_from(">II", head, 16) if len(head) >= 24 else None
    if head[:2] != b"\xff\xd8":
        return None
    for kind, at, _ in _segments(head):
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and at + 7 <= len(head):
            h, w = struct.unpack_from(">HH", head, at + 3)
            return w, h
    return None


def _tiff(data: bytes) -> bytes:
    """The EXIF block of a JPEG or PNG, empty where it is absent."""
    if data[:2] == b"\xff\xd8":
        return next((data[at + 8 : end] for kind, at, end in _segments(data) if kind == 0xE1 and data[at + 2 : at + 8] == b"Exif\0\0"), b"")
    at = 8 if data[:8] == SIGNATURE else len(data)
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"eXIf":
            return data[at + 8 : at + 8 + n]
        at += 12 + n
    return b""


def upright_size(data: bytes) -> tuple[int, int] | None:
    """Width and height after the EXIF orientation."""
    found, tiff = size(data), _tiff(data)
    try:
        order = "<" if tiff[:2] == b"II" else ">"
        turned = _tags(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order).get(ORIENTATION)
    except struct.error:
        turned = None
    return found[::-1] if found and turned in (5, 6, 7, 8) else found


def _tags(tiff: bytes, at: int, order: str) -> dict[int, float]:
    """Numbers of a tag directory: shorts, longs, and rationals as quotients (null where they divide by zero)."""
    out = {}
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        tag, kind, _ = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        value = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, at + 10 + 12 * k)[0]
        if kind in (5, 10):
            over, under = struct.unpack_from(order + ("II" if kind == 5 else "ii"), tiff, value)
            value = over / under if under else 0
        out[tag] = value
    return out


def camera_tags(data: bytes) -> dict[int, float]:
    """Tags of the EXIF directory over those of the first directory; empty where there are none."""
    tiff = _tiff(data)
    order = "<" if tiff[:2] == b"II" else ">"
    try:
        found = _tags(tiff, int(struct.unpack_from(order + "I", tiff, 4)[0]), order)
        return found | (_tags(tiff, int(found[EXIF_DIRECTORY]), order) if found.get(EXIF_DIRECTORY) else {})
    except struct.error:
        return {}


def focal_pixels(data: bytes) -> float | None:
    """Focal length in pixels: from the 35 mm equivalent by the diagonal, else from the focal length and the sensor's resolution where the field of view is plausible."""
    found = size(data)
    if not found:
        return None
    tags = camera_tags(data)
    if tags.get(FOCAL_35MM, 0) > 0:
        return tags[FOCAL_35MM] * math.hypot(*found) / FULL_FRAME_DIAGONAL
    mm, resolution, unit = tags.get(FOCAL, 0), tags.get(PLANE_RESOLUTION, 0), UNIT_MM.get(int(tags.get(PLANE_UNIT, 2) or 2))
    if mm > 0 and resolution > 0 and unit:
        pixels = mm * resolution / unit
        view = 2 * math.degrees(math.atan(found[0] / (2 * pixels)))
        return pixels if LEAST_VIEW <= view <= MOST_VIEW else None
    return None


def multipart(content_type: str, body: bytes, most: int = 512 << 20) -> dict[str, bytes]:
    """Named parts of a multipart upload."""
    if len(body) > most:
        raise ValueError(f"body of more than {most} bytes")
    found = [p.split("=", 1)[1].strip('" ') for p in content_type.split(";") if p.strip().startswith("boundary=")]
    if not content_type.startswith("multipart/form-data") or not found:
        raise ValueError("not a multipart upload")
    parts: dict[str, bytes] = {}
    for piece in (b"\r\n" + body).split(b"\r\n--" + found[0].encode())[1:]:
        if piece.startswith(b"--"):
            return parts
        head, _, content = piece.partition(b"\r\n\r\n")
        names = [x.split(b"=", 1)[1].strip(b'" ') for line in head.split(b"\r\n") if line.lower().startswith(b"content-disposition") for x in line.split(b";") if x.strip().startswith(b"name=")]
        if len(names) != 1:
            raise ValueError("a part without a name")
        parts[names[0].decode()] = content
    raise ValueError("no closing boundary")


def _depths(scale: float, stride: int):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raster = decode_png(content.as_py())
                rows, cols = (np.arange(stride // 2, n, stride) for n in raster.shape[:2])
                z = raster[np.ix_(rows, cols)].astype(np.float64) * scale
                r, c = np.meshgrid(rows, cols, indexing="ij")
                yield pa.RecordBatch.from_arrays([pa.array([path] * z.size), pa.array(r.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(z.ravel(), mask=z.ravel() == 0)], names=["path", "row", "col", "z"])

    return run


def depths(spark: SparkSession, path: str, scale: float = 0.001, stride: int = 1) -> DataFrame:
    """Depth samples of 16-bit PNG files in long form, every `stride`-th pixel at its block's centre; 0 is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")
    return files.mapInArrow(_depths(scale, stride), "path string, row int, col int, z double")


def _heads():
    def run(batches):
        for batch in batches:
            found, focal = [], []
            for c in batch.column(1):
                content = c.as_py()
                found.append(upright_size(content))
                focal.append(focal_pixels(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] if f else None for f in found], pa.int32()), pa.array([f[1] if f else None for f in found], pa.int32()), pa.array(focal, pa.float64())], names=["path", "width", "height", "focal_px"])

    return run


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Upright sizes and focal lengths in pixels of images, from headers wherever they lie, without decoding a pixel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(path).select("path", "content")
    return files.mapInArrow(_heads(), "path string, width int, height int, focal_px double")
