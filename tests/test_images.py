"""PNG rasters, headers, uploads."""

import struct
import zlib

import numpy as np
import pytest

from atlasloom.sources import images


def filtered(raster, kind):
    """A PNG whose lines all use one prediction, written plainly."""
    step = raster.dtype.itemsize * (1 if raster.ndim == 2 else raster.shape[2])
    rows = np.ascontiguousarray(raster.astype(">u2") if raster.dtype == np.uint16 else raster).view(np.uint8).reshape(len(raster), -1).astype(int)
    body = b""
    for r in range(len(rows)):
        line = []
        for k in range(rows.shape[1]):
            a = rows[r, k - step] if k >= step else 0
            b = rows[r - 1, k] if r else 0
            c = rows[r - 1, k - step] if r and k >= step else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((rows[r, k] - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        body += bytes([kind, *line])
    data = images.encode_png(raster)
    old = dict(images.chunks(data))["IDAT"]
    new = zlib.compress(body)
    at = data.index(b"IDAT") - 4
    chunk = struct.pack(">I", len(new)) + b"IDAT" + new + struct.pack(">I", zlib.crc32(b"IDAT" + new))
    return data[:at] + chunk + data[at + 12 + len(old) :]


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize(("shape", "dtype"), [((5, 7), np.uint16), ((4, 6, 3), np.uint8), ((3, 3, 4), np.uint8), ((1, 1), np.uint8)])
def test_png(kind, shape, dtype):
    raster = np.random.default_rng(1).integers(0, np.iinfo(dtype).max + 1, shape).astype(dtype)
    assert (images.decode_png(filtered(raster, kind)) == raster).all()


def test_damaged_png():
    data = bytearray(images.encode_png(np.zeros((2, 2), np.uint8), {"note": "x"}))
    data[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        images.decode_png(bytes(data))


def test_depth_scan(spark, tmp_path):
    raster = np.arange(16, dtype=np.uint16).reshape(4, 4) * 100
    (tmp_path / "d.png").write_bytes(images.encode_png(raster))
    rows = images.depths(spark, str(tmp_path), 0.001)
    assert rows.count() == 16 and rows.where("z IS NULL").count() == 1 and rows.where("row = 3 AND col = 3").first().z == 1.5
    assert {(r.row, r.col) for r in images.depths(spark, str(tmp_path), stride=2).collect()} == {(1, 1), (1, 3), (3, 1), (3, 3)}
    head = images.headers(spark, str(tmp_path)).first()
    assert (head.width, head.height, head.focal_px) == (4, 4, None)


def test_jpeg_header():
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<HHHII", 1, 0x8769, 4, 1, 26) + b"\0\0\0\0" + struct.pack("<HHHIHH", 1, images.FOCAL_35MM, 3, 1, 28, 0) + b"\0\0\0\0"
    app = b"Exif\0\0" + tiff
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 480, 720) + b"\3" * 10
    assert images.size(data) == (720, 480)
    assert images.focal_pixels(data) == pytest.approx(28 * (720**2 + 480**2) ** 0.5 / 43.27)
    assert images.size(b"GIF89a") is None and images.focal_pixels(data[:20]) is None


@pytest.mark.parametrize(("resolution", "unit", "want"), [(4000, 2, 5.0 * 4000 / 25.4), (400, 3, 5.0 * 400 / 10), (1, 2, None), (0, 2, None), (4000, 9, None)])
def test_focal_from_the_sensor(resolution, unit, want):
    head = b"II*\0\x08\0\0\0" + struct.pack("<HHHII", 1, images.EXIF_DIRECTORY, 4, 1, 26) + b"\0\0\0\0"
    tags = struct.pack("<H", 3) + struct.pack("<HHII", images.FOCAL, 5, 1, 68) + struct.pack("<HHII", images.PLANE_RESOLUTION, 5, 1, 76) + struct.pack("<HHIHH", images.PLANE_UNIT, 3, 1, unit, 0) + b"\0\0\0\0"
    app = b"Exif\0\0" + head + tags + struct.pack("<IIII", 50, 10, resolution, 1)
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 480, 720) + b"\3" * 10
    assert images.focal_pixels(data) == (None if want is None else pytest.approx(want))


def test_multipart():
    body = b'--B\r\nContent-Disposition: form-data; name="request"\r\n\r\n{"a": 1}\r\n--B\r\nContent-Disposition: form-data; name="f1"; filename="x"\r\nContent-Type: image/png\r\n\r\n\x00\r\n\x01\r\n--B--\r\n'
    assert images.multipart("multipart/form-data; boundary=B", body) == {"request": b'{"a": 1}', "f1": b"\x00\r\n\x01"}
    for kind, data in (("text/plain", body), ("multipart/form-data; boundary=B", body[:-8]), ("multipart/form-data; boundary=B", b"--B\r\n\r\nx\r\n--B--")):
        with pytest.raises(ValueError):
            images.multipart(kind, data)


@pytest.mark.parametrize(("orientation", "want"), [(1, (720, 480)), (6, (480, 720))])
def test_late_and_turned_header(spark, tmp_path, orientation, want):
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<HHHIHH", 2, images.ORIENTATION, 3, 1, orientation, 0) + struct.pack("<HHII", 0x8769, 4, 1, 38) + b"\0\0\0\0" + struct.pack("<HHHIHH", 1, images.FOCAL_35MM, 3, 1, 28, 0) + b"\0\0\0\0"
    app = b"Exif\0\0" + tiff
    profile = b"\xff\xe2" + struct.pack(">H", 60_002) + b"p" * 60_000
    data = b"\xff\xd8" + profile * 3 + b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 480, 720) + b"\3" * 10
    (tmp_path / "late.jpg").write_bytes(data)
    head = images.headers(spark, str(tmp_path)).first()
    assert (head.width, head.height) == want and head.focal_px == pytest.approx(28 * (720**2 + 480**2) ** 0.5 / 43.27)
