"""Image files: round trip, bit planes, colour, comments and files that aren't images."""

from __future__ import annotations

import numpy as np

from folioframe.sources import images


def test_decode():
    a = np.random.default_rng(1).integers(0, 256, (5, 7), np.uint8)
    assert images.decode(images.encode(7, 5, a.tobytes())) == (7, 5, a.tobytes())
    assert images.decode(b"P4\n# two rows\n3 2\n" + bytes([0b10100000, 0b01000000])) == (3, 2, bytes([0, 255, 0, 255, 0, 255]))
    assert images.decode(b"P6 1 1 255\n" + bytes([32, 64, 96])) == (1, 1, bytes([(11 * 32 + 16 * 64 + 5 * 96) >> 5]))
    assert images.decode(b"P5 4 4 255\n123") is None and images.decode(b"text") is None and images.decode(b"") is None


def test_read(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(images.encode(2, 1, b"\x01\x02"))
    (tmp_path / "b.txt").write_bytes(b"no image")
    rows = {r["path"][-5:]: r for r in images.read(spark, str(tmp_path)).collect()}
    assert (rows["a.pgm"]["status"], bytes(rows["a.pgm"]["data"])) == ("loaded", b"\x01\x02")
    assert (rows["b.txt"]["status"], rows["b.txt"]["data"]) == ("unrecognised", None)
