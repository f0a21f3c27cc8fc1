"""Image files without an image library: PNG, TIFF, PDF and PNM in and out, and headers of JPEG and JPEG 2000.

``metadata`` reads headers alone and decodes no pixel; ``decode`` gives gray
pages.  Both return None for what they don't know or what is cut short, and
never raise on file content.  Of TIFF the codecs none, PackBits, LZW, Deflate and
fax (T.6) are written, and T.4 and JPEG read as well; gray, bitonal,
palette, RGB and CMYK, of 1 to 16 bits, in strips or tiles.  Of PDF, images
stored raw, by Flate, LZW, fax or JPEG are read.  JPEG is read where it
is Huffman-coded, of 8 bits and one or three planes; of JPEG 2000 only the header.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from folioframe.sources import codecs


@dataclass(frozen=True)
class Meta:
    """Kind of a file and size and resolution of one of its pages."""

    kind: str
    page: int
    width: int
    height: int
    dpi_x: int = 0
    dpi_y: int = 0


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luminance in integers: weights 11, 16 and 5 of 32."""
    c = rgb.astype(np.int32)
    return ((11 * c[..., 0] + 16 * c[..., 1] + 5 * c[..., 2]) >> 5).astype(np.uint8)


def is_bitonal(a: np.ndarray) -> bool:
    return bool(((a == 0) | (a == 255)).all())


# --- PNG --------------------------------------------------------------------------------------------------------

_PNG = b"\x89PNG\r\n\x1a\n"


def _chunks(content: bytes) -> dict[bytes, list[bytes]]:
    out: dict[bytes, list[bytes]] = {}
    at = 8
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        if at + 12 + size > len(content):
            break
        out.setdefault(kind, []).append(content[at + 8 : at + 8 + size])
        at += 12 + size
    return out


def _png_meta(content: bytes) -> list[Meta] | None:
    if len(content) < 33 or content[12:16] != b"IHDR":
        return None
    w, h = struct.unpack(">II", content[16:24])
    at = content.find(b"pHYs", 33)
    x = y = 0
    if 0 < at < len(content) - 13:
        px, py, unit = struct.unpack(">IIB", content[at + 4 : at + 13])
        x, y = (round(px * 0.0254), round(py * 0.0254)) if unit == 1 else (0, 0)
    return [Meta("png", 0, w, h, x, y)]


def _png(content: bytes) -> np.ndarray | None:
    c = _chunks(content)
    if b"IHDR" not in c or b"IDAT" not in c:
        return None
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", c[b"IHDR"][0])
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
    if interlace or not planes or not w or not h:
        return None
    raw = zlib.decompress(b"".join(c[b"IDAT"]))
    row, step = (w * planes * depth + 7) // 8, max(1, planes * depth // 8)
    if len(raw) < (row + 1) * h:
        return None
    lines = np.frombuffer(raw, np.uint8)[: (row + 1) * h].reshape(h, row + 1)
    out = np.zeros((h, row), np.uint8)
    before = np.zeros(row, np.uint8)
    for y in range(h):
        before = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], before, step)
    if depth < 8:
        per = 8 // depth
        out = ((out[:, :, None] >> (8 - depth * (np.arange(per) + 1))[None, None, :]) & ((1 << depth) - 1)).reshape(h, -1)[:, :w]
        if colour == 0:
            out = out * (255 // ((1 << depth) - 1))
    elif depth == 16:
        out = out[:, ::2]
    if colour == 3:
        return gray(np.frombuffer(c[b"PLTE"][0], np.uint8).reshape(-1, 3)[out])
    px = out[:, : w * planes].reshape(h, w, planes)
    return px[..., 0] if planes <= 2 else gray(px[..., :3])


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of bytes from its differences: from the left, above, their mean or the nearest of three."""
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    v = line.astype(np.int64)
    if kind == 1:
        pad = -len(v) % step
        return (np.pad(v, (0, pad)).reshape(-1, step).cumsum(axis=0).ravel()[: len(v)] & 255).astype(np.uint8)
    out, up = [0] * step + v.tolist(), [0] * step + above.tolist()
    for k in range(step, len(out)):
        a, b, c = out[k - step], up[k], up[k - step]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k] = (out[k] + guess) & 255
    return np.array(out[step:], np.uint8)


def encode_png(a: np.ndarray, dpi: int = 300) -> bytes:
    """Gray or RGB; pages of pure black and white take one bit a pixel."""
    h, w = a.shape[:2]
    bitonal = a.ndim == 2 and is_bitonal(a)
    rows = np.packbits(a > 0, axis=1) if bitonal else a.reshape(h, -1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 1 if bitonal else 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    per = round(dpi / 0.0254)
    raw = np.hstack([np.zeros((h, 1), np.uint8), rows.astype(np.uint8)]).tobytes()
    return _PNG + part(b"IHDR", head) + part(b"pHYs", struct.pack(">IIB", per, per, 1)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


# --- TIFF -------------------------------------------------------------------------------------------------------

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def _directories(content: bytes) -> list[dict[int, list]] | None:
    """Tags of each directory of a TIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8 or struct.unpack(order + "H", content[2:4])[0] != 42:
        return None
    at = struct.unpack(order + "I", content[4:8])[0]
    out, seen = [], set()
    while at and at not in seen and at + 2 <= len(content):
        seen.add(at)
        n = struct.unpack(order + "H", content[at : at + 2])[0]
        tags: dict[int, list] = {0: [order]}
        for k in range(n):
            entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                return out or None
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            size = _SIZES.get(kind, 0) * count
            start = struct.unpack(order + "I", entry[8:12])[0]
            data = entry[8 : 8 + size] if size <= 4 else content[start : start + size]
            if len(data) < size:
                continue
            if kind == 5:
                pairs = struct.unpack(order + f"{2 * count}I", data)
                tags[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            elif kind in _CODES:
                tags[tag] = list(struct.unpack(order + f"{count}{_CODES[kind]}", data))
        out.append(tags)
        tail = content[at + 2 + 12 * n : at + 6 + 12 * n]
        at = struct.unpack(order + "I", tail)[0] if len(tail) == 4 else 0
    return out


def _tiff_meta(content: bytes) -> list[Meta] | None:
    found = _directories(content)
    if not found:
        return None
    out = []
    for k, t in enumerate(found):
        unit = {2: 1.0, 3: 2.54}.get(t.get(296, [2])[0], 0.0)
        x, y = (round(t.get(tag, [0])[0] * unit) for tag in (282, 283))
        out.append(Meta("tiff", k, t.get(256, [0])[0], t.get(257, [0])[0], x, y))
    return out


def _unpacked(data: bytes) -> bytes:
    """PackBits: runs of bytes as they are, and one byte repeated."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


_UNDO = {1: bytes, 5: codecs.unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked}


def _packed(line: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(line):
        run = 1
        while run < 128 and at + run < len(line) and line[at + run] == line[at]:
            run += 1
        if run > 2:
            out += bytes((257 - run, line[at]))
            at += run
            continue
        end = at
        while end < len(line) and end - at < 128 and not (end + 2 < len(line) and line[end] == line[end + 1] == line[end + 2]):
            end += 1
        out += bytes((end - at - 1,)) + line[at:end]
        at = end
    return bytes(out)


def _samples(raw: bytes, rows: int, width: int, planes: int, bits: int, order: str, summed: bool) -> np.ndarray:
    """Samples (rows, width, planes) as they are, of 16 bits the upper eight; fails if raw is too short."""
    if bits == 16:
        a = np.frombuffer(raw, order + "u2", rows * width * planes).reshape(rows, width, planes)
        return ((a.cumsum(axis=1).astype(np.uint16) if summed else a) >> 8).astype(np.uint8)
    line = (width * planes * bits + 7) // 8
    a = np.frombuffer(raw, np.uint8, line * rows).reshape(rows, line)
    if bits < 8:
        a = (a[:, :, None] >> np.arange(8 - bits, -1, -bits)) & ((1 << bits) - 1)
        return a.reshape(rows, -1)[:, : width * planes].reshape(rows, width, planes).astype(np.uint8)
    a = a.reshape(rows, width, planes)
    return a.cumsum(axis=1).astype(np.uint8) if summed else a


_FAX_CODECS = {2: 2, 3: 3, 4: 4}


def _tiff(content: bytes, page: int) -> np.ndarray | None:
    found = _directories(content)
    if not found or page >= len(found):
        return None
    t = found[page]
    one = lambda tag, default=0: t.get(tag, [default])[0]
    w, h, bits, planes, codec, kind = one(256), one(257), one(258, 1), one(277, 1), one(259, 1), one(262, 1)
    tiled = 324 in t
    places, sizes = (t.get(324), t.get(325)) if tiled else (t.get(273), t.get(279))
    bw, bh = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
    if not (w and h and bw and bh and places and sizes) or bits not in (1, 2, 4, 8, 16) or one(317, 1) not in (1, 2) or kind == 6 and codec != 7:
        return None
    if one(317, 1) == 2 and bits < 8 or codec in _FAX_CODECS and (bits, planes) != (1, 1):
        return None
    apart = one(284, 1) == 2 and planes > 1
    each = 1 if apart else planes
    across, down = -(-w // bw), -(-h // bh)
    out = np.zeros((down * bh, across * bw, planes), np.uint8)
    if len(places) < across * down * (planes if apart else 1):
        return None
    for k in range(across * down * (planes if apart else 1)):
        plane, block = divmod(k, across * down)
        y, x = bh * (block // across), bw * (block % across)
        rows = bh if tiled else min(bh, h - y)
        data = content[places[k] : places[k] + sizes[k]]
        if one(266, 1) == 2 and codec != 7:
            data = codecs.reversed_bits(data)
        if codec in _FAX_CODECS:
            data = codecs.unfax(data, bw, rows, _FAX_CODECS[codec], codec == 3 and one(292) & 1 == 1)
        elif codec == 7:
            tables = bytes(t.get(347, []))
            px = codecs.unjpeg(tables[:-2] + data[2:] if tables else data, rgb=kind == 2)
            if px is None or px.shape[2] != each or px.shape[0] < rows or px.shape[1] < bw:
                return None
            data = px[:rows, :bw].tobytes()
        elif codec in _UNDO:
            data = _UNDO[codec](data)
        else:
            return None
        first, last = (plane, plane + 1) if apart else (0, planes)
        out[y : y + rows, x : x + bw, first:last] = _samples(data, rows, bw, each, bits, t[0][0], one(317, 1) == 2)
    out = out[:h, :w]
    if kind == 3:
        table = np.array(t.get(320, [0] * (3 << bits)), np.int64).reshape(3, -1).T >> 8
        return gray(table[out[..., 0]])
    if bits < 8:
        out = out * np.uint8(255 // ((1 << bits) - 1))
    if kind == 5:
        return gray((255 - out[..., :3].astype(np.int32)) * (255 - out[..., 3:4].astype(np.int32)) // 255) if planes >= 4 else None
    if planes >= 3:
        return gray(out[..., :3])
    return 255 - out[..., 0] if kind == 0 else np.ascontiguousarray(out[..., 0])


_TIFF_CODECS = {"none": 1, "packbits": 32773, "lzw": 5, "deflate": 8, "fax": 4}


def encode_tiff(pages: list[np.ndarray], dpi: int = 300, bw_codec: str = "packbits", colour_codec: str = "deflate") -> bytes:
    """One directory a page: bitonal by one codec, gray and RGB by the other (none, packbits, lzw, deflate; bitonal also fax)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for a in pages:
        h, w = a.shape[:2]
        bitonal = a.ndim == 2 and is_bitonal(a)
        rows = np.packbits(a > 0, axis=1) if bitonal else np.ascontiguousarray(a).reshape(h, -1)
        codec = bw_codec if bitonal else colour_codec
        if codec == "fax" and not bitonal:
            raise ValueError("fax takes bitonal pages only")
        data = {
            "none": lambda r=rows: r.tobytes(),
            "packbits": lambda r=rows: b"".join(_packed(x.tobytes()) for x in r),
            "lzw": lambda r=rows: codecs.lzw(r.tobytes()),
            "deflate": lambda r=rows: zlib.compress(r.tobytes(), 6),
            "fax": lambda a=a: codecs.fax(a == 0),
        }[codec]()
        planes = 1 if a.ndim == 2 else 3
        start = len(out)
        out += data + b"\0" * (len(data) % 2)
        extra = len(out)
        out += struct.pack("<IIII", dpi, 1, dpi, 1) + struct.pack("<3H", 8, 8, 8) + b"\0\0"
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 1 if bitonal else 8) if planes == 1 else (258, 3, 3, extra + 16), (259, 3, 1, _TIFF_CODECS[codec]), (262, 3, 1, 2 if planes == 3 else 0 if codec == "fax" else 1), (273, 4, 1, start), (277, 3, 1, planes), (278, 4, 1, h), (279, 4, 1, len(data)), (282, 5, 1, extra), (283, 5, 1, extra + 8), (296, 3, 1, 2)]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def appended(content: bytes, page: np.ndarray, dpi: int = 300) -> bytes:
    """A TIFF file with one more page."""
    n = len(_directories(content) or [])
    return encode_tiff([*(_tiff(content, k) for k in range(n)), page], dpi)


# --- PDF --------------------------------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj(.*?)endobj", re.S)


def _objects(content: bytes) -> dict[int, bytes]:
    """Bodies by number; objects in compressed streams are unpacked."""
    out = {int(k): v for k, v in _OBJECT.findall(content)}
    for body in list(out.values()):
        start = re.search(rb"stream\r?\n", body)
        if not start or not re.search(rb"/Type\s*/ObjStm", body[: start.start()]):
            continue
        data = body[start.end() :]
        if b"FlateDecode" in body[: start.start()]:
            data = zlib.decompressobj().decompress(data)
        first = _value(body, b"First")
        index = [int(v) for v in data[:first].split()]
        ends = [*index[3::2], len(data) - first]
        for k, a, b in zip(index[::2], index[1::2], ends, strict=False):
            out.setdefault(k, data[first + a : first + b])
    return out


def _value(body: bytes, key: bytes, default: int = 0) -> int:
    m = re.search(rb"/" + key + rb"\s+(\d+)(?!\s+\d+\s+R)", body)
    return int(m[1]) if m else default


def _pdf_pages(content: bytes) -> list[tuple[tuple[float, float], list[bytes]]]:
    """Size in points and image objects of each page."""
    objects = _objects(content)
    out = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page(?![a-z])", body):
            continue
        box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", body)
        numbers = [float(v) for v in box[1].split()] if box else [0, 0, 612, 792]
        names = [objects.get(int(k), b"") for k in re.findall(rb"(\d+)\s+\d+\s+R", body)]
        out.append(((numbers[2] - numbers[0], numbers[3] - numbers[1]), [o for o in names if re.search(rb"/Subtype\s*/Image", o)]))
    return out


def _pdf_meta(content: bytes) -> list[Meta] | None:
    out = []
    for k, ((w, h), images) in enumerate(_pdf_pages(content)):
        size = max(((_value(i, b"Width"), _value(i, b"Height")) for i in images), default=(round(w), round(h)), key=lambda s: s[0] * s[1])
        out.append(Meta("pdf", k, *size, round(size[0] * 72 / w) if w else 0, round(size[1] * 72 / h) if h else 0))
    return out or None


def image_only(content: bytes) -> bool:
    """Whether each page of a PDF file holds one image and no font."""
    pages = _pdf_pages(content)
    return bool(pages) and all(len(i) == 1 for _, i in pages) and not re.search(rb"/Type\s*/Font", content)


def _pdf(content: bytes, page: int) -> np.ndarray | None:
    pages = _pdf_pages(content)
    if page >= len(pages) or not pages[page][1]:
        return None
    body = max(pages[page][1], key=lambda i: _value(i, b"Width") * _value(i, b"Height"))
    w, h, bits = _value(body, b"Width"), _value(body, b"Height"), _value(body, b"BitsPerComponent", 8)
    start = re.search(rb"stream\r?\n", body)
    if not start or not w or not h:
        return None
    head = body[: start.start()]
    size = _value(head, b"Length")
    raw = body[start.end() : start.end() + size] if size else body[start.end() : body.rindex(b"endstream")]
    names = re.search(rb"/Filter\s*(\[[^\]]*\]|/\w+)", head)
    planes = 3 if b"DeviceRGB" in head else 1
    bits = 1 if re.search(rb"/ImageMask\s+true", head) else bits
    inverted = re.search(rb"/Decode\s*\[\s*1\s+0", head) is not None
    for codec in re.findall(rb"/(\w+)", names[1]) if names else []:
        if codec in (b"FlateDecode", b"LZWDecode"):
            raw = zlib.decompress(raw) if codec == b"FlateDecode" else codecs.unlzw(raw)
            if _value(head, b"Predictor", 1) >= 10:
                raw = _unpredicted(raw, (w * planes * bits + 7) // 8, h, max(1, planes * bits // 8))
        elif codec == b"CCITTFaxDecode":
            k = re.search(rb"/K\s+(-?\d+)", head)
            kind = int(k[1]) if k else 0
            raw = codecs.unfax(raw, _value(head, b"Columns", 1728), h, 4 if kind < 0 else 3, kind > 0)
            if not re.search(rb"/BlackIs1\s+true", head):
                raw = (~np.frombuffer(raw, np.uint8)).tobytes()
        elif codec == b"DCTDecode":
            px = codecs.unjpeg(raw)
            if px is None or px.shape[:2] != (h, w):
                return None
            raw, planes, bits = px.tobytes(), px.shape[2], 8
        else:
            return None
    if bits not in (1, 2, 4, 8, 16) or _value(head, b"Predictor", 1) == 2:
        return None
    a = _samples(raw, h, w, planes, bits, ">", False)
    a = a * np.uint8(255 // ((1 << bits) - 1)) if bits < 8 else a
    a = gray(a) if planes == 3 else a[..., 0]
    return 255 - a if inverted else np.ascontiguousarray(a)


def _unpredicted(raw: bytes, row: int, h: int, step: int) -> bytes:
    """Lines of bytes from lines of differences, each after the kind of its differences."""
    lines = np.frombuffer(raw, np.uint8, (row + 1) * h).reshape(h, row + 1)
    out, before = [], np.zeros(row, np.uint8)
    for line in lines:
        before = _unfiltered(int(line[0]), line[1:], before, step)
        out.append(before.tobytes())
    return b"".join(out)


def encode_pdf(pages: list[np.ndarray], dpi: int = 300) -> bytes:
    """One image a page, by Flate."""
    n = len(pages)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (3 + 3 * k) for k in range(n)))]
    for k, a in enumerate(pages):
        h, w = a.shape[:2]
        bitonal = a.ndim == 2 and is_bitonal(a)
        data = zlib.compress((np.packbits(a > 0, axis=1) if bitonal else np.ascontiguousarray(a)).tobytes(), 6)
        pw, ph = w * 72 / dpi, h * 72 / dpi
        draw = b"q %.4f 0 0 %.4f 0 0 cm /I Do Q" % (pw, ph)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.4f %.4f] /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> >> >>" % (pw, ph, 4 + 3 * k, 5 + 3 * k))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw))
        space = b"/DeviceGray" if a.ndim == 2 else b"/DeviceRGB"
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (w, h, space, 1 if bitonal else 8, len(data), data))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))


# --- headers of JPEG and JPEG 2000 --------------------------------------------------------------------------------


def _jpeg_meta(content: bytes) -> list[Meta] | None:
    at, x, y = 2, 0, 0
    while at + 9 < len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if kind == 0xE0 and content[at + 4 : at + 8] == b"JFIF" and content[at + 11] in (1, 2):
            unit = 1.0 if content[at + 11] == 1 else 2.54
            x, y = (round(v * unit) for v in struct.unpack(">HH", content[at + 12 : at + 16]))
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", content[at + 5 : at + 9])
            return [Meta("jpeg", 0, w, h, x, y)]
        at += 2 + size
    return None


def _jp2_meta(content: bytes) -> list[Meta] | None:
    at = content.find(b"ihdr")
    if at > 0 and at + 12 <= len(content):
        h, w = struct.unpack(">II", content[at + 4 : at + 12])
        return [Meta("jp2", 0, w, h)]
    at = content.find(b"\xff\x51")
    if at < 0 or at + 22 > len(content):
        return None
    w, h, x, y = struct.unpack(">IIII", content[at + 6 : at + 22])
    return [Meta("jp2", 0, w - x, h - y)]


def _pnm_meta(content: bytes) -> list[Meta] | None:
    m = re.match(rb"P[456](?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)", content)
    return [Meta("pnm", 0, int(m[1]), int(m[2]))] if m else None


# --- dispatch ---------------------------------------------------------------------------------------------------


def kind_of(content: bytes) -> str | None:
    """Kind of a file by its first bytes."""
    if content[:5] == b"%PDF-":
        return "pdf"
    if content[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    if content[:8] == _PNG:
        return "png"
    if content[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if content[4:8] == b"jP  " or content[:4] == b"\xff\x4f\xff\x51":
        return "jp2"
    return "pnm" if content[:2] in (b"P4", b"P5", b"P6") else None


_META = {"pdf": _pdf_meta, "tiff": _tiff_meta, "png": _png_meta, "jpeg": _jpeg_meta, "jp2": _jp2_meta, "pnm": _pnm_meta}


def metadata(content: bytes) -> list[Meta] | None:
    """Pages of a file from its headers: None if it isn't recognised, an empty list if it is and has no image."""
    kind = kind_of(content)
    if kind is None:
        return None
    try:
        return _META[kind](content) or []
    except (struct.error, ValueError, IndexError, zlib.error):
        return []


def decode(content: bytes, page: int = 0) -> np.ndarray | None:
    """A page of a file as gray; None where there is none, or only a header can be read."""
    kind = kind_of(content)
    try:
        if kind == "pdf":
            return _pdf(content, page)
        if kind == "tiff":
            return _tiff(content, page)
        if page or kind is None:
            return None
        if kind == "jpeg":
            px = codecs.unjpeg(content)
            return None if px is None else gray(px) if px.shape[2] == 3 else px[..., 0]
        if kind == "png":
            return _png(content)
        if kind == "pnm":
            from folioframe.sources.images import decode as pnm

            got = pnm(content)
            return None if got is None else np.frombuffer(got[2], np.uint8).reshape(got[1], got[0])
    except (struct.error, ValueError, IndexError, KeyError, zlib.error):
        return None
    return None


def encode(pages: list[np.ndarray], kind: str, dpi: int = 300, bw_codec: str = "packbits", colour_codec: str = "deflate") -> bytes:
    """A file of that kind; only tiff and pdf take several pages."""
    if kind == "tiff":
        return encode_tiff(pages, dpi, bw_codec, colour_codec)
    if kind == "pdf":
        return encode_pdf(pages, dpi)
    if len(pages) != 1 or kind not in ("png", "pgm"):
        raise ValueError(f"{len(pages)} pages as {kind}")
    if kind == "png":
        return encode_png(pages[0], dpi)
    h, w = pages[0].shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pages[0]).tobytes()
