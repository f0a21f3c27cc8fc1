"""Image files, the file sink and project files: exact round trips, damaged and unknown input."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.sources import codecs, files, formats, project


def rasters():
    r = np.random.default_rng(1)
    for h, w in ((1, 1), (1, 9), (7, 3), (16, 33), (5, 200)):
        yield r.integers(0, 256, (h, w)).astype(np.uint8)
        yield (r.integers(0, 2, (h, w)) * 255).astype(np.uint8)
    yield np.zeros((40, 500), np.uint8)


@pytest.mark.parametrize("kind", ["png", "tiff", "pdf", "pgm"])
def test_round_trip(kind):
    for a in rasters():
        content = formats.encode([a], kind, 300)
        assert (formats.decode(content) == a).all()
        meta = formats.metadata(content)
        assert [(m.page, m.width, m.height) for m in meta] == [(0, a.shape[1], a.shape[0])]
        if kind in ("png", "tiff"):
            assert (meta[0].dpi_x, meta[0].dpi_y) == (300, 300)
        for cut in (1, 7, 20, len(content) // 2):
            formats.metadata(content[:cut])
            formats.decode(content[:cut])


@pytest.mark.parametrize("codec", ["none", "packbits", "deflate"])
def test_tiff_pages_and_codecs(codec):
    pages = list(rasters())
    content = formats.encode(pages, "tiff", 200, codec, codec)
    assert [(m.width, m.height, m.dpi_x) for m in formats.metadata(content)] == [(a.shape[1], a.shape[0], 200) for a in pages]
    assert all((formats.decode(content, k) == a).all() for k, a in enumerate(pages)) and formats.decode(content, len(pages)) is None
    more = formats.appended(content, pages[3])
    assert len(formats.metadata(more)) == len(pages) + 1 and (formats.decode(more, len(pages)) == pages[3]).all()


def test_colour_becomes_gray():
    rgb = np.random.default_rng(2).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    for content in (formats.encode_png(rgb), formats.encode_tiff([rgb]), formats.encode_pdf([rgb])):
        assert (formats.decode(content) == formats.gray(rgb)).all()


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    a = np.random.default_rng(kind).integers(0, 256, (6, 8, 3)).astype(np.int64)
    raw, flat = bytearray(), a.reshape(6, 24)
    for y in range(6):
        raw.append(kind)
        for x in range(24):
            left, up = flat[y, x - 3] if x >= 3 else 0, flat[y - 1, x] if y else 0
            corner = flat[y - 1, x - 3] if y and x >= 3 else 0
            p = left + up - corner
            near = min([left, up, corner], key=lambda v: abs(p - v))
            raw.append(int(flat[y, x] - [0, left, up, (left + up) // 2, near][kind]) & 255)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    content = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 8, 6, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(bytes(raw))) + part(b"IEND", b"")
    assert (formats.decode(content) == formats.gray(a.astype(np.uint8))).all()


def test_headers_of_other_formats():
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\1" + struct.pack(">HH", 150, 150) + b"\0\0" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 40, 30, 1) + b"\1\x11\0"
    assert formats.metadata(jpeg) == [formats.Meta("jpeg", 0, 30, 40, 150, 150)] and formats.decode(jpeg) is None
    jp2 = b"\0\0\0\x0cjP  \r\n\x87\n" + b"\0\0\0\x16ihdr" + struct.pack(">IIHBBBB", 12, 34, 1, 7, 7, 0, 0)
    assert formats.metadata(jp2) == [formats.Meta("jp2", 0, 34, 12)]
    assert formats.metadata(b"text") is None and formats.metadata(b"") is None and formats.metadata(b"%PDF-1.4\n") == []
    pdf = formats.encode([np.zeros((4, 4), np.uint8)] * 3, "pdf")
    assert len(formats.metadata(pdf)) == 3 and formats.image_only(pdf) and not formats.image_only(pdf.replace(b"/Type /Catalog", b"/Type /Font /X"))


def test_files_in_and_out(spark, tmp_path):
    r = np.random.default_rng(3)
    pages = {f"a{k}.tif": r.integers(0, 256, (k + 1, 2 * k + 3)).astype(np.uint8) for k in range(12)}
    df = spark.createDataFrame([(n, a.shape[1], a.shape[0], a.tobytes()) for n, a in pages.items()], "name string, width int, height int, data binary").repartition(3)
    out = f"{tmp_path}/out"
    files.write(df, out)
    (tmp_path / "out" / "note.txt").write_text("no image")
    (tmp_path / "out" / "cut.tif").write_bytes(formats.encode([pages["a3.tif"]], "tiff")[:20])
    got = files.load(files.listed(spark, [out])).collect()
    loaded = {x["path"].rsplit("/", 1)[1]: np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"]) for x in got if x["status"] == "loaded"}
    assert loaded.keys() == pages.keys() and all((loaded[n] == a).all() for n, a in pages.items())
    assert {x["path"].rsplit("/", 1)[1]: x["status"] for x in got if x["status"] != "loaded"} == {"note.txt": "unrecognised", "cut.tif": "no_images"}
    meta = files.scan_metadata(files.listed(spark, [f"{out}/*.tif"]))
    assert meta.where("status = 'loaded' and kind = 'tiff'").count() == 12
    order = [x["path"].rsplit("/", 1)[1] for x in files.ordered(meta.where("status = 'loaded'").select("path")).orderBy("rank").collect()]
    assert order == [f"a{k}.tif" for k in range(12)]
    with pytest.raises(Exception, match="files that are there"):
        files.write(df.limit(2), out)
    files.write(df.limit(2), out, mode="overwrite")
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    several = df.groupBy(F.lit("all.tif").alias("name")).agg(F.array_sort(F.collect_list(F.struct("width", "height", "data"))).alias("pages"))
    files.write(several, f"{tmp_path}/book")
    assert files.load(files.listed(spark, [f"{tmp_path}/book"])).where("status = 'loaded'").count() == 12


def test_project_round_trip(spark, tmp_path):
    tables = {
        "directories": spark.createDataFrame([(1, '/in & "out"'), (2, "/b<c>")], "id long, path string"),
        "files": spark.createDataFrame([(1, 1, "x1.tif"), (2, 2, "y.tif"), (3, 9, "lost.tif")], "id long, dir_id long, name string"),
        "images": spark.createDataFrame([(1, 1, 0, 1, 100, 200, 300, 300, True), (2, 2, 1, 2, 50, 60, None, None, False), (3, 3, 0, 1, 1, 1, 1, 1, False), (4, 2, 0, 7, 1, 1, 1, 1, False)], "id long, file_id long, file_image int, sub_pages int, width int, height int, dpi_x int, dpi_y int, grayscale boolean"),
        "pages": spark.createDataFrame([(1, 1, 0), (2, 2, 1), (3, 2, 2), (4, 3, 0), (5, 8, 0), (6, 4, 0)], "id long, image_id long, sub_page int"),
    }
    project.write(tables, f"{tmp_path}/project.xml", "/out", "RTL")
    back = project.read(spark, f"{tmp_path}/project.xml")
    for name, df in tables.items():
        assert sorted(map(str, back[name].select(*df.columns).collect())) == sorted(map(str, df.collect())), name
    rows = {(r["page_id"], r["path"], r["sub_page"], r["width"]) for r in project.resolved(back).collect()}
    assert rows == {(1, '/in & "out"/x1.tif', 0, 100), (2, "/b<c>/y.tif", 1, 50), (3, "/b<c>/y.tif", 2, 50)}


def test_zone_text(spark):
    zones = spark.createDataFrame([(1, 1, "fill", [1, 2]), (1, 0, "picture", [3, 4, 5]), (2, 0, "fill", [])], "img_id long, ord int, kind string, points array<int>")
    got = {r["img_id"]: r["value"].split("\n") for r in files.zone_text(zones, list("abcde")).collect()}
    assert got[1] == ["# a", "# b", "# c", "# d", "# e", "0\tpicture\t3\t4\t5", "1\tfill\t1\t2"] and len(got[2]) == 6


@pytest.mark.parametrize("codec", ["none", "packbits", "lzw", "deflate", "fax"])
def test_bitonal_codecs(codec):
    r = np.random.default_rng(5)
    pages = [(r.random((h, w)) < p).astype(np.uint8) * 255 for h, w in ((1, 1), (3, 17), (40, 90), (9, 2700)) for p in (0, 0.02, 0.5, 0.97, 1)]
    pages.append(np.kron(pages[12], np.ones((7, 9), np.uint8)))
    content = formats.encode(pages, "tiff", 300, codec)
    assert all((formats.decode(content, k) == a).all() for k, a in enumerate(pages))
    for cut in range(8, len(content), len(content) // 40):
        formats.decode(content[:cut], 3)


def test_fax_codes_are_complete():
    for runs in codecs._RUNS:  # all but the eight zeros that start the end of a line
        assert len(runs) == 104 and sum(2.0 ** -len(c) for c in runs.values()) == 1 - 2.0**-8
    with pytest.raises(ValueError, match="bitonal"):
        formats.encode([np.full((2, 2), 7, np.uint8)], "tiff", 300, "fax", "fax")


def test_fax_lines_of_runs():
    r = np.random.default_rng(6)
    black = np.kron(r.random((12, 60)) < 0.4, np.ones((1, 50), bool))
    black[4], black[5] = True, False
    lines = []
    for row in black:
        edges = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
        runs = [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]
        runs = [0, *runs] if row[0] else runs
        lines.append("".join(codecs._run_code(n, k % 2) for k, n in enumerate(runs)))
    want = np.packbits(black, axis=1).tobytes()
    joined = lambda parts: (lambda s: int(s, 2).to_bytes(len(s) // 8, "big"))((lambda s: s + "0" * (-len(s) % 8))("".join(parts)))
    assert codecs.unfax(joined(x + "0" * (-len(x) % 8) for x in lines), 3000, 12, 2) == want
    assert codecs.unfax(joined("000000000001" + x for x in lines), 3000, 12, 3) == want
    assert codecs.unfax(joined(lines), 3000, 12, 3) == want
    assert codecs.unfax(joined("0000" + "000000000001" + "1" + x for x in lines), 3000, 12, 3, True) == want


def tiff(tags, data, order="<"):
    """A file of one directory: tags by number, (kind, values) or just longs; data starts at 8."""
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(data)) + data
    later, entries, at = b"", b"", 8 + len(data) + 6 + 12 * len(tags)
    for tag, (kind, values) in sorted(tags.items()):
        body = struct.pack(order + f"{len(values)}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", *values)
        if len(body) > 4:
            entries += struct.pack(order + "HHII", tag, kind, len(values), at + len(later))
            later += body
        else:
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return out + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + later


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16])
def test_tiff_depths_in_tiles_and_planes(bits, order):
    r = np.random.default_rng(bits)
    h, w = 21, 37
    a = r.integers(0, 1 << bits, (h, w))
    padded = np.pad(a, ((0, 32 - h), (0, 48 - w)))
    data, places, sizes = b"", [], []
    for y in range(0, 32, 16):
        for x in range(0, 48, 16):
            tile = padded[y : y + 16, x : x + 16]
            if bits == 16:
                raw = tile.astype(order + "u2").tobytes()
            else:
                raw = np.packbits((tile[..., None] >> np.arange(bits - 1, -1, -1)) & 1).tobytes()
            raw = codecs.lzw(raw)
            places.append(8 + len(data))
            sizes.append(len(raw))
            data += raw
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits]), 259: (3, [5]), 262: (3, [1]), 277: (3, [1]), 322: (3, [16]), 323: (3, [16]), 324: (4, places), 325: (4, sizes)}
    want = a >> 8 if bits == 16 else a * (255 // ((1 << bits) - 1))
    assert (formats.decode(tiff(tags, data, order)) == want).all()
    assert (formats.decode(tiff(tags | {262: (3, [0])}, data, order)) == 255 - want).all()
    if bits in (2, 4, 8):
        colours = r.integers(0, 65536, (3, 1 << bits))
        got = formats.decode(tiff(tags | {262: (3, [3]), 320: (3, colours.ravel().tolist())}, data, order))
        assert (got == formats.gray((colours >> 8).T[a])).all()
    planes = r.integers(0, 256, (4, h, w)).astype(np.uint8)
    for n, kind in ((3, 2), (4, 5)):
        raw = planes[:n].tobytes()
        got = formats.decode(tiff({256: (4, [w]), 257: (4, [h]), 258: (3, [8] * n), 259: (3, [1]), 262: (3, [kind]), 273: (4, [8 + k * h * w for k in range(n)]), 277: (3, [n]), 278: (4, [h]), 279: (4, [h * w] * n), 284: (3, [2])}, raw, order))
        full = planes.transpose(1, 2, 0).astype(np.int32)
        assert (got == formats.gray(full[..., :3] if n == 3 else (255 - full[..., :3]) * (255 - full[..., 3:]) // 255)).all()


def jpeg(planes, sampling, height, width, stepwise=False, every=0):
    """A file of coefficients (blocks down, blocks across, 64 in zigzag order) with codes of equal length."""
    out = []
    size = lambda v: int(abs(v)).bit_length()
    low = lambda v, s: format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""
    acs = [run << 4 | s for run in range(16) for s in range(11) if s or run == 15 or stepwise or not run]
    dc, ac = (lambda s: format(s, "04b")), (lambda rs: format(acs.index(rs), "08b"))
    segment = lambda kind, body: b"\xff" + bytes((kind,)) + struct.pack(">H", len(body) + 2) + body
    out.append(b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes(range(1, 65))))
    n = len(planes)
    out.append(segment(0xC2 if stepwise else 0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes((k, h << 4 | v, 0)) for k, (h, v) in enumerate(sampling))))
    out.append(segment(0xC4, bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))))
    out.append(segment(0xC4, bytes([16]) + bytes([0] * 7 + [len(acs)] + [0] * 8) + bytes(acs)))
    if every:
        out.append(segment(0xDD, struct.pack(">H", every)))
    mh, mv = max(h for h, _ in sampling), max(v for _, v in sampling)

    def scan(which, first, last, high, bit, code):
        out.append(segment(0xDA, bytes([len(which)]) + b"".join(bytes((k, 0)) for k in which) + bytes((first, last, high << 4 | bit))))
        across, down = -(-width // (8 * mh)), -(-height // (8 * mv))
        if len(which) == 1:
            h, v = sampling[which[0]]
            across, down = -(-width * h // (8 * mh)), -(-height * v // (8 * mv))
        bits, before, marks = "", dict.fromkeys(which, 0), 0
        for unit in range(across * down):
            if every and unit and unit % every == 0:
                bits += "1" * (-len(bits) % 8)
                out.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + bytes((0xFF, 0xD0 + marks % 8)))
                bits, before, marks = "", dict.fromkeys(which, 0), marks + 1
            y, x = divmod(unit, across)
            for k in which:
                h, v = sampling[k] if len(which) > 1 else (1, 1)
                for dy in range(v):
                    for dx in range(h):
                        block = planes[k][y * v + dy, x * h + dx].tolist()
                        more, before[k] = code(block, before[k], first, last, bit)
                        bits += more
        bits += "1" * (-len(bits) % 8)
        out.append(int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0"))

    def mean(block, before, first, last, bit):
        d = (block[0] >> bit) - before
        return dc(size(d)) + low(d, size(d)), before + d

    def mean_bit(block, before, first, last, bit):
        return str(block[0] >> bit & 1), before

    def waves(block, before, first, last, bit):
        got, run = "", 0
        values = [int(abs(v) >> bit) * (1 if v > 0 else -1) for v in block]
        for k in range(first, last + 1):
            if not values[k]:
                run += 1
                continue
            while run > 15:
                got, run = got + ac(0xF0), run - 16
            s = size(values[k])
            got, run = got + ac(run << 4 | s) + low(values[k], s), 0
        return got + (ac(0) if run else ""), before

    def waves_bit(block, before, first, last, bit):
        got, run, held = "", 0, ""
        new = [k for k in range(first, last + 1) if abs(block[k]) >> bit == 1]
        for k in range(first, last + 1):
            v = abs(block[k]) >> bit
            if v > 1:
                held += str(v & 1)
            elif v == 1:
                got += ac(run << 4 | 1) + ("1" if block[k] > 0 else "0") + held
                run, held = 0, ""
            elif run == 15 and any(m > k for m in new):
                got, run, held = got + ac(0xF0) + held, 0, ""
            else:
                run += 1
        return got + (ac(0) + held if run or held else ""), before

    both = lambda *a: (mean(*a)[0] + waves(a[0], 0, 1, 63, 0)[0], mean(*a)[1])
    if not stepwise:
        scan(list(range(n)), 0, 63, 0, 0, both)
    else:
        scan(list(range(n)), 0, 0, 0, 1, mean)
        for k in range(n):
            scan([k], 1, 5, 0, 1, waves)
            scan([k], 6, 63, 0, 1, waves)
        scan(list(range(n)), 0, 0, 1, 0, mean_bit)
        for k in range(n):
            scan([k], 1, 63, 1, 0, waves_bit)
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("every", [0, 2])
@pytest.mark.parametrize("stepwise", [False, True])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_jpeg(sampling, stepwise, every):
    r = np.random.default_rng(len(sampling) + 2 * stepwise + every)
    height, width = 37, 50
    mh, mv = max(h for h, _ in sampling), max(v for _, v in sampling)
    planes = []
    for h, v in sampling:
        c = r.integers(-9, 10, (-(-height // (8 * mv)) * v, -(-width // (8 * mh)) * h, 64)) * (r.random(64) < 0.15)
        c[..., 0] = r.integers(-300, 300, c.shape[:2])
        planes.append(c)
    content = jpeg(planes, sampling, height, width, stepwise, every)
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    full = []
    for c, (h, v) in zip(planes, sampling, strict=True):
        f = np.zeros((*c.shape[:2], 8, 8))
        for k, (y, x) in enumerate(order):
            f[..., y, x] = c[..., k] * (k + 1)
        px = np.zeros((c.shape[0] * 8, c.shape[1] * 8))
        for y in range(8):
            for x in range(8):
                wave = np.outer(*(np.array([np.cos((2 * p + 1) * u * np.pi / 16) * (1 if u else 0.5**0.5) / 2 for u in range(8)]) for p in (y, x)))
                px[y::8, x::8] = (f * wave).sum(axis=(2, 3)) + 128
        full.append(px[(np.arange(height) * v // mv)[:, None], np.arange(width) * h // mh])
    if len(full) == 3:
        y, b, q = full[0], full[1] - 128, full[2] - 128
        full = [y + 1.402 * q, y - 0.344136 * b - 0.714136 * q, y + 1.772 * b]
    want = np.stack(full, axis=-1).round().clip(0, 255)
    got = codecs.unjpeg(content)
    assert got.shape == want.shape and abs(got - want).max() <= 1
    assert formats.decode(content).shape == (height, width) and formats.metadata(content) == [formats.Meta("jpeg", 0, width, height)]
    for cut in range(0, len(content), 97):
        formats.decode(content[:cut])


def pdf(head, data):
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Page /MediaBox [0 0 72 72] /Resources << /XObject << /I 2 0 R >> >> >>\nendobj\n2 0 obj\n<< /Type /XObject /Subtype /Image " + head + b" >>\nstream\n" + data + b"\nendstream\nendobj\n"


def test_pdf_codecs():
    r = np.random.default_rng(8)
    black = r.random((20, 45)) < 0.3
    a = r.integers(0, 256, (20, 45)).astype(np.uint8)
    size = b"/Width 45 /Height 20 "
    fax = size + b"/BitsPerComponent 1 /Filter /CCITTFaxDecode /DecodeParms << /K -1 /Columns 45 /Rows 20 >>"
    data = codecs.fax(black)
    assert (formats.decode(pdf(fax + b" /Length %d" % len(data), data)) == np.where(black, 0, 255)).all()
    assert (formats.decode(pdf(fax + b" /Decode [1 0] /Length 9 0 R", data)) == np.where(black, 255, 0)).all()
    for head, raw in ((b"/Filter /LZWDecode", codecs.lzw(a.tobytes())), (b"/Filter [/FlateDecode]", zlib.compress(a.tobytes())), (b"/Filter [/FlateDecode /LZWDecode]", zlib.compress(codecs.lzw(a.tobytes())))):
        assert (formats.decode(pdf(size + b"/ColorSpace /DeviceGray /BitsPerComponent 8 " + head + b" /Length %d" % len(raw), raw)) == a).all()
    lines = np.hstack([np.full((20, 1), 2, np.uint8), np.diff(np.pad(a, ((1, 0), (0, 0))), axis=0)])
    raw = zlib.compress(lines.tobytes())
    assert (formats.decode(pdf(size + b"/BitsPerComponent 8 /Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 45 >> /Length %d" % len(raw), raw)) == a).all()
    c = r.integers(-50, 50, (3, 6, 64)) * (np.arange(64) < 3)
    raw = jpeg([c], [(1, 1)], 20, 45)
    assert (formats.decode(pdf(size + b"/BitsPerComponent 8 /Filter /DCTDecode /Length %d" % len(raw), raw)) == codecs.unjpeg(raw)[..., 0]).all()
    assert formats.decode(pdf(size + b"/Filter /JPXDecode /Length 3", b"abc")) is None


def test_pdf_objects_in_streams():
    page = b"<< /Type /Page /MediaBox [0 0 36 72] /Resources << /XObject << /I 2 0 R >> >> >>"
    packed = zlib.compress(b"7 0 8 %d " % len(page) + page + b"<< /Type /Catalog >>")
    first = len(b"7 0 8 %d " % len(page))
    a = np.arange(200, dtype=np.uint8).reshape(20, 10)
    image = b"2 0 obj\n<< /Type /XObject /Subtype /Image /Width 10 /Height 20 /BitsPerComponent 8 /Length 200 >>\nstream\n" + a.tobytes() + b"\nendstream\nendobj\n"
    content = b"%PDF-1.5\n" + image + b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (first, len(packed)) + packed + b"\nendstream\nendobj\n"
    assert formats.metadata(content) == [formats.Meta("pdf", 0, 10, 20, 20, 20)] and (formats.decode(content) == a).all()
