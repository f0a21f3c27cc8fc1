"""Codecs of image data without an image library: LZW, fax (T.4 and T.6) and JPEG by Huffman codes.

All three read codes by the 16 bits that start at each bit of the data, so that
a code costs one look-up.  Damaged data raise ValueError or IndexError.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable

import numpy as np


def _windows(data: bytes) -> memoryview:
    """The 16 bits from each bit on; zeros stand beyond the end."""
    b = np.frombuffer(data + bytes(3), np.uint8).astype(np.uint32)
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return memoryview(np.stack([three >> (8 - k) & 0xFFFF for k in range(8)], axis=1).astype(np.uint16).ravel())


def reversed_bits(data: bytes) -> bytes:
    """Bytes whose lowest bit comes first, turned round."""
    return np.packbits(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).tobytes()


# --- LZW --------------------------------------------------------------------------------------------------------

_CLEAR, _END = 256, 257


def unlzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, widened one code early."""
    bits, at, width = _windows(data), 0, 9
    fresh = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, before, out = fresh.copy(), b"", bytearray()
    while at + width <= 8 * len(data):
        code = bits[at] >> (16 - width)
        at += width
        if code == _END:
            break
        if code == _CLEAR:
            table, before, width = fresh.copy(), b"", 9
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("code beyond the table")
        entry = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
        out += entry
        before = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """The inverse of unlzw; the table starts anew at 4094 entries."""
    out, held, n_held = bytearray(), _CLEAR, 9
    table: dict[int, int] = {}
    width, prefix = 9, -1

    def put(code: int) -> None:
        nonlocal held, n_held
        held, n_held = held << width | code, n_held + width
        while n_held >= 8:
            n_held -= 8
            out.append(held >> n_held)
            held &= (1 << n_held) - 1

    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        known = table.get(key)
        if known is not None:
            prefix = known
            continue
        put(prefix)
        table[key] = _END + 1 + len(table)
        if table[key] == 4094:
            put(_CLEAR)
            table, width = {}, 9
        elif table[key] == (1 << width) - 1:
            width += 1
        prefix = byte
    if prefix >= 0:
        put(prefix)
        if _END + 1 + len(table) == (1 << width) - 1 and width < 12:
            width += 1
    put(_END)
    if n_held:
        out.append(held << (8 - n_held) & 255)
    return bytes(out)


# --- fax --------------------------------------------------------------------------------------------------------

# Fixed values of T.4: codes of runs of 0 to 63, then of 64, 128, ... 1728, by colour; those of 1792 to 2560 are common.
_WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 "
    "101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 "
    "00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 "
    "00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 "
    "011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
_BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 "
    "0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 "
    "000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 "
    "000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 "
    "0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
# Fixed values of T.6: pass, horizontal, and vertical by the distance from the line above.
_PASS, _HORIZONTAL = "0001", "001"
_VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}

_RUNS = [{(k if k < 64 else 64 * (k - 63)): c for k, c in enumerate(codes + _LONG)} for codes in (_WHITE, _BLACK)]
_TO_PASS, _TO_HORIZONTAL = 8, 9


def _lookup(codes: dict[int, str]) -> list[tuple[int, int]]:
    """Length and meaning of the code that starts each 13 bits; length 0 where none does."""
    table = [(0, 0)] * 8192
    for meaning, code in codes.items():
        free = 13 - len(code)
        start = int(code, 2) << free
        table[start : start + (1 << free)] = [(len(code), meaning)] * (1 << free)
    return table


_RUN_TABLES = [_lookup(r) for r in _RUNS]
_MODE_TABLE = _lookup({_TO_PASS: _PASS, _TO_HORIZONTAL: _HORIZONTAL, **_VERTICAL})


class _Fax:
    """Lines as the places where the colour changes, white first."""

    def __init__(self, data: bytes, width: int) -> None:
        self.bits, self.at, self.width = _windows(data), 0, width

    def code(self, table: list[tuple[int, int]]) -> int:
        n, meaning = table[self.bits[self.at] >> 3]
        if not n:
            raise ValueError("no such code")
        self.at += n
        return meaning

    def run(self, colour: int) -> int:
        total = 0
        while True:
            n = self.code(_RUN_TABLES[colour])
            total += n
            if n < 64:
                return total

    def line(self) -> list[int]:
        """A line of runs alone."""
        out, x, colour = [], 0, 0
        while x < self.width:
            x += self.run(colour)
            out.append(x)
            colour ^= 1
        return self.checked(out)

    def line_by(self, above: list[int]) -> list[int]:
        """A line told by its differences from the line above."""
        w = self.width
        above = [*above, w, w, w, w]
        out, x, colour, k = [], -1, 0, 0
        while x < w:
            k = max(0, k - 1)
            k += (k ^ colour) & 1
            while above[k] <= x and above[k] < w:
                k += 2
            mode = self.code(_MODE_TABLE)
            if mode == _TO_PASS:
                x = above[k + 1]
            elif mode == _TO_HORIZONTAL:
                first = max(x, 0) + self.run(colour)
                x = first + self.run(colour ^ 1)
                out += (first, x)
            else:
                if above[k] + mode < x:
                    raise ValueError("a change before the last one")
                x = above[k] + mode
                out.append(x)
                colour ^= 1
        return self.checked(out)

    def checked(self, changes: list[int]) -> list[int]:
        if changes and changes[-1] > self.width:
            raise ValueError("a run beyond the line")
        while changes and changes[-1] == self.width:
            changes.pop()
        return changes

    def end_of_line(self) -> bool:
        """Skips fill and the mark of a line's end, where they are."""
        at = self.at
        while self.bits[at] >> 4 == 0:
            at += 1
        if self.bits[at] >> 4 != 1:
            return False
        self.at = at + 12
        return True


def unfax(data: bytes, width: int, height: int, codec: int, two_way: bool = False) -> bytes:
    """Packed lines, black as 1.  Codec 2: runs, each line from a whole byte on; 3: T.4, by tags where two_way; 4: T.6."""
    fax, above, out = _Fax(data, width), [], bytearray()
    for _ in range(height):
        by_above = codec == 4
        if codec == 2:
            fax.at = -(-fax.at // 8) * 8
        elif codec == 3 and fax.end_of_line() and two_way:
            by_above = fax.bits[fax.at] >> 15 == 0
            fax.at += 1
        above = fax.line_by(above) if by_above else fax.line()
        row = bytearray(width)
        for a, b in zip(above[::2], [*above[1::2], width], strict=False):
            row[a:b] = b"\1" * (b - a)
        out += row
    return np.packbits(np.frombuffer(bytes(out), np.uint8).reshape(height, width), axis=1).tobytes()


def _run_code(n: int, colour: int) -> str:
    out = ""
    while n >= 2560 + 64:
        out, n = out + _RUNS[colour][2560], n - 2560
    if n >= 64:
        out, n = out + _RUNS[colour][n // 64 * 64], n % 64
    return out + _RUNS[colour][n]


def fax(black: np.ndarray) -> bytes:
    """T.6 data of lines, black as true."""
    h, w = black.shape
    edges = np.diff(np.pad(black.astype(np.int8), ((0, 0), (1, 0))), axis=1) != 0
    ys, xs = np.nonzero(edges)
    ends = np.searchsorted(ys, np.arange(h + 1)).tolist()
    places, out, above = xs.tolist(), [], [w] * 4
    for y in range(h):
        line = [*places[ends[y] : ends[y + 1]], w, w, w, w]
        x, colour, j, k = -1, 0, 0, 0
        while x < w:
            k = max(0, k - 1)
            k += (k ^ colour) & 1
            while above[k] <= x and above[k] < w:
                k += 2
            here = line[j]
            if above[k + 1] < here:
                out.append(_PASS)
                x = above[k + 1]
            elif abs(here - above[k]) <= 3:
                out.append(_VERTICAL[here - above[k]])
                x, colour, j = here, colour ^ 1, j + 1
            else:
                start, stop = max(x, 0), line[j + 1]
                out += (_HORIZONTAL, _run_code(here - start, colour), _run_code(stop - here, colour ^ 1))
                x, j = stop, j + 2
        above = line
    bits = "".join(out) + "000000000001" * 2
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


# --- JPEG -------------------------------------------------------------------------------------------------------

_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_WAVES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.125**0.5) for x in range(8)] for u in range(8)], np.float32)


def _huffman(counts: bytes, symbols: bytes) -> memoryview:
    """Length and symbol of the code that starts each 16 bits; 0 where none does."""
    table, start, k = np.zeros(65536, np.uint16), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            table[start : start + (1 << (16 - length))] = length << 8 | symbol
            start += 1 << (16 - length)
        k += n
    return memoryview(table)


class _Plane:
    """One component: its sampling, its tables and its coefficients, block by block."""

    def __init__(self, h: int, v: int, quant: int) -> None:
        self.h, self.v, self.quant = h, v, quant
        self.across = self.down = self.before = self.skip = 0
        self.dc = self.ac = memoryview(b"")
        self.first, self.last, self.low = 0, 63, 0
        self.found = array("i")

    def sized(self, across: int, down: int) -> None:
        self.across, self.down = across, down
        self.found = array("i", bytes(256 * across * down))

    # Each reader takes the bits, a place in them and the block's first coefficient, and returns the next place.

    def mean(self, bits: memoryview, at: int, base: int) -> int:
        code = self.dc[bits[at]]
        if not code:
            raise ValueError("no such code")
        at += code >> 8
        s = code & 255
        if s:
            v = bits[at] >> (16 - s)
            at += s
            self.before += v if v >> (s - 1) else v - (1 << s) + 1
        self.found[base] = self.before * (1 << self.low)
        return at

    def mean_bit(self, bits: memoryview, at: int, base: int) -> int:
        self.found[base] |= (bits[at] >> 15) << self.low
        return at + 1

    def block(self, bits: memoryview, at: int, base: int) -> int:
        return self.waves(bits, self.mean(bits, at, base), base, 1)

    def waves(self, bits: memoryview, at: int, base: int, k: int = 0) -> int:
        if self.skip:
            self.skip -= 1
            return at
        found, ac, last, low = self.found, self.ac, self.last, self.low
        k = k or self.first
        while k <= last:
            code = ac[bits[at]]
            if not code:
                raise ValueError("no such code")
            at += code >> 8
            run, s = code >> 4 & 15, code & 15
            if s:
                k += run
                v = bits[at] >> (16 - s)
                at += s
                found[base + _ZIGZAG[k]] = (v if v >> (s - 1) else v - (1 << s) + 1) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                self.skip = (1 << run) - 1 + (bits[at] >> (16 - run))
                return at + run
        return at

    def waves_bit(self, bits: memoryview, at: int, base: int) -> int:
        """One more bit of what is there, and what appears at this bit."""
        found, k, step = self.found, self.first, 1 << self.low
        zeros = new = 0
        while k <= self.last:
            if not self.skip:
                code = self.ac[bits[at]]
                if not code:
                    raise ValueError("no such code")
                at += code >> 8
                zeros, new = code >> 4 & 15, 0
                if code & 15:
                    new = step if bits[at] >> 15 else -step
                    at += 1
                elif zeros < 15:
                    self.skip = (1 << zeros) + (bits[at] >> (16 - zeros))
                    at += zeros
            while k <= self.last:
                place = base + _ZIGZAG[k]
                k += 1
                v = found[place]
                if v:
                    if bits[at] >> 15 and not abs(v) & step:
                        found[place] = v + (step if v > 0 else -step)
                    at += 1
                elif not self.skip:
                    if not zeros:
                        found[place] = new
                        break
                    zeros -= 1
        self.skip -= self.skip > 0
        return at

    def pixels(self, quant: np.ndarray) -> np.ndarray:
        f = (np.frombuffer(self.found, np.int32).reshape(-1, 64) * quant).reshape(-1, 8, 8)
        px = _WAVES.T @ f @ _WAVES
        return px.reshape(self.down, self.across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * self.down, 8 * self.across) + 128


def unjpeg(data: bytes, rgb: bool = False) -> np.ndarray | None:
    """Pixels (height, width, 1 or 3) of a sequential or progressive Huffman-coded file of 8 bits; None for other kinds.

    Three planes are luminance and colour differences, unless rgb is set or the
    file says so; coarser planes are repeated.
    """
    quants: dict[int, np.ndarray] = {}
    tables: dict[int, memoryview] = {}
    planes: dict[int, _Plane] = {}
    scanned: set[int] = set()
    width = height = every = 0
    stepwise = False
    at = 2
    while at + 4 <= len(data) and data[at + 1] != 0xD9:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if kind == 0xFF:
            at += 1
            continue
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                quant = np.zeros(64, np.float32)
                quant[_ZIGZAG] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
                quants[k], body = quant, body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = _huffman(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif kind in (0xC0, 0xC1, 0xC2):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            planes = {body[6 + 3 * k]: _Plane(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if depth != 8 or n not in (1, 3) or len(planes) != n or not width or not height:
                return None
            most_h, most_v = max(p.h for p in planes.values()), max(p.v for p in planes.values())
            for p in planes.values():
                p.sized(-(-width // (8 * most_h)) * p.h, -(-height // (8 * most_v)) * p.v)
            stepwise = kind == 0xC2
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            return None
        elif kind == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            rgb = body[11] == 0
        elif kind == 0xDA:
            found = _SCAN_END.search(data, at)
            stop = found.start() if found else len(data)
            scan = []
            for k in range(body[0]):
                p = planes[body[1 + 2 * k]]
                p.dc, p.ac = tables.get(body[2 + 2 * k] >> 4, p.dc), tables.get(16 | body[2 + 2 * k] & 15, p.ac)
                scan.append(p)
            first, last, bit = body[-3:]
            read = _Plane.block
            if stepwise:
                read = ((_Plane.waves_bit if first else _Plane.mean_bit) if bit >> 4 else (_Plane.waves if first else _Plane.mean))
                for p in scan:
                    p.first, p.last, p.low = first, last, bit & 15
            _scan(data[at:stop], scan, read, width, height, most_h, most_v, every)
            scanned |= set(map(id, scan))
            at = stop
    if not planes or not all(id(p) in scanned for p in planes.values()):
        return None
    ys, xs = np.arange(height), np.arange(width)
    out = [p.pixels(quants[p.quant])[(ys * p.v // most_v)[:, None], (xs * p.h // most_h)[None, :]] for p in planes.values()]
    if len(out) == 3 and not rgb:
        y, b, r = out[0], out[1] - 128, out[2] - 128
        out = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b]
    return np.stack(out, axis=-1).round().clip(0, 255).astype(np.uint8)


def _scan(data: bytes, scan: list[_Plane], read: Callable[[_Plane, memoryview, int, int], int], width: int, height: int, most_h: int, most_v: int, every: int) -> None:
    """Reads the blocks of a scan: of one plane row by row, of several in units of one of each sampling."""
    if len(scan) == 1:
        p = scan[0]
        across, down = -(-width * p.h // (8 * most_h)), -(-height * p.v // (8 * most_v))
        parts = [(p, 1, 1, 0, 0)]
    else:
        across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        parts = [(p, p.h, p.v, x, y) for p in scan for y in range(p.v) for x in range(p.h)]
    pieces = re.split(rb"\xff[\xd0-\xd7]", data) if every else [data]
    unit, units = 0, across * down
    for piece in pieces:
        bits, at = _windows(piece.replace(b"\xff\x00", b"\xff")), 0
        for p in scan:
            p.before = p.skip = 0
        for unit in range(unit, min(units, unit + (every or units))):
            y, x = divmod(unit, across)
            for p, h, v, dx, dy in parts:
                at = read(p, bits, at, 64 * ((y * v + dy) * p.across + x * h + dx))
        unit += 1
    if unit < units:
        raise ValueError("a scan cut short")
