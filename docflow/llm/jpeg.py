"""Baseline JPEG frames (Huffman-coded DCT of 8 bits), decoded to luminance.

Motion-JPEG frames often leave out their Huffman tables; the usual ones then hold. Colour frames give their
first component, which is luminance; progressive, arithmetic and 12-bit frames raise a ValueError.
"""

from __future__ import annotations

import struct

import numpy as np

# Number of codes by length and symbols of the usual Huffman tables (luminance DC and AC, chrominance DC and AC).
USUAL_TABLES = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
        "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x11: (
        "00020102040403040705040400010277",
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a43444546474849"
        "4a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
        "c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


def zigzag() -> np.ndarray:
    """Places (row * 8 + column) of the coefficients in the order in which they are coded: along the
    antidiagonals, up and down in turn."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ORDER = zigzag()
BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.125**0.5) for x in range(8)] for u in range(8)])


def huffman(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) for each start of 16 bits; length 0 where no code matches."""
    table: list[tuple[int, int]] = [(0, 0)] * 65536
    code = k = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            low = code << (16 - n)
            table[low : low + (1 << (16 - n))] = [(symbols[k], n)] * (1 << (16 - n))
            code, k = code + 1, k + 1
        code <<= 1
    return table


_USUAL: dict[int, list] = {}


def _usual(number: int) -> list[tuple[int, int]]:
    if number not in _USUAL:
        _USUAL[number] = huffman(*(bytes.fromhex(x.replace(" ", "")) for x in USUAL_TABLES[number]))
    return _USUAL[number]


class _Bits:
    """Bits of a scan without its stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.value = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 6].ljust(6, b"\xff")
        self.at += 6
        self.value, self.have = (self.value << 48) | int.from_bytes(part, "big"), self.have + 48

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.have < 16:
            self.fill()
        found, n = table[(self.value >> (self.have - 16)) & 0xFFFF]
        if not n or self.at > len(self.data) + 12:
            raise ValueError("a frame's scan is damaged")
        self.have -= n
        self.value &= (1 << self.have) - 1
        return found

    def number(self, n: int) -> int:
        """A signed number of n bits."""
        if not n:
            return 0
        if self.have < n:
            self.fill()
        self.have -= n
        v = self.value >> self.have
        self.value &= (1 << self.have) - 1
        return v if v >> (n - 1) else v - (1 << n) + 1


def _block(bits: _Bits, dc: list, ac: list, before: int) -> list[int]:
    """Coefficients of a block in coded order."""
    out = [0] * 64
    out[0] = before + bits.number(bits.symbol(dc))
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        if s == 0:
            break
        k += s >> 4
        if s & 15:
            if k > 63:
                raise ValueError("a frame's scan is damaged")
            out[k] = bits.number(s & 15)
        k += 1
    return out


def luminance(data: bytes) -> np.ndarray:
    """Luminance of a baseline JPEG, (height, width) of bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("a frame isn't JPEG")
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, list] = {}
    frame, every, at = None, 0, 2
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError("a frame has bytes between its segments")
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if mark == 255:
            at += 1
            continue
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not height or not width:
                raise ValueError("a frame of other than 8 bits, or without size")
            frame = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError(f"a frame is coded by JPEG process C{mark - 0xC0:X}")
        elif mark == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            break
    else:
        raise ValueError("a frame has no scan")
    if frame is None or body[0] != len(frame):
        raise ValueError("a frame whose scan lacks components")
    use = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    get = lambda kind, n: tables.get(kind << 4 | n) or _usual(kind << 4 | n)
    parts = [(h, v, get(0, use[c] >> 4), get(1, use[c] & 15)) for c, h, v, _ in frame]
    if len(parts) == 1:
        parts[0] = (1, 1, *parts[0][2:])
    wide, tall = max(p[0] for p in parts), max(p[1] for p in parts)
    cols, rows = -(-width // (8 * wide)), -(-height // (8 * tall))
    h0, v0 = parts[0][:2]
    blocks = np.zeros((rows * v0, cols * h0, 64))
    pieces = _restarts(data[at:], every)
    bits, last, left = _Bits(next(pieces)), [0] * len(parts), every
    for m in range(rows * cols):
        if every and not left:
            bits, last, left = _Bits(next(pieces, b"")), [0] * len(parts), every
        left -= 1
        y, x = divmod(m, cols)
        for k, (h, v, dc, ac) in enumerate(parts):
            for j in range(v):
                for i in range(h):
                    found = _block(bits, dc, ac, last[k])
                    last[k] = found[0]
                    if k == 0:
                        blocks[y * v0 + j, x * h0 + i] = found
    level = np.zeros_like(blocks)
    level[:, :, ORDER] = blocks * quant[frame[0][3]]
    level = level.reshape(*blocks.shape[:2], 8, 8)
    pixels = np.einsum("ui,yxuv,vj->yixj", BASIS, level, BASIS).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
    pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
    if (h0, v0) != (wide, tall):
        pixels = np.repeat(np.repeat(pixels, tall // v0, axis=0), wide // h0, axis=1)
    return pixels[:height, :width]


def _restarts(scan: bytes, every: int):
    """The scan's intervals, unstuffed, up to the end mark."""
    start = at = 0
    while True:
        at = scan.find(b"\xff", at)
        if at < 0 or at + 1 >= len(scan):
            yield scan[start:].replace(b"\xff\x00", b"\xff")
            return
        mark = scan[at + 1]
        if mark == 0 or mark == 255:
            at += 2 if mark == 0 else 1
        elif 0xD0 <= mark <= 0xD7 and every:
            yield scan[start:at].replace(b"\xff\x00", b"\xff")
            start = at = at + 2
        else:
            yield scan[start:at].replace(b"\xff\x00", b"\xff")
            return
