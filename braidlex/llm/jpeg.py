"""Progressive JPEG in numpy: a lossless container of bytes, and a decoder.

The container keeps one payload byte as one DCT coefficient, the format's
unit, so the format's rounding of samples never touches it. Quantisation is 1;
4 luma blocks and 1 block of each chroma component (4:2:0) hold 6 x 64 bytes.
A byte ``b`` is the AC coefficient ``b`` if it is 128 or more, else ``b - 255``
(magnitudes 128 to 255: no zeros, one size category), or the DC coefficient
``256 + b``. Scans: DC in two successive approximations, AC in spectral bands
1-5 and 6-63 (luma) or 1-63 (chroma) without the lowest bit, then the lowest
bits. As all sizes are equal, the Huffman tables give codes of equal length
and numpy reads or writes a scan at once. Scans of any other shape (any tables,
zero runs, end-of-band runs, interleaving, restarts) are read bit by bit.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Natural positions of the coefficients in zigzag order.
ZIGZAG = np.array([i for d in range(15) for i in sorted((y * 8 + d - y for y in range(8) if 0 <= d - y < 8), key=lambda p: p // 8 if d % 2 else -(p // 8))])

UNIT = 64
#: Component id, and its blocks across and down in a 16 x 16 unit.
COMPONENTS = ((1, 2), (2, 1), (3, 1))
_DC_TABLE = (0x00, [0] * 7 + [1] + [0] * 8, [8])
_AC_TABLE = (0x10, [1] + [0] * 15, [0x07])
_EOB_TABLE = (0x11, [0, 0, 0, 15] + [0] * 12, [i << 4 for i in range(15)])
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTARTS = np.arange(0xD0, 0xD8, dtype=np.uint8)


def _idct_matrix() -> np.ndarray:
    """Rows: zigzag coefficients; columns: the 64 samples of a block."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, math.sqrt(0.125), 0.5)
    both = np.einsum("vy,ux->vuyx", one, one).reshape(64, 64)
    return both[ZIGZAG].astype(np.float32)


IDCT = _idct_matrix()


def _segment(marker: int, body: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def _table_segment(table: tuple) -> bytes:
    kind, lengths, symbols = table
    return _segment(0xC4, bytes([kind, *lengths, *symbols]))


def _scan_header(component: int, table: int, band: tuple[int, int], high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component, table, *band, high << 4 | low]))


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _bits_to_bytes(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    if pad:
        bits = np.concatenate([bits, np.ones(pad, np.uint8)])
    return _stuffed(np.packbits(bits).tobytes())


def _dc_first(dc: np.ndarray) -> bytes:
    """One restart interval for each block, so each difference is the value itself."""
    n = len(dc)
    out = np.empty((n, 4), np.uint8)
    out[:, 0] = 0
    out[:, 1] = 128 + (dc >> 1)
    out[:, 2] = 0xFF
    out[:, 3] = np.resize(_RESTARTS, n)
    if (out[:, 1] == 0xFF).any():
        return b"".join(_stuffed(bytes(r[:2])) + bytes(r[2:]) for r in out)[:-2]
    return out.tobytes()[:-2]


def _ac_refine(low: np.ndarray) -> bytes:
    """End-of-band runs over blocks whose coefficients are all known, each with the bits that they gain."""
    parts = []
    for k in range(0, len(low), 32767):
        run = min(32767, len(low) - k)
        n = run.bit_length() - 1
        head = n << n | (run - (1 << n))
        parts.append(np.array([head >> i & 1 for i in range(n + 3, -1, -1)], np.uint8))
        parts.append(low[k : k + run].ravel())
    return _bits_to_bytes(np.concatenate(parts))


_START = b"\xff\xd8" + _segment(0xDB, bytes([0] + [1] * 64))
_TABLES = b"".join(map(_table_segment, (_DC_TABLE, _AC_TABLE, _EOB_TABLE)))
_RESTART_1, _RESTART_0 = _segment(0xDD, b"\x00\x01"), _segment(0xDD, b"\x00\x00")


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as a progressive JPEG file."""
    n = len(payload) // UNIT
    units = -(-n // 6)
    across = math.isqrt(units - 1) + 1
    down = -(-units // across)
    units = across * down
    flat = np.zeros(units * 6 * UNIT, np.uint8)
    flat[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = flat.reshape(-1, UNIT)
    half = blocks >> 1
    low = (blocks & 1) ^ (blocks < 128)
    frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + b"".join(bytes([c, size << 4 | size, 0]) for c, size in COMPONENTS)
    out = [_START, _segment(0xFE, b"payload %d" % len(payload)), _segment(0xC2, frame), _TABLES, _RESTART_1]
    parts = [(c, slice(k, k + n)) for (c, _), k, n in zip(COMPONENTS, (0, 4 * units, 5 * units), (4 * units, units, units), strict=True)]
    for c, at in parts:
        out += [_scan_header(c, 0x00, (0, 0), 0, 1), _dc_first(blocks[at, 0])]
    out.append(_RESTART_0)
    for c, at in parts:
        out += [_scan_header(c, 0x00, (0, 0), 1, 0), _bits_to_bytes(blocks[at, 0] & 1)]
        for first, last in ((1, 5), (6, 63)) if c == 1 else ((1, 63),):
            out += [_scan_header(c, 0x00, (first, last), 0, 1), half[at, first : last + 1].tobytes()]
        out += [_scan_header(c, 0x01, (1, 63), 1, 0), _ac_refine(low[at, 1:])]
    out.append(b"\xff\xd9")
    return b"".join(out)


@dataclass
class Component:
    ident: int
    across: int
    down: int
    quantiser: int
    width: int = 0
    height: int = 0
    stride: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    """Coefficient arrays of a file, in zigzag order, and what goes with them."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""

    def payload(self) -> bytes:
        """The bytes that ``encode`` stored."""
        if not self.comment.startswith(b"payload "):
            raise ValueError("this file holds no payload")
        c = np.concatenate([x.coefficients for x in self.components])
        out = np.where(c < 0, c + 255, c).astype(np.int32)
        out[:, 0] = c[:, 0] - 256
        return out.astype(np.uint8).tobytes()[: int(self.comment[8:])]

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor (height, width, 3), chroma samples repeated."""
        most_x, most_y = max(c.across for c in self.components), max(c.down for c in self.components)
        planes = []
        for c in self.components:
            scaled = c.coefficients.astype(np.float32) * self.quantisers[c.quantiser]
            samples = scaled @ IDCT
            samples += 128.5
            np.clip(samples, 0, 255, out=samples)
            plane = samples.astype(np.uint8).reshape(-1, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(-1, c.stride * 8)
            if (most_x, most_y) != (c.across, c.down):
                plane = plane.repeat(most_y // c.down, axis=0).repeat(most_x // c.across, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        y, cb, cr = planes[0].astype(np.float32), planes[1].astype(np.float32) - 128, planes[2].astype(np.float32) - 128
        out = np.empty((*y.shape, 3), np.float32)
        out[:, :, 0] = y + 1.402 * cr
        out[:, :, 1] = y - 0.344136 * cb - 0.714136 * cr
        out[:, :, 2] = y + 1.772 * cb
        out += 0.5
        np.clip(out, 0, 255, out=out)
        return out.astype(np.uint8)


class Bits:
    """Bits of one scan, one by one."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.left, self.value = data, 0, 0, 0

    def bit(self) -> int:
        if not self.left:
            self.value = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at += 1
            if self.value == 0xFF and self.at < len(self.data) and self.data[self.at] == 0:
                self.at += 1
            self.left = 8
        self.left -= 1
        return self.value >> self.left & 1

    def number(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def signed(self, n: int) -> int:
        value = self.number(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = length = 0
        while length < 17:
            code, length = code << 1 | self.bit(), length + 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def restart(self) -> None:
        self.left = 0
        while self.at < len(self.data) and not (self.data[self.at] == 0xFF and self.at + 1 < len(self.data) and 0xD0 <= self.data[self.at + 1] <= 0xD7):
            self.at += 1
        self.at += 2


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _fast_scan(c: Component, data: bytes, codes: dict, band: tuple[int, int], high: int, low: int, restart: int) -> bool:
    """Scans of one component with codes of equal length, at once. False: the scan has another shape."""
    first, last = band
    grid = c.coefficients
    n = len(grid)
    if last == 0:
        if high:
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
            if restart or len(bits) < n:
                return False
            grid[:, 0] |= bits[:n].astype(np.int32) << low
            return True
        if restart != 1 or codes != {(8, 0): 8} or len(data) != 4 * n - 2:
            return False
        records = np.frombuffer(data + b"\xff" + bytes([_RESTARTS[(n - 1) % 8]]), np.uint8).reshape(n, 4)
        value = records[:, 1]
        if records[:, 0].any() or (records[:, 2] != 0xFF).any() or (records[:, 3] != np.resize(_RESTARTS, n)).any() or (value < 128).any():
            return False
        grid[:, 0] = value.astype(np.int32) << low
        return True
    width = last - first + 1
    if restart:
        return False
    if not high:
        if codes != {(1, 0): 0x07} or len(data) != n * width:
            return False
        value = np.frombuffer(data, np.uint8).reshape(n, width)
        if (value > 127).any():
            return False
        signed = value.astype(np.int32)
        signed -= 127 * (signed < 64)
        grid[:, first : last + 1] = signed << low if low == 0 else signed * (1 << low)
        return True
    old = grid[:, first : last + 1]
    if not old.all():
        return False
    bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
    at, block, gained = 0, 0, []
    while block < n:
        code = length = 0
        while (length, code) not in codes:
            if length > 16 or at >= len(bits):
                return False
            code, length, at = code << 1 | int(bits[at]), length + 1, at + 1
        symbol = codes[length, code]
        if symbol & 15 or symbol == 0xF0:
            return False
        more = symbol >> 4
        run = 1 << more
        for i in range(more):
            run += int(bits[at + i]) << (more - 1 - i)
        at += more
        run = min(run, n - block)
        if at + run * width > len(bits):
            return False
        gained.append(bits[at : at + run * width])
        at += run * width
        block += run
    gain = np.concatenate(gained).reshape(n, width).astype(np.int32) << low
    grid[:, first : last + 1] = np.where(old < 0, old - gain, old + gain)
    return True


def _slow_scan(image: Image, chosen: list[tuple[Component, dict, dict]], data: bytes, band: tuple[int, int], high: int, low: int, restart: int) -> None:
    """Any progressive scan, bit by bit."""
    bits = Bits(data)
    first, last = band
    before = [0] * len(chosen)
    run = 0

    def dc(i: int, block: np.ndarray) -> None:
        if high:
            block[0] |= bits.bit() << low
        else:
            before[i] += bits.signed(bits.symbol(chosen[i][1]))
            block[0] = before[i] << low

    def ac_first(codes: dict, block: np.ndarray) -> None:
        nonlocal run
        if run:
            run -= 1
            return
        k = first
        while k <= last:
            symbol = bits.symbol(codes)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                block[k] = bits.signed(size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.number(zeros) - 1
                return

    def gain(block: np.ndarray, k: int) -> None:
        if bits.bit():
            block[k] += (1 << low) if block[k] > 0 else -(1 << low)

    def ac_refine(codes: dict, block: np.ndarray) -> None:
        nonlocal run
        k = first
        if not run:
            while k <= last:
                symbol = bits.symbol(codes)
                zeros, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = (1 << low) if bits.bit() else -(1 << low)
                elif zeros < 15:
                    run = (1 << zeros) + bits.number(zeros)
                    break
                while k <= last:
                    if block[k]:
                        gain(block, k)
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if value and k <= last:
                    block[k] = value
                k += 1
        if run:
            for j in range(k, last + 1):
                if block[j]:
                    gain(block, j)
            run -= 1

    if len(chosen) == 1:
        c = chosen[0][0]
        order = [[(0, y * c.stride + x)] for y in range(c.height) for x in range(c.width)]
    else:
        big = image.components
        most_x, most_y = max(c.across for c in big), max(c.down for c in big)
        units_x, units_y = -(-image.width // (8 * most_x)), -(-image.height // (8 * most_y))
        order = [
            [(i, (uy * c.down + y) * c.stride + ux * c.across + x) for i, (c, _, _) in enumerate(chosen) for y in range(c.down) for x in range(c.across)]
            for uy in range(units_y)
            for ux in range(units_x)
        ]
    for number, unit in enumerate(order):
        if restart and number and number % restart == 0:
            bits.restart()
            before, run = [0] * len(chosen), 0
        for i, at in unit:
            block = chosen[i][0].coefficients[at]
            if last == 0:
                dc(i, block)
            elif high:
                ac_refine(chosen[i][2], block)
            else:
                ac_first(chosen[i][2], block)


def decode(data: bytes, fast: bool = True) -> Image:
    """Accumulate all scans of a progressive file into coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, tables, restart, at = Image(), {}, 0, 2
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                n = 64 << wide
                image.quantisers[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                k += 1 + n
        elif marker == 0xC2:
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            most_x, most_y = max(c.across for c in image.components), max(c.down for c in image.components)
            units_x, units_y = -(-image.width // (8 * most_x)), -(-image.height // (8 * most_y))
            for c in image.components:
                c.width, c.height = -(-image.width * c.across // (8 * most_x)), -(-image.height * c.down // (8 * most_y))
                c.stride = units_x * c.across
                c.coefficients = np.zeros((c.stride * units_y * c.down, 64), np.int32)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = _codes(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            n = body[0]
            by_id = {c.ident: c for c in image.components}
            chosen = [(by_id[body[1 + 2 * i]], tables.get(body[2 + 2 * i] >> 4, {}), tables.get(0x10 | body[2 + 2 * i] & 15, {})) for i in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            found = _END.search(data, at)
            end = found.start() if found else len(data)
            part = data[at:end]
            at = end
            c, dc_codes, ac_codes = chosen[0]
            whole = n == 1 and len(c.coefficients) == c.width * c.height
            args = (part, dc_codes if last == 0 else ac_codes, (first, last), approx >> 4, approx & 15, restart)
            if not (fast and whole and _fast_scan(c, *args)):
                _slow_scan(image, chosen, part, (first, last), approx >> 4, approx & 15, restart)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only progressive Huffman files are read here")
    if not image.components:
        raise ValueError("no frame in this file")
    return image
