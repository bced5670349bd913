"""Media columns: progressive JPEG, stored as bytes and read back into full-resolution RGB tensors.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays (ITU-T T.81,
annex G), transforms them back in numpy, upsamples chroma and gives one uint8 tensor (height, width, 3) per image. The
encoder stores payload bytes losslessly in the format's own unit, the quantised DCT coefficient: 64 bytes are one
luma block in zigzag order, coefficient = 256 + byte, all quantisers 1.

Python looks at Huffman symbols, not at bits: runs of symbols of equal length are decoded together, and the correction
bits of an end-of-band run are read at once for all its blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._text import slices

#: Bytes of payload in one block, which is also what a payload is padded to.
UNIT = 64
#: Bytes of payload in one image; a longer payload is several.
STRIP = 1 << 20
#: Successive approximation: bits that the first scans leave to the refinement scans.
_LOW = 1
#: Order in which the 64 coefficients of a block are stored, by rule: along anti-diagonals, in turn up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def _cosines() -> np.ndarray:
    """The 64 x 64 matrix that takes coefficients (row-major) to samples."""
    k = np.arange(8)
    c = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) / 2
    c[:, 0] /= np.sqrt(2)
    return np.einsum("xu,yv->uvxy", c, c).reshape(64, 64).astype(np.float32)


_IDCT = _cosines()

# ---------------------------------------------------------------- bits


def stuffed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes of a bit array: padded with ones, a zero byte after each 0xFF."""
    pad = -len(bits) % 8
    data = np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits)
    full = np.flatnonzero(data == 0xFF)
    return np.insert(data, full + 1, 0).tobytes() if len(full) else data.tobytes()


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Each value's ``width`` bits, highest first."""
    return ((values[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)


class Huffman:
    """A code table: code lengths 1..16 and symbols; looked up by the next 16 bits."""

    def __init__(self, counts: list[int], symbols: list[int]) -> None:
        self.counts, self.symbols = counts, symbols
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        self.code: dict[int, tuple[int, int]] = {}
        code = k = 0
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                low = code << (16 - size)
                self.length[low : low + (1 << (16 - size))], self.symbol[low : low + (1 << (16 - size))] = size, symbols[k]
                self.code[symbols[k]] = (code, size)
                code, k = code + 1, k + 1
            code <<= 1

    def bits(self, symbol: int) -> np.ndarray:
        code, size = self.code[symbol]
        return _bits(np.array([code]), size)[0]


@lru_cache(64)
def _table(counts: tuple[int, ...], symbols: tuple[int, ...]) -> Huffman:
    return Huffman(list(counts), list(symbols))


class Reader:
    """Bits of one entropy-coded segment (stuffing removed)."""

    def __init__(self, data: bytes) -> None:
        self.raw = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.uint32)
        self.end = 8 * len(data)
        self.at = 0
        self.all: np.ndarray | None = None

    def peek(self, at: np.ndarray | int) -> np.ndarray:
        """The 16 bits from each position."""
        i = at >> 3
        word = self.raw[i] << 16 | self.raw[i + 1] << 8 | self.raw[i + 2]
        return word >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF if isinstance(at, np.ndarray) else int(word) >> (8 - (at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        out = 0
        while n:
            k = min(n, 16)
            out = out << k | int(self.peek(self.at)) >> (16 - k)
            self.at, n = self.at + k, n - k
        return out

    def take_bits(self, n: int) -> np.ndarray:
        if self.all is None:
            self.all = np.unpackbits(self.raw.astype(np.uint8))
        out = self.all[self.at : self.at + n]
        self.at += n
        return out

    def symbols(self, table: Huffman, extra: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``most`` symbols, as far as there are any, and the values of their extra bits (``extra[symbol]`` many, 16 at
        most).

        Symbols of one length are decoded at that stride, more at a time as they keep fitting it.
        """
        got: list[np.ndarray] = []
        values: list[np.ndarray] = []
        have, tries = 0, 32
        while have < most and self.at < self.end:
            head = self.peek(self.at)
            stride = int(table.length[head]) + int(extra[table.symbol[head]])
            if not table.length[head]:
                break  # the ones that fill the last byte, or damage: the caller misses symbols then
            n = max(1, min(tries, most - have, (self.end - self.at) // stride))
            at = self.at + stride * np.arange(n)
            w = self.peek(at)
            s = table.symbol[w]
            fits = (table.length[w] + extra[s] == stride) & (table.length[w] > 0)
            k = n if fits.all() else int(np.argmin(fits))
            if k == n or k >= 24:
                at, s, w = at[:k], s[:k], w[:k]
                self.at += stride * k
                tries = min(2 * tries, 1 << 17)
            else:  # lengths change: find each symbol's length at every bit, then follow the chain
                span = min(4096, self.end - self.at)
                w = self.peek(self.at + np.arange(span))
                size = np.where(table.length[w] > 0, table.length[w].astype(np.int64) + extra[table.symbol[w]], 0).tolist()
                chain, p, room = [], 0, most - have
                while p < span and room and size[p]:
                    chain.append(p)
                    p += size[p]
                    room -= 1
                at = self.at + np.array(chain)
                w = w[chain]
                s = table.symbol[w]
                self.at += p
                k = len(chain)
                tries = 32
            e = extra[s].astype(np.int64)
            got.append(s)
            values.append(self.peek(at + table.length[w]).astype(np.int64) >> (16 - e))
            have += k
        if not got:
            return np.zeros(0, np.uint8), np.zeros(0, np.int64)
        return np.concatenate(got), np.concatenate(values)


def extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number that ``size`` extra bits stand for."""
    return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)


# ---------------------------------------------------------------- decoder


class Component:
    def __init__(self, ident: int, h: int, v: int, q: int) -> None:
        self.ident, self.h, self.v, self.q = ident, h, v, q
        self.coef = np.zeros((0, 64), np.int32)


class Decoder:
    """One progressive image: ``coefficients`` and ``tensor`` after construction."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.dc: dict[int, Huffman] = {}
        self.ac: dict[int, Huffman] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.parts: list[Component] = []
        self.restart = 0
        self.comment = b""
        at = 2
        while at < len(data):
            marker, at = data[at + 1], at + 2
            if marker == 0xD9:
                break
            size = struct.unpack(">H", data[at : at + 2])[0]
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._tables(body)
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not a progressive Huffman image")
            elif marker == 0xDA:
                at = self._scan(body, data, at)

    def _quantisers(self, b: bytes) -> None:
        while b:
            wide, k = b[0] >> 4, b[0] & 15
            n = 128 if wide else 64
            self.quant[k] = np.frombuffer(b[1 : 1 + n], ">u2" if wide else "u1").astype(np.float32)
            b = b[1 + n :]

    def _tables(self, b: bytes) -> None:
        while b:
            counts = list(b[1:17])
            n = sum(counts)
            (self.ac if b[0] >> 4 else self.dc)[b[0] & 15] = _table(tuple(counts), tuple(b[17 : 17 + n]))
            b = b[17 + n :]

    def _frame(self, b: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack(">BHHB", b[:6])
        if precision != 8:
            raise ValueError("8-bit samples only")
        self.parts = [Component(b[6 + 3 * i], b[7 + 3 * i] >> 4, b[7 + 3 * i] & 15, b[8 + 3 * i]) for i in range(n)]
        self.h, self.v = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.parts:
            c.wide, c.high = self.across * c.h, self.down * c.v
            c.own_wide, c.own_high = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.coef = np.zeros((c.wide * c.high, 64), np.int32)

    def _order(self, chosen: list[Component]) -> list[tuple[Component, np.ndarray]]:
        """The blocks of a scan in coding order: per unit, the blocks of each component."""
        if len(chosen) == 1:
            c = chosen[0]
            y, x = np.divmod(np.arange(c.own_wide * c.own_high), c.own_wide)
            return [(c, (y * c.wide + x)[:, None])]
        uy, ux = np.divmod(np.arange(self.across * self.down), self.across)
        out = []
        for c in chosen:
            dy, dx = np.divmod(np.arange(c.h * c.v), c.h)
            out.append((c, (uy[:, None] * c.v + dy) * c.wide + ux[:, None] * c.h + dx))
        return out

    def _scan(self, b: bytes, data: bytes, at: int) -> int:
        n = b[0]
        by = {c.ident: c for c in self.parts}
        chosen = [by[b[1 + 2 * i]] for i in range(n)]
        tables = [(b[2 + 2 * i] >> 4, b[2 + 2 * i] & 15) for i in range(n)]
        low, high, approx = b[1 + 2 * n], b[2 + 2 * n], b[3 + 2 * n]
        before, after = approx >> 4, approx & 15
        segments, at = self._segments(data, at)
        order = self._order(chosen)
        units = len(order[0][1])
        each = self.restart or units
        for k, segment in enumerate(segments):
            own = [(c, blocks[k * each : (k + 1) * each]) for c, blocks in order]
            if not len(own[0][1]):
                break
            r = Reader(segment)
            if low == 0:
                self._dc(r, own, tables, before, after)
            elif before == 0:
                self._ac_first(r, own[0][0], own[0][1][:, 0], self.ac[tables[0][1]], low, high, after)
            else:
                self._ac_refine(r, own[0][0], own[0][1][:, 0], self.ac[tables[0][1]], low, high, after)
        return at

    @staticmethod
    def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
        """Entropy-coded data up to the next marker, cut at restart markers, stuffing removed."""
        out, start = [], at
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise ValueError("the image ends in a scan")
            m = data[at + 1]
            if m == 0:
                at += 2
            elif 0xD0 <= m <= 0xD7:
                out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
                at += 2
                start = at
            elif m == 0xFF:
                at += 1
            else:
                out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
                return out, at

    def _dc(self, r: Reader, own: list, tables: list, before: int, after: int) -> None:
        widths = [blocks.shape[1] for _, blocks in own]
        units = len(own[0][1])
        per = sum(widths)
        if before:  # one correction bit for each block
            bits = r.take_bits(units * per).reshape(units, per).astype(np.int32) << after
            k = 0
            for c, blocks in own:
                c.coef[blocks, 0] |= bits[:, k : k + blocks.shape[1]]
                k += blocks.shape[1]
            return
        sizes = np.arange(256).astype(np.uint8)
        if len({t[0] for t in tables}) == 1:
            s, v = r.symbols(self.dc[tables[0][0]], sizes, units * per)
        else:  # tables change within a unit
            got = [r.symbols(self.dc[t[0]], sizes, w) for _ in range(units) for t, w in zip(tables, widths, strict=True)]
            s, v = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        if len(s) < units * per:
            raise ValueError("the scan ends early")
        diff = extend(v, s.astype(np.int64)).reshape(units, per)
        k = 0
        for c, blocks in own:
            c.coef[blocks, 0] = np.cumsum(diff[:, k : k + blocks.shape[1]]).reshape(blocks.shape) << after
            k += blocks.shape[1]

    @staticmethod
    def _ac_first(r: Reader, c: Component, blocks: np.ndarray, table: Huffman, low: int, high: int, after: int) -> None:
        k = np.arange(256)
        extra = np.where(k & 15, k & 15, np.where(k >> 4 < 15, k >> 4, 0)).astype(np.uint8)
        band, n = high - low + 1, len(blocks)
        block, place = 0, 0
        while block < n:
            # at most so many symbols can still belong here
            s, v = r.symbols(table, extra, (n - block) * band - place)
            if not len(s):
                raise ValueError("the scan ends early")
            run, size = (s >> 4).astype(np.int64), (s & 15).astype(np.int64)
            stop = np.flatnonzero((size == 0) & (run < 15))
            to = np.zeros(0, np.int64)
            begin = 0
            for e in [*stop.tolist(), len(s)]:
                if e > begin:  # coefficients and sixteen-zero runs move on within the band, block after block
                    step = run[begin:e] + 1
                    if (step == 1).all() and (size[begin:e] > 0).all():
                        to = place + np.arange(e - begin)
                        own, pos = np.divmod(to, band)
                        rows = blocks[block + own]
                        c.coef[rows, low + pos] = extend(v[begin:e], size[begin:e]) << after
                        block, place = block + (place + e - begin) // band, (place + e - begin) % band
                    else:
                        for i in range(begin, e if block < n else begin):
                            place += int(run[i])
                            if size[i]:
                                c.coef[blocks[block], low + place] = int(extend(v[i : i + 1], size[i : i + 1])[0]) << after
                            place += 1
                            if place >= band:
                                block, place = block + 1, 0
                if e < len(s):
                    block, place = block + (1 << int(run[e])) + int(v[e]), 0
                begin = e + 1

    @staticmethod
    def _ac_refine(r: Reader, c: Component, blocks: np.ndarray, table: Huffman, low: int, high: int, after: int) -> None:
        one = 1 << after

        def correct(rows: np.ndarray, begin: int) -> None:
            """Correction bits of all coefficients of ``rows`` (the first from ``begin`` on) that aren't zero yet."""
            view = c.coef[rows, low : high + 1]
            live = view != 0
            if begin == low and live.all():
                bits = r.take_bits(view.size).reshape(view.shape).astype(np.int32)
                c.coef[rows, low : high + 1] = view + np.sign(view) * bits * one
                return
            if begin > low:
                live[0, : begin - low] = False
            bits = r.take_bits(int(live.sum())).astype(np.int32)
            view[live] += np.sign(view[live]) * bits * one
            c.coef[rows, low : high + 1] = view

        block = 0
        while block < len(blocks):
            row, k = blocks[block], low
            while k <= high:
                w = r.peek(r.at)
                s = int(table.symbol[w])
                if not table.length[w]:
                    raise ValueError("bad Huffman code")
                r.at += int(table.length[w])
                run, size = s >> 4, s & 15
                if size == 0 and run < 15:
                    n = (1 << run) + (r.take(run) if run else 0)
                    correct(blocks[block : block + n], k)
                    block += n
                    break
                value = (one if r.take(1) else -one) if size else 0
                own = c.coef[row]
                while k <= high:
                    if own[k]:
                        if r.take(1):
                            own[k] += one if own[k] > 0 else -one
                    elif run == 0:
                        if value:
                            own[k] = value
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
            else:
                block += 1

    def planes(self) -> list[np.ndarray]:
        """Samples of each component, before upsampling, as floats around 0."""
        out = []
        for c in self.parts:
            plain = np.empty((len(c.coef), 64), np.float32)
            plain[:, ZIGZAG] = c.coef * self.quant[c.q]
            pixels = plain @ _IDCT if plain.any() else np.zeros_like(plain)
            out.append(pixels.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.high, 8 * c.wide))
        return out

    def tensor(self) -> np.ndarray:
        """uint8 (height, width, 3); chroma is repeated to full resolution, grey images have three equal channels."""
        full = []
        for c, p in zip(self.parts, self.planes(), strict=True):
            ry, rx = self.v // c.v, self.h // c.h
            p = p if ry == rx == 1 else np.repeat(np.repeat(p, ry, 0), rx, 1)
            full.append(p[: self.height, : self.width])
        y = full[0] + 128
        if len(full) < 3:
            return np.repeat(np.clip(np.rint(y), 0, 255).astype(np.uint8)[:, :, None], 3, 2)
        out = np.empty((self.height, self.width, 3), np.uint8)
        cb, cr = full[1], full[2]
        if not cb.any() and not cr.any():
            out[:] = np.clip(np.rint(y), 0, 255).astype(np.uint8)[:, :, None]
            return out
        for i, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            out[:, :, i] = np.clip(np.rint(x), 0, 255)
        return out


# ---------------------------------------------------------------- payload images

#: Four bits for each size of a DC difference; one bit for a coefficient of eight bits, five for each end-of-band run.
_DC = Huffman([0, 0, 0, 10, *[0] * 12], list(range(10)))
_AC = Huffman([1, 0, 0, 0, 15, *[0] * 11], [8, *range(0, 0xF0, 0x10)])
#: Bits of each coefficient's first scan: code, then its eight upper bits.
_FIRST = np.concatenate([np.broadcast_to(_AC.bits(8), (256, 1)), _bits(np.arange(256), 8)], 1)


def _header(high: int, wide: int, size: int) -> bytes:
    part = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    frame = struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = b"".join(bytes([k]) + bytes(t.counts) + bytes(t.symbols) for k, t in ((0, _DC), (0x10, _AC)))
    return b"\xff\xd8" + part(0xFE, struct.pack(">Q", size)) + part(0xDB, b"\0" + b"\x01" * 64) + part(0xC2, frame) + part(0xC4, tables)


def _sos(parts: list[int], low: int, high: int, before: int, after: int) -> bytes:
    b = bytes([len(parts)]) + b"".join(bytes([p, 0]) for p in parts) + bytes([low, high, before << 4 | after])
    return b"\xff\xda" + struct.pack(">H", len(b) + 2) + b


def shape_of(blocks: int) -> tuple[int, int]:
    """(rows, columns) of luma blocks, both even, that hold so many with little left over; depends on the number alone."""
    even = lambda x: 2 * -(-x // 2)
    root = int(np.ceil(np.sqrt(blocks)))
    wide = min(range(even(max(2, root // 2)), even(max(2, root)) + 1, 2), key=lambda w: (even(-(-blocks // w)) * w, -w)) if root < 8000 else 8190
    return even(-(-blocks // wide)), wide


def encode(payload: bytes, wide: int | None = None) -> bytes:
    """A colour image (4:2:0, neutral chroma) whose luma coefficients hold the payload, in five scans: DC of all
    components, AC 1-5 and 6-63 of luma, all without their lowest bit, then the refinements of AC and DC. The payload
    is a positive multiple of 64 bytes; its length stands in a comment segment. ``wide`` fixes the columns of luma blocks."""
    n = len(payload) // UNIT
    high, wide = shape_of(n) if wide is None else (2 * -(-n // (2 * wide)), wide)
    if high > 8190:
        raise ValueError("payload too large for one image")
    data = np.zeros((high * wide, 64), np.uint8)
    data[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    out = [_header(high, wide, len(payload))]
    # DC, interleaved: four luma blocks and two of chroma per unit
    uy, ux = np.divmod(np.arange(high * wide // 4), wide // 2)
    dy, dx = np.divmod(np.arange(4), 2)
    order = ((2 * uy[:, None] + dy) * wide + 2 * ux[:, None] + dx).ravel()
    dc = 256 + data[order, 0].astype(np.int64)
    grid = np.zeros((len(order) // 4, 6), np.int64)
    grid[:, :4] = np.diff(dc >> _LOW, prepend=0).reshape(-1, 4)
    d = grid.ravel()
    size = np.ceil(np.log2(np.abs(d) + 1)).astype(np.int64)
    word = size << size | np.where(d < 0, d + (1 << size) - 1, d)
    out += [_sos([1, 2, 3], 0, 0, 0, _LOW), stuffed(_bits(word, 13)[np.arange(13) >= 9 - size[:, None]])]
    for low, top in ((1, 5), (6, 63)):
        out += [_sos([1], low, top, 0, _LOW), stuffed(_FIRST[128 + (data[:, low : top + 1].ravel() >> _LOW)].ravel())]
    # every coefficient is set already: the refinement is end-of-band runs, each with its blocks' raw bits
    raw = data & 1
    bits, at = [], 0
    while at < len(raw):
        m = min(len(raw) - at, (1 << 15) - 1)
        r = m.bit_length() - 1
        bits += [_AC.bits(r << 4), _bits(np.array([m - (1 << r)]), r)[0], raw[at : at + m, 1:].ravel()]
        at += m
    out += [_sos([1], 1, 63, 1, 0), stuffed(np.concatenate(bits))]
    last = np.zeros((len(order) // 4, 6), np.uint8)
    last[:, :4] = raw[order, 0].reshape(-1, 4)
    out += [_sos([1, 2, 3], 0, 0, 1, 0), stuffed(last.ravel()), b"\xff\xd9"]
    return b"".join(out)


def payload_of(image: Decoder) -> bytes:
    """The payload that :func:`encode` stored, from the coefficients."""
    n = struct.unpack(">Q", image.comment)[0]
    return (image.parts[0].coef[: n // UNIT] - 256).astype(np.uint8).tobytes()


def strips(payload: bytes) -> bytes:
    """The payload as images of ``STRIP`` bytes each, one after the other, all of one width; one image where that is enough."""
    if len(payload) <= STRIP:
        return encode(payload)
    wide = shape_of(STRIP // UNIT)[1]
    return b"".join(encode(payload[at : at + STRIP], wide) for at in range(0, len(payload), STRIP))


def images(media: bytes) -> Iterator[Decoder]:
    """The images of :func:`strips`, one at a time; other media are one image."""
    at = 0
    while at < len(media):
        # within an image FF D9 is its end alone: data bytes FF are followed by 00, and no segment of encode holds the pair
        end = media.find(b"\xff\xd9\xff\xd8", at)
        end = len(media) if end < 0 or not _stored(media) else end + 2
        yield Decoder(media[at:end])
        at = end


def _stored(media: bytes) -> bool:
    """Whether media begin as :func:`encode` writes them: with a comment of eight bytes."""
    return media[:6] == b"\xff\xd8\xff\xfe\x00\x0a"


# ---------------------------------------------------------------- columns


def store(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with ``out``: each text's UTF-8 bytes, padded by zero bytes to a positive multiple of 64, as a progressive
    image. Null and empty texts give an image of 64 zero bytes. Equal texts give equal bytes. Other columns are kept, one
    named ``out`` is replaced. Rows are independent. A text above ``STRIP`` bytes becomes several images of one width, one after the other, so
    memory beyond the text and its media is that of one strip."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            media = []
            for t in pc.fill_null(b.column(text), "").cast(pa.large_binary()):
                raw = t.as_py()
                media.append(strips(raw + bytes(-len(raw) % UNIT if raw else UNIT)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(media, pa.binary())], [*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


def load(df: DataFrame, media: str = "media", payload: bool = True) -> DataFrame:
    """``df`` with height, width and tensor (uint8, height x width x 3, row-major) of the progressive image in ``media``,
    and ``payload``, the bytes that :func:`store` put there (null for other images). Strips of one text stand below each other in
    its tensor. A null image has nulls. Columns of
    these names are replaced, others kept."""
    new = [("height", T.IntegerType(), pa.int32()), ("width", T.IntegerType(), pa.int32()), ("tensor", T.BinaryType(), pa.binary()), ("payload", T.BinaryType(), pa.binary())]
    keep = [c for c in df.columns if c not in {n for n, _, _ in new}]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, k) for n, k, _ in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, media, 2 << 20):
            rows = []
            for m in b.column(media):
                if not m.is_valid:
                    rows.append((None, None, None, None))
                    continue
                high, wide, tensor, data = 0, 0, [], []
                for image in images(m.as_py()):
                    high, wide = high + image.height, image.width
                    tensor.append(image.tensor().tobytes())
                    data.append(payload_of(image) if payload and len(image.comment) == 8 else None)
                rows.append((high, wide, b"".join(tensor), None if None in data else b"".join(data)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array([r[i] for r in rows], k) for i, (_, _, k) in enumerate(new)]], [*keep, *[n for n, _, _ in new]])

    return df.select(*keep).mapInArrow(run, schema)
