import hashlib
import random

import numpy as np

from lexatlas.llm import media as m


def test_payload_round_trip():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 64, 65, 700):
        p = bytes(rng.randrange(256) for _ in range(64 * n))
        image = m.Decoder(m.encode(p))
        assert m.payload_of(image) == p and image.tensor().shape == (image.height, image.width, 3)


def test_strips_round_trip(monkeypatch):
    """A payload above one image's is several images of one width, the last one shorter; others are as before."""
    monkeypatch.setattr(m, "STRIP", 64 * 50)
    rng = random.Random(3)
    for n in (50, 51, 100, 149, 777):
        p = bytes(rng.choice((255, 217, 216, rng.randrange(256))) for _ in range(64 * n))
        found = list(m.images(m.strips(p)))
        assert len(found) == -(-n // 50) and len({i.width for i in found}) == 1
        assert b"".join(map(m.payload_of, found)) == p
    p = bytes(range(64))
    assert m.strips(p) == m.encode(p)


def test_long_text(spark):
    text = "".join(chr(33 + i * i % 900) for i in range(1_300_000))
    read = m.load(m.store(spark.createDataFrame([(1, text)], "doc_id int, text string"))).first()
    data = text.encode()
    assert len(data) > 2 * m.STRIP
    assert bytes(read["payload"]) == data + bytes(-len(data) % 64)
    assert len(read["tensor"]) == read["height"] * read["width"] * 3


class Writer:
    """A plain progressive encoder for arbitrary coefficients, symbol by symbol."""

    def __init__(self):
        self.bits = []

    def put(self, value, size):
        self.bits += [(value >> i) & 1 for i in range(size - 1, -1, -1)]


DC = m.Huffman([0, 0, 0, 12, *[0] * 12], list(range(12)))
AC = m.Huffman([0] * 7 + [255] + [0] * 8, list(range(255)))


def symbol(w, table, s):
    w.put(*table.code[s])


def magnitude(v):
    size = int(abs(v)).bit_length()
    return size, v if v >= 0 else v + (1 << size) - 1


def shifted(v, by):
    return abs(int(v)) >> by if v >= 0 else -(abs(int(v)) >> by)


def ac_first(blocks, low, high, by):
    w = Writer()
    for b in blocks:
        run = 0
        for k in range(low, high + 1):
            v = shifted(b[k], by)
            if not v:
                run += 1
                continue
            while run > 15:
                symbol(w, AC, 0xF0)
                run -= 16
            size, bits = magnitude(v)
            symbol(w, AC, run << 4 | size)
            w.put(bits, size)
            run = 0
        if run:
            symbol(w, AC, 0)
    return m.stuffed(np.array(w.bits, np.uint8))


def ac_refine(blocks, low, high, by):
    w = Writer()
    for b in blocks:
        last = max([k for k in range(low, high + 1) if shifted(b[k], by) and not shifted(b[k], by + 1)], default=low - 1)
        run, pending = 0, []
        for k in range(low, high + 1):
            if shifted(b[k], by + 1):
                pending.append(abs(shifted(b[k], by)) & 1)
            elif k <= last and shifted(b[k], by):
                symbol(w, AC, run << 4 | 1)
                w.put(int(b[k] > 0), 1)
                w.bits += pending
                run, pending = 0, []
            else:
                if k < last and run == 15:
                    symbol(w, AC, 0xF0)
                    w.bits += pending
                    run, pending = 0, []
                else:
                    run += 1
        if last < high:
            symbol(w, AC, 0)
            w.bits += pending
    return m.stuffed(np.array(w.bits, np.uint8))


def image_of(coef, high, wide, restart=0):
    """(bytes, coefficients by component): 4:2:0 colour with quantisers above 1."""
    import struct

    part = lambda k, b: bytes([0xFF, k]) + struct.pack(">H", len(b) + 2) + b
    out = [b"\xff\xd8", part(0xDB, b"\0" + bytes(range(1, 65)))]
    out.append(part(0xC2, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    for k, t in ((0, DC), (0x10, AC)):
        out.append(part(0xC4, bytes([k]) + bytes(t.counts) + bytes(t.symbols)))
    w, last = Writer(), [0, 0, 0]
    for uy in range(high // 2):
        for ux in range(wide // 2):
            for c, places in ((0, [(2 * uy + dy) * wide + 2 * ux + dx for dy in (0, 1) for dx in (0, 1)]), (1, [uy * (wide // 2) + ux]), (2, [uy * (wide // 2) + ux])):
                for at in places:
                    v = int(coef[c][at][0]) >> 1
                    size, bits = magnitude(v - last[c])
                    symbol(w, DC, size)
                    w.put(bits, size)
                    last[c] = v
    out += [m._sos([1, 2, 3], 0, 0, 0, 1), m.stuffed(np.array(w.bits, np.uint8))]
    for c in range(3):
        for low, top in ((1, 9), (10, 63)):
            out += [m._sos([c + 1], low, top, 0, 2), ac_first(coef[c], low, top, 2)]
        for by in (1, 0):
            out += [m._sos([c + 1], 1, 63, by + 1, by), ac_refine(coef[c], 1, 63, by)]
    bits = []
    for uy in range(high // 2):
        for ux in range(wide // 2):
            bits += [int(coef[0][(2 * uy + dy) * wide + 2 * ux + dx][0]) & 1 for dy in (0, 1) for dx in (0, 1)]
            bits += [int(coef[c][uy * (wide // 2) + ux][0]) & 1 for c in (1, 2)]
    out += [m._sos([1, 2, 3], 0, 0, 1, 0), m.stuffed(np.array(bits, np.uint8)), b"\xff\xd9"]
    return b"".join(out)


def test_any_coefficients():
    """Scans of both kinds of approximation with zero runs, new and corrected coefficients, and chroma at half size."""
    rng = np.random.default_rng(4)
    high, wide = 4, 6
    coef = []
    for n in (high * wide, high * wide // 4, high * wide // 4):
        c = np.where(rng.random((n, 64)) < 0.25, rng.integers(-60, 60, (n, 64)), 0)
        c[:, 0] = rng.integers(-200, 200, n)
        coef.append(c)
    image = m.Decoder(image_of(coef, high, wide))
    for c, want in zip(image.parts, coef, strict=True):
        assert (c.coef == want).all()
    # the transform against its definition, and chroma repeated two by two
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[None, :]
    plain = np.zeros(64)
    plain[m.ZIGZAG] = coef[1][0] * np.arange(1, 65)
    block = basis @ plain.reshape(8, 8) @ basis.T
    assert np.allclose(image.planes()[1][:8, :8], block, atol=1e-2)
    y, cb, cr = image.planes()
    red = y[3, 5] + 128 + 1.402 * cr[1, 2]
    assert image.tensor()[3, 5, 0] == np.clip(np.rint(red), 0, 255)


def test_zigzag():
    assert m.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and m.ZIGZAG[-1] == 63


def test_odd_rows(odd, none):
    out = m.load(m.store(odd)).collect()
    for r in out:
        raw = (r["text"] or "").encode()
        assert r["payload"] == raw + bytes(-len(raw) % 64 if raw else 64) and len(r["tensor"]) == r["height"] * r["width"] * 3
    by = {}
    for r in out:
        by.setdefault(r["text"], set()).add(hashlib.sha256(r["media"]).hexdigest())
    assert all(len(x) == 1 for x in by.values())
    assert m.load(m.store(none)).count() == 0
