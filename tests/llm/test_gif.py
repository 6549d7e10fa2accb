import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from sedimenta.llm import gif as G


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, bytes(range(256)) * 40, os.urandom(70_000), b"the cat " * 9000, bytes(200_000)])
def test_round_trip(data):
    p = G.padded(data)
    assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(data)
    assert G.payload(G.encode_gray(p)) == p


def test_many_rows_make_frames():
    p = bytes(64 * 65535) + b"z" * 128
    m = G.encode_gray(p)
    assert len(G.images(m)[2]) == 2 and G.payload(m) == p


def _plain_lzw(samples, root):
    """A decoder-independent writer: a clear code before each sample, so all codes have root + 1 bits."""
    bits = ""
    for s in samples:
        for c in (1 << root, s):
            bits = format(c, f"0{root + 1}b") + bits
    bits = format((1 << root) + 1, f"0{root + 1}b") + bits
    n = (len(bits) + 7) // 8
    return int(bits, 2).to_bytes(n, "little")


def _file(w, h, palette, frames):
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | 1, 0, 0) + bytes(palette)
    for left, top, fw, fh, samples, delay, disposal, transparent, interlaced in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
        out += struct.pack("<BHHHHB", 0x2C, left, top, fw, fh, 0x40 if interlaced else 0) + b"\x02" + G._blocks(_plain_lzw(samples, 2))
    return out + b"\x3b"


PALETTE = [255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9]


def test_disposal_and_transparency():
    data = _file(2, 2, PALETTE, [(0, 0, 2, 2, [0, 0, 0, 0], 5, 1, None, False), (0, 0, 2, 1, [1, 3], 7, 3, 3, False), (1, 1, 1, 1, [2], 1, 2, None, False), (0, 0, 1, 1, [1], 1, 0, None, False)])
    got = [(s, d, c.copy()) for s, d, c in G.decode(data)]
    assert [(s, d) for s, d, _ in got] == [(0, 50), (50, 70), (120, 10), (130, 10)]
    red, green, blue, clear = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert got[1][2].tolist() == [[green, red], [red, red]]  # the transparent sample shows what lay below
    assert got[2][2].tolist() == [[red, red], [red, blue]]  # restored to what was before
    assert got[3][2].tolist() == [[green, red], [red, clear]]  # cleared to nothing


def test_interlaced():
    rows = [0, 1, 2, 3, 0, 1, 2, 3, 1]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    data = _file(1, 9, PALETTE, [(0, 0, 1, 9, [rows[k] for k in order], 0, 0, None, True)])
    assert G.images(data)[2][0].indices[:, 0].tolist() == rows


def _textbook_decode(data, root):
    """LZW as the format's description has it, a code at a time."""
    bits, at, out = int.from_bytes(data, "little"), 0, []
    clear = 1 << root
    table, width, prev = [], 0, None
    while at + (width or root + 1) <= len(data) * 8:
        if not table:
            table, width, prev = [[i] for i in range(clear)] + [None, None], root + 1, None
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table = []
            width = 0
            continue
        if code == clear + 1:
            break
        entry = table[code] if code < len(table) else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table.append(prev + entry[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out += entry
        prev = entry
    return bytes(out)


def _textbook_encode(samples, root, full="clear", every=None):
    """Greedy LZW; a full table is cleared or kept, and ``every`` so many codes it is cleared early."""
    clear, bits, n, count = 1 << root, 0, 0, 0

    def emit(code, width):
        nonlocal bits, n
        bits |= code << n
        n += width

    def fresh():
        return {(i,): i for i in range(clear)}, clear + 2, root + 1

    emit(clear, root + 1)
    table, free, width = fresh()
    w = ()
    for s in samples:
        if w + (s,) in table:
            w += (s,)
            continue
        emit(table[w], width)
        count += 1
        if free < 4096:
            table[w + (s,)] = free
            if free == 1 << width and width < 12:
                width += 1
            free += 1
        if full == "clear" and free == 4096 or every and count % every == 0:
            emit(clear, width)
            table, free, width = fresh()
        w = (s,)
    emit(table[w], width)
    return bits.to_bytes((n + 7) // 8, "little")


@pytest.mark.parametrize("root, full, every", [(8, "clear", None), (8, "keep", None), (8, "keep", 700), (2, "keep", None), (5, "clear", 31)])
def test_lzw_as_textbook(root, full, every):
    rng = np.random.default_rng(root)
    for samples in (rng.integers(0, 1 << root, 30_000), np.zeros(50_000, int), rng.zipf(1.5, 40_000) % (1 << root)):
        samples = samples.tolist()
        stream = _textbook_encode(samples, root, full, every)
        got = G.lzw_decode(stream, root, len(samples))
        assert got.tolist() == samples
        if full == "clear":
            assert _textbook_decode(stream, root)[: len(samples)] == bytes(samples)  # the last byte may hold one more code


def test_encoder_with_textbook_decoder():
    for data in (b"abracadabra" * 500, os.urandom(20_000), bytes(30_000)):
        assert _textbook_decode(G.lzw_encode(data), 8) == data


def test_feature_of_composed_frames():
    data = _file(2, 2, PALETTE, [(0, 0, 2, 2, [0, 0, 0, 0], 5, 1, None, False), (0, 0, 2, 1, [1, 3], 7, 3, 3, False), (1, 1, 1, 1, [2], 1, 2, None, False), (0, 0, 1, 1, [1], 1, 0, None, False)])
    shown, red, green, blue = 4 + 4 + 4 + 3, 4 + 3 + 3 + 2, 0 + 1 + 0 + 1, 0 + 0 + 1 + 0  # in the fourth frame one pixel is clear
    want = [[shown - n, *[0] * 14, n] for n in (red, green, blue)]
    assert G.feature(data) == "2x2:4:140ms:" + ";".join(",".join(map(str, x)) for x in want)
    p = G.padded(bytes(range(256)))
    assert G.feature(G.encode_gray(p)) == "64x4:1:100ms:" + ";".join([",".join(["16"] * 16)] * 3)


def test_files_without_images_and_huge_canvases(spark):
    bare = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0) + b"\x3b"
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, 1, 1, 0) + b"\x02" + G._blocks(_plain_lzw([0], 2)) + b"\x3b"
    wide = huge.replace(struct.pack("<BHHHHB", 0x2C, 0, 0, 1, 1, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, 65535, 65535, 0))
    rows = spark.createDataFrame([(1, bytearray(bare)), (2, bytearray(huge)), (3, bytearray(wide))], "id long, content binary")
    assert {r.id: r.error for r in G.frames(rows).collect()} == {1: "no image", 2: "too large", 3: "too large"}


def test_frames_table(spark):
    good = _file(2, 1, PALETTE, [(0, 0, 2, 1, [0, 2], 5, 0, None, False)])
    rows = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk")), (4, bytearray(good[:-8]))], "id long, content binary")
    got = {r.id: r for r in G.frames(rows).collect()}
    assert got[1].red[15] == 1 and got[1].blue[15] == 1 and got[1].shown == 2 and got[1].delay_ms == 50 and got[1].error is None
    assert got[2].error and got[3].error and got[4].error and got[2].red is None
    assert G.frames(rows.limit(0)).collect() == []


def test_texts(docs):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "héllo"), (1, "héllo"), (None, "y" * 100_000)]
    got = G.read_back(G.stored(docs(rows, "media feature"))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t or "").encode() for i, t in rows if i == r.doc_id)
        p = G.padded(text)
        m = G.encode_gray(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    assert len({r.feature for r in got if r.doc_id in (1, 4)}) == 1 and all(r.feature == G.feature(G.encode_gray(G.padded(next((t or "").encode() for i, t in rows if i == r.doc_id)))) for r in got)
    assert G.read_back(G.stored(docs([]))).collect() == []


def test_histogram():
    canvas = np.zeros((1, 2, 4), np.uint8)
    canvas[0, 0] = (255, 16, 0, 255)
    assert G.histogram(canvas)[0][15] == 1 and G.histogram(canvas)[1][1] == 1 and sum(G.histogram(canvas)[2]) == 1
