"""Media columns: GIF.

``decode`` reads a GIF file: LZW code streams, global and local palettes, interlacing, transparency and the disposal of
frames, giving timed frames composed on the canvas. ``frames`` makes one row a frame of a table of files, with colour
histograms as columns. ``encode_gray`` stores bytes losslessly as the 8-bit samples of a greyscale GIF, in frames of 64
columns; ``stored`` makes a table of such files, and ``read_back`` reads payload and composed frames from their bytes.

Decoding is numpy throughout: code widths follow from the position after the last clear code, so runs of codes are
unpacked at once; a code's string is a copy of earlier output, so lengths and bytes are found by pointer jumping.
Encoding has one Python loop, the dictionary itself.

Defined results: a null or empty text is a payload of 64 zero bytes; a text of any length is stored whole, one frame
for each 65,535 rows; a null or damaged file, one without an image, and one whose images or canvas have more than
``max_pixels`` pixels (a documented bound, as a small file can declare 65,535 x 65,535) gives one row with ``error`` set
and null columns; equal inputs give equal files. Repeated rows and further columns don't matter; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import batched, documents, slices, text_or_empty, written

WIDTH = 64
MAX_ROWS = 65535
BINS = 16
#: Pixels of an image or canvas beyond which a file is refused.
MAX_PIXELS = 1 << 26
_MAX_CODES = 1 << 12


# --- LZW ----------------------------------------------------------------------------------------------------------


def _codes(data: bytes) -> list[int]:
    """The codes of 8-bit samples, with clear (256) and end (257) codes."""
    out = [256]
    emit = out.append
    table: dict[int, int] = {}
    get = table.get
    free = 258
    samples = iter(data)
    last = next(samples)
    for c in samples:
        key = last << 8 | c
        known = get(key)
        if known is None:
            emit(last)
            table[key] = free
            free += 1
            if free == _MAX_CODES:
                emit(256)
                table.clear()
                free = 258
            last = c
        else:
            last = known
    emit(last)
    emit(257)
    return out


def _widths(n: int, root: int) -> np.ndarray:
    """Width of the 1st, 2nd, ... code after a clear code, where samples have ``root`` bits."""
    j = np.arange(1, n + 1) + (1 << root)
    return np.clip(np.floor(np.log2(j)).astype(np.int64) + 1, root + 1, 12)


_WIDTH_8 = _widths(_MAX_CODES + 64, 8)
_OFFSET_8 = np.concatenate([[0], np.cumsum(_WIDTH_8)])


def lzw_encode(data: bytes) -> bytes:
    codes = np.array(_codes(data), np.int64)
    clear = np.flatnonzero(codes == 256)
    since = np.arange(len(codes)) - np.repeat(clear, np.diff(np.r_[clear, len(codes)]))
    since[clear[1:]] = np.diff(clear)  # a clear code has the width of the run that it ends
    width = _WIDTH_8[np.maximum(since, 1) - 1]
    ends = np.cumsum(width)
    at = ends - width
    value = codes << (at & 7)  # 19 bits at most, none shared
    n, byte = int(ends[-1] + 7) >> 3, at >> 3
    out = np.bincount(byte, value & 0xFF, n + 2) + np.bincount(byte + 1, value >> 8 & 0xFF, n + 2) + np.bincount(byte + 2, value >> 16, n + 2)
    return out[:n].astype(np.uint8).tobytes()


def _strings(codes: np.ndarray, clear: int, most: int) -> np.ndarray:
    """The samples of a run of codes between clear codes, at least ``most`` if there are so many."""
    n, room = len(codes), _MAX_CODES - clear - 2
    k = np.arange(n)
    plain = codes < clear
    entry = codes - (clear + 2)  # entry e is the string of code e and the first sample of code e + 1
    if not (plain | ((entry >= 0) & (entry < np.minimum(k, room)))).all():
        raise ValueError("bad code")
    entry = np.where(plain, k, entry)
    up, depth = entry, np.where(plain, 0, 1)
    while True:
        more = depth[up]
        if not more.any():
            break
        depth, up = depth + more, up[up]
    ends = np.cumsum(depth + 1)
    if ends[-1] > most:
        n = int(np.searchsorted(ends, most)) + 1
        plain, entry, depth, ends, codes = plain[:n], entry[:n], depth[:n], ends[:n], codes[:n]
    begin = ends - depth - 1
    source = (np.arange(int(ends[-1])) - np.repeat(begin - begin[entry], depth + 1)).astype(np.int32)
    for _ in range(int(2 * depth.max() + 1).bit_length()):
        source = source[source]
    out = np.zeros(len(source), np.uint8)
    out[begin[plain]] = codes[plain]
    return out[source]


def lzw_decode(data: bytes, root: int, most: int) -> np.ndarray:
    """The first ``most`` samples of any GIF code stream, with early, late or missing clear codes and a missing end code."""
    if not 1 <= root <= 8:
        raise ValueError("bad code size")
    clear, end = 1 << root, (1 << root) + 1
    raw = np.zeros(len(data) + 4, np.int32)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    total = len(data) * 8
    widths = _WIDTH_8 if root == 8 else _widths(_MAX_CODES + 64, root)
    offset = _OFFSET_8 if root == 8 else np.concatenate([[0], np.cumsum(widths)])
    out: list[np.ndarray] = []
    at, have, ended = 0, 0, False
    while at < total and have < most and not ended:
        run, size = [], len(widths)
        place, width = at + offset[:-1], widths
        while True:  # codes up to the next clear code; those beyond a full table have 12 bits
            fits = int(np.searchsorted(place + width, total, "right"))
            place, width = place[:fits], width[:fits]
            byte = place >> 3
            codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7)) & ((1 << width) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop):
                n = int(stop[0])
                run.append(codes[:n])
                at, ended = int(place[n] + width[n]), codes[n] == end
                break
            run.append(codes)
            if fits < size:
                at = total
                break
            at = int(place[-1] + width[-1])
            size *= 2
            place, width = at + 12 * np.arange(size), np.full(size, 12)
        codes = np.concatenate(run)
        if len(codes):
            out.append(_strings(codes, clear, most - have))
            have += len(out[-1])
    return np.concatenate(out)[:most] if out else np.zeros(0, np.uint8)


# --- files --------------------------------------------------------------------------------------------------------

_GRAY = bytes(v for i in range(256) for v in (i, i, i))


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gray(data: bytes, delay: int = 10) -> bytes:
    """Bytes, a positive multiple of 64, as a GIF of 64 columns."""
    if not data or len(data) % WIDTH:
        raise ValueError("not a positive multiple of 64 bytes")
    step = WIDTH * MAX_ROWS
    parts = [data[i : i + step] for i in range(0, len(data), step)]
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(parts[0]) // WIDTH, 0xF7, 0, 0), _GRAY]
    for p in parts:
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(p) // WIDTH, 0), b"\x08", _blocks(lzw_encode(p))]
    return b"".join(out) + b"\x3b"


@dataclass
class Image:
    """A stored image, before it is composed."""

    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    indices: np.ndarray  # (height, width)
    delay_ms: int
    disposal: int
    transparent: int | None


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while data[at]:
        n = data[at]
        out.append(data[at + 1 : at + 1 + n])
        if len(out[-1]) < n:
            raise ValueError("cut off")
        at += n + 1
    return b"".join(out), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << ((flags & 7) + 1)
    return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n


def images(data: bytes, max_pixels: int = MAX_PIXELS) -> tuple[int, int, list[Image]]:
    """Canvas width and height, and the stored images in order."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared, found = 13, np.zeros((0, 3), np.uint8), []
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                f, t, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = t * 10, f >> 2 & 7, index if f & 1 else None
        elif kind == 0x2C:
            left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if f & 0x80:
                palette, at = _palette(data, at, f)
            root = data[at]
            body, at = _sub_blocks(data, at + 1)
            if w * h > max_pixels:
                raise ValueError("too large")
            samples = lzw_decode(body, root, w * h)
            if len(samples) < w * h:
                raise ValueError("too few samples")
            grid = samples.reshape(h, w)
            if f & 0x40:
                rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(grid)
                plain[rows] = grid
                grid = plain
            found.append(Image(left, top, w, h, palette, grid, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown block")
    return width, height, found


def compose(width: int, height: int, found: list[Image], max_pixels: int = MAX_PIXELS):
    """Yield (start_ms, delay_ms, canvas (height, width, 4) uint8) for each frame as it is shown; a canvas holds until the next."""
    if width * height > max_pixels:
        raise ValueError("too large")
    if not found:
        raise ValueError("no image")
    canvas = np.zeros((height, width), np.uint32)  # red, green, blue and alpha in a number
    clock = 0
    for m in found:
        kept = canvas.copy() if m.disposal == 3 else None
        b, r = min(m.top + m.height, height), min(m.left + m.width, width)
        index = m.indices[: max(0, b - m.top), : max(0, r - m.left)]
        palette = np.zeros((256, 4), np.uint8)
        palette[: len(m.palette), :3] = m.palette
        palette[:, 3] = 255
        colours = palette.view(np.uint32).ravel()[index]
        area = canvas[m.top : b, m.left : r]
        if m.transparent is None:
            area[...] = colours
        else:
            np.copyto(area, colours, where=index != m.transparent)
        yield clock, m.delay_ms, canvas.view(np.uint8).reshape(height, width, 4)
        clock += m.delay_ms
        if m.disposal == 2:
            canvas[m.top : b, m.left : r] = 0
        elif m.disposal == 3:
            canvas = kept


def decode(data: bytes, max_pixels: int = MAX_PIXELS):
    """The frames of a file, as ``compose`` gives them."""
    return compose(*images(data, max_pixels), max_pixels)


def histogram(canvas: np.ndarray, bins: int = BINS) -> tuple[list[int], list[int], list[int]]:
    """Pixels by red, green and blue level; transparent ones count nowhere."""
    seen = canvas.reshape(-1, 4)
    if not seen[:, 3].all():
        seen = seen[seen[:, 3] > 0]
    each = (np.bincount(seen[:, c], minlength=256) for c in range(3))
    return tuple(np.add.reduceat(n, -(-np.arange(bins) * 256 // bins)).tolist() for n in each)


FRAME_SCHEMA = "frame int, start_ms long, delay_ms int, width int, height int, red array<long>, green array<long>, blue array<long>, shown long, error string"


def frames(files: DataFrame, key: str = "id", content: str = "content", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row for each frame of each GIF in the binary column ``content``."""

    def run(batches):
        for b in slices(batches, "content"):
            keys, rows = [], []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    if data is None:
                        raise ValueError("no file")
                    shown = [(n, s, d, c.shape[1], c.shape[0], *histogram(c), int((c[..., 3] > 0).sum()), None) for n, (s, d, c) in enumerate(decode(data, max_pixels))]
                except (ValueError, IndexError, struct.error, MemoryError) as e:
                    shown = [(None, None, None, None, None, None, None, None, None, str(e) or type(e).__name__)]
                keys += [k] * len(shown)
                rows += shown
            cols = list(zip(*rows)) if rows else [[]] * 10
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.string()]
            names = [x.split()[0] for x in FRAME_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[key, *names])

    return batched(files).select(key, F.col(content).cast("binary").alias("content")).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, {FRAME_SCHEMA}")


# --- texts as samples -----------------------------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def payload(media: bytes) -> bytes:
    """The samples of all stored images, in order."""
    return b"".join(m.indices.tobytes() for m in images(media)[2])


def feature(media: bytes) -> str:
    """Canvas, frames and duration, and the pixels of all frames, as composed and timed, by red, green and blue level."""
    return _feature(*images(media))


def _feature(width: int, height: int, found: list[Image]) -> str:
    total, end, n = np.zeros((3, BINS), np.int64), 0, 0
    for start, delay, canvas in compose(width, height, found):
        total += np.array(histogram(canvas))
        end, n = start + delay, n + 1
    return f"{width}x{height}:{n}:{end}ms:" + ";".join(",".join(map(str, c)) for c in total.tolist())


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media binary): each text as a GIF."""

    def run(batches):
        for b in slices(batches):
            raw = [t.encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode_gray(padded(r)) for r in raw], pa.binary())], names=[key, "n_bytes", "media"])

    return batched(docs).select(key, text_or_empty(text).alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored files hold, read from their bytes alone."""

    def run(batches):
        for b in slices(batches, "media"):
            rows = []
            for m in b.column(2).to_pylist():
                width, height, found = images(m)
                p = b"".join(x.indices.tobytes() for x in found)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), _feature(width, height, found)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=[key, "n_bytes", *[x.split()[0] for x in _DIGEST.split(", ")]])

    return batched(media).select(key, "n_bytes", "media").mapInArrow(run, f"{key} {media.schema[key].dataType.simpleString()}, n_bytes long, {_DIGEST}")


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(written(stored(documents(spark, sf_dir)), "gif"))


QUERIES = {"op9_gif": op9_gif}
ORACLES: dict[str, str] = {}
