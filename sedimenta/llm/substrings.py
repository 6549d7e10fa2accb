"""Substring dedup with a hash-compared suffix sort.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere is removed, exactly:

1. Anchors. Each 200-byte string has an anchor, its leftmost 64-byte gram of least hash, so equal strings have equal
   anchors at equal places. About one byte in 60 begins an anchor; an anchor's context is the text covered by the
   strings it stands for. One row an anchor is written: gram hash, 128-bit cryptographic digest of the context (which
   stands for its bytes), place.
2. Per gram, partial aggregates count rows and contexts. A gram seen once is settled: nothing it stands for repeats. A
   gram with one context seen twice or more is settled too: all of it repeats. Copies by the thousand end here.
3. Grams in several contexts are left: the edges of shared passages. One row for each distinct context fetches its
   bytes, and the strings of a gram's contexts are suffix-sorted: prefix polynomial hashes and binary search give the
   common extension of two suffixes, which decides each comparison of a mergesort that runs in numpy over many grams
   at once; neighbours that agree for 200 bytes are verified byte by byte. A gram with over ``BLOCK`` contexts is split
   for this: its strings go to tasks by their hash, those whose hash is alone are dropped before, and the rest are
   sorted and verified in the same way, however many there are.
4. The removed runs of each document are joined to its text, which is cut and hashed.

Joins on grams have one row a gram on one side, so that AQE splits a gram which a third of all rows share. Texts are
compressed before they are shuffled.

Defined results: a null or empty text has no bytes and keeps none; texts under 200 bytes lose nothing; rows repeated
whole (id and text) lose all strings of 200 bytes; null ids are an id like any other; no rows give no rows. Further
columns don't matter.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import U64, batched, buffers, documents, packed, powers, prefix_hash, slices, span_hash, text_or_empty, unpacked, written

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1
#: Contexts of one gram that are sorted in one task.
BLOCK = 2000
#: Strings that are sorted at once.
_AT_ONCE = 200_000


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, hash, place, lo, hi) of each anchor: it stands for the strings that start at lo..hi, places in the buffer."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH or not (np.diff(off) >= LENGTH).any():
        return none, none.astype(U64), none, none, none
    at = np.arange(n - GRAM + 1)
    g = span_hash(prefix_hash(data), at, at + GRAM)
    last = n - LENGTH + 1
    # least hash of SPAN consecutive grams, by doubling
    m, w = g, 1
    while w * 2 <= SPAN:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    m = np.minimum(m[: len(m) - (SPAN - w)], m[SPAN - w :]) if SPAN > w else m
    valid = np.zeros(last + 1, np.int8)
    some = np.flatnonzero(np.diff(off) >= LENGTH)
    valid[off[some]] += 1
    np.subtract.at(valid, np.minimum(off[some + 1] - LENGTH + 1, last), 1)
    s = np.flatnonzero(np.cumsum(valid[:last]))
    # a string's anchor is its leftmost least gram; it changes where that gram leaves or a lesser one enters
    ends = g[s] == m[s]
    ends[:-1] |= (m[s[1:]] < m[s[:-1]]) | (s[1:] != s[:-1] + 1)
    # strings of neighbouring texts may adjoin
    heads = np.searchsorted(s, off[some])
    ends[heads[heads > 0] - 1] = True
    ends[-1] = True
    e = np.flatnonzero(ends)
    b = np.r_[0, e[:-1] + 1]
    lo, hi = s[b], s[e]
    place = np.empty(len(lo), np.int64)
    for k in range(0, len(lo), 1 << 14):
        part = lo[k : k + (1 << 14)]
        place[k : k + (1 << 14)] = part + np.argmin(g[part[:, None] + np.arange(SPAN)], axis=1)
    row = np.searchsorted(off, lo, "right") - 1
    return row, g[place], place, lo, hi


# --- suffix sort --------------------------------------------------------------------------------------------------


class Extensions:
    """Common extensions of suffixes of a buffer, by prefix hashes and binary search."""

    def __init__(self, data: np.ndarray, limit: int = LENGTH):
        self.data = np.concatenate([data, np.zeros(limit + 1, np.uint8)])
        self.limit, self.size = limit, len(data)
        self.hash = prefix_hash(self.data)
        self.power = powers(len(self.hash))[0]

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        h, p = self.hash, self.power
        return (h[i + n] - h[i]) * p[j] == (h[j + n] - h[j]) * p[i]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many of the first ``limit`` bytes of the suffixes agree."""
        lo = np.zeros(len(i), np.int64)
        hi = np.full(len(i), self.limit, np.int64)
        whole = self.same(i, j, hi)
        lo[whole] = self.limit
        act = np.flatnonzero(~whole)
        hi[act] -= 1
        while len(act):
            mid = (lo[act] + hi[act] + 1) >> 1
            eq = self.same(i[act], j[act], mid)
            lo[act[eq]] = mid[eq]
            hi[act[~eq]] = mid[~eq] - 1
            act = act[lo[act] < hi[act]]
        return lo

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at i is before, like or after that at j."""
        n = self.common(i, j)
        a, b = self.data[i + n].astype(np.int64), self.data[j + n].astype(np.int64)
        return np.where(n >= self.limit, 0, np.sign(a - b))


def suffix_sort(ext: Extensions, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """An order of ``starts`` (groups adjacent) that sorts the suffixes within each group: bottom-up mergesort, all runs at once."""
    n = len(starts)
    order = np.arange(n)
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, n])
    base, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    local = np.arange(n) - base
    w = 1
    longest = int(sizes.max(initial=0))
    while w < longest:
        act = np.flatnonzero(size > w)  # smaller groups are sorted
        run = local[act] // w
        other = np.minimum((run ^ 1) * w, size[act])
        b = base[act] + other
        e = base[act] + np.minimum(other + w, size[act])
        right = (run & 1).astype(bool)
        lo, hi = b.copy(), e.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            c = ext.compare(starts[order[mid]], starts[order[act[open_]]])
            below = (c < 0) | (right[open_] & (c == 0))
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        to = base[act] + (run >> 1) * 2 * w + local[act] % w + (lo - b)
        merged = order.copy()
        merged[to] = order[act]
        order = merged
        w *= 2
    return order


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Which of the strings of ``limit`` bytes at ``starts`` have an equal within their group (groups adjacent)."""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    ext = Extensions(data, limit)
    order = suffix_sort(ext, starts, group)
    a, b = order[:-1], order[1:]
    k = np.flatnonzero((group[a] == group[b]) & ext.same(starts[a], starts[b], np.full(len(a), limit)))
    step = 1 << 14
    for at in range(0, len(k), step):  # verified, so that no collision of hashes removes anything
        i, j = a[k[at : at + step]], b[k[at : at + step]]
        true = (ext.data[starts[i][:, None] + np.arange(limit)] == ext.data[starts[j][:, None] + np.arange(limit)]).all(axis=1)
        out[i[true]] = True
        out[j[true]] = True
    return out


# --- on Spark -------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, text): equal ids with equal texts are alike in all that follows."""
    return batched(docs).select(F.col(key).cast("string").alias("id"), text_or_empty(text).alias("text")).select("id", F.xxhash64("text").alias("th"), "text")


def _digest(context: bytes, place: int) -> bytes:
    """The digest that stands for a context, its anchor at ``place``."""
    return hashlib.blake2b(context, digest_size=16, salt=place.to_bytes(2, "little")).digest()


def _anchor_rows(batches):
    names = ["id", "th", "gram", "c1", "c2", "lo", "strings", "place"]
    for b in slices(batches):
        data, off = buffers(b.column(2))
        row, h, place, lo, hi = anchors(data, off)
        raw = memoryview(data.tobytes())
        ctx = b"".join(_digest(raw[s:e], p) for s, e, p in zip(lo.tolist(), (hi + LENGTH).tolist(), (place - lo).tolist()))
        ctx = np.frombuffer(ctx, np.int64).reshape(-1, 2)
        at = pa.array(row)
        cols = [b.column(0).take(at), b.column(1).take(at), pa.array(h.view(np.int64)), pa.array(ctx[:, 0]), pa.array(ctx[:, 1])]
        cols += [pa.array((lo - off[row]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int16)), pa.array((place - lo).astype(np.int16))]
        yield pa.RecordBatch.from_arrays(cols, names=names)


_KEY = ["gram", "c1", "c2"]
_CONTEXT = "gram long, c1 long, c2 long, copies long, place int, strings int, bytes binary"


def _context_rows(batches):
    """The bytes of the contexts that rows (packed text, list of contexts) name."""
    for b in slices(batches, "packed"):
        rows = []
        for raw, contexts in zip(unpacked(b.column(0)), b.column(1).to_pylist()):
            rows += [(c["gram"], c["c1"], c["c2"], c["copies"], c["place"], c["strings"], raw[c["lo"] : c["lo"] + c["strings"] - 1 + LENGTH]) for c in contexts]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _CONTEXT.split(", ")])


_RESULT = "gram long, c1 long, c2 long, first int, last int"


def _found(keys: list, again: np.ndarray, ctx: np.ndarray, nth: np.ndarray):
    """Runs of strings that repeat: ``keys`` of contexts, of each string its context and its number in that."""
    edge = np.flatnonzero(again)
    new = np.r_[True, (np.diff(edge) > 1) | (ctx[edge[1:]] != ctx[edge[:-1]])] if len(edge) else np.zeros(0, bool)
    a, b = edge[new], edge[np.r_[new[1:], True]] if len(edge) else edge
    cols = np.array(keys, np.int64).reshape(-1, 3)[ctx[a]]
    return pa.RecordBatch.from_arrays([*(pa.array(cols[:, k]) for k in range(3)), pa.array(nth[a].astype(np.int32)), pa.array(nth[b].astype(np.int32))], names=[x.split()[0] for x in _RESULT.split(", ")])


def _sorted_rows(batches):
    """Rows of contexts sorted by gram to the ranges of their strings that repeat; a gram may span batches."""
    held, weight = [], 0

    def emit(rows):
        gram = np.array([r[0] for r in rows], np.int64)
        place, strings = np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
        data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        size = np.array([len(r[6]) for r in rows], np.int64)
        at = np.cumsum(size) - size
        ctx = np.repeat(np.arange(len(rows)), strings)
        nth = np.arange(len(ctx)) - np.repeat(np.cumsum(strings) - strings, strings)
        # equal strings have the anchor at equal places, so only these are compared
        _, g = np.unique(gram, return_inverse=True)
        group = g[ctx] * 1024 + (place[ctx] - nth + 512)
        order = np.argsort(group, kind="stable")
        again = np.zeros(len(ctx), bool)
        again[order] = repeated(data, (at[ctx] + nth)[order], group[order])
        again |= np.array([r[3] > 1 for r in rows])[ctx]
        return _found([r[:3] for r in rows], again, ctx, nth)

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in range(7))):
            if weight >= _AT_ONCE and held and held[-1][0] != row[0]:
                yield emit(held)
                held, weight = [], 0
            held.append(row)
            weight += row[5]
    if held:
        yield emit(held)


_STRING = "gram long, c1 long, c2 long, k int, at int, string long"


def _string_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63)


def _string_rows(batches):
    """The strings of contexts, by hash, without their bytes."""
    for b in slices(batches, "bytes"):
        rows = []
        for gram, c1, c2, _, place, strings, raw in zip(*(b.column(c).to_pylist() for c in range(7))):
            rows += [(gram, c1, c2, k, place - k, _string_hash(raw[k : k + LENGTH])) for k in range(strings)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _STRING.split(", ")])


_BYTES = "gram long, c1 long, c2 long, k int, at int, string long, bytes binary"


def _string_bytes(batches):
    """The bytes of the strings ``ks`` of contexts."""
    for b in slices(batches, "bytes"):
        rows = []
        for gram, c1, c2, place, raw, ks in zip(*(b.column(c).to_pylist() for c in range(6))):
            for k in ks:
                one = raw[k : k + LENGTH]
                rows.append((gram, c1, c2, k, place - k, _string_hash(one), one))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _BYTES.split(", ")])


def _sorted_strings(batches):
    """Rows of strings sorted by (gram, at, bytes) to those that repeat. Equal ones are neighbours, so only two are held of each."""
    held, last, run = [], None, 0

    def emit(rows):
        data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        _, group = np.unique(np.array([(r[0], r[4]) for r in rows], np.int64), axis=0, return_inverse=True)
        again = repeated(data, LENGTH * np.arange(len(rows)), group.ravel())
        return _found([r[:3] for r in rows], again, np.arange(len(rows)), np.array([r[3] for r in rows]))

    more = []  # strings that equal two held ones, verified by the comparison of their bytes
    for b in slices(batches, "bytes"):
        for row in zip(*(b.column(c).to_pylist() for c in range(7))):
            same = last is not None and (row[0], row[4], row[6]) == (last[0], last[4], last[6])
            run = run + 1 if same else 1
            last = row
            if run > 2:
                more.append(row)
                if len(more) >= 10_000:
                    yield _found([r[:3] for r in more], np.ones(len(more), bool), np.arange(len(more)), np.array([r[3] for r in more]))
                    more = []
                continue
            if not same and len(held) * LENGTH >= _AT_ONCE * 10:
                yield emit(held)
                held = []
            held.append(row)
    if held:
        yield emit(held)
    if more:
        yield _found([r[:3] for r in more], np.ones(len(more), bool), np.arange(len(more)), np.array([r[3] for r in more]))


def _of_many(found: DataFrame) -> DataFrame:
    """The ranges of strings that repeat, for contexts of grams that have too many of them for one task."""
    strings = written(found.mapInArrow(_string_rows, _STRING), "strings")
    twice = strings.groupBy("gram", "at", "string").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # at most SPAN strings a context
    ks = strings.join(twice, ["gram", "at", "string"]).groupBy(*_KEY).agg(F.collect_list("k").alias("ks"))
    rows = found.join(ks, _KEY).select(*_KEY, "place", "bytes", "ks").mapInArrow(_string_bytes, _BYTES)
    again = rows.repartition("gram", "at", "string").sortWithinPartitions("gram", "at", "bytes").mapInArrow(_sorted_strings, _RESULT)
    copies = found.filter("copies > 1").select(*_KEY, F.lit(0).alias("first"), (F.col("strings") - 1).alias("last"))
    return again.unionAll(copies)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id string, th, spans array<struct<s int, e int>>): the byte ranges of each text that repeat; they may overlap."""
    keyed = _keyed(docs, key, text)
    rows = written(keyed.mapInArrow(_anchor_rows, "id string, th long, gram long, c1 long, c2 long, lo int, strings short, place short"), "anchors")
    differ = reduce(lambda a, b: a | b, [F.min(c) < F.max(c) for c in ("c1", "c2")])
    grams = rows.groupBy("gram").agg(F.count("*").alias("n"), differ.alias("mixed")).filter("n > 1")
    seen = written(rows.join(grams, "gram").drop("n"), "anchors-repeated")
    spans = [seen.filter("not mixed").select("id", "th", F.col("lo").alias("s"), (F.col("lo") + F.col("strings") - 1 + LENGTH).alias("e"))]
    mixed = seen.filter("mixed")
    contexts = written(mixed.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "lo", "strings", "place")).alias("w")).select(*_KEY, "copies", "w.*"), "contexts")
    wanted = contexts.groupBy("id", "th").agg(F.collect_list(F.struct(*_KEY, "copies", "lo", "strings", "place")).alias("contexts"))
    texts = keyed.select("id", "th", packed("text").alias("packed"))
    # one of several equal rows is enough
    found = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["th"] == wanted["th"])).select("packed", "contexts").mapInArrow(_context_rows, _CONTEXT)
    found = written(found.dropDuplicates(_KEY), "context-bytes")
    many = written(contexts.groupBy("gram").count().filter(F.col("count") > block).select("gram"), "grams-of-many")
    hot = not many.isEmpty()
    few = found.join(many, "gram", "left_anti") if hot else found
    result = few.repartition("gram").sortWithinPartitions("gram", "c1", "c2").mapInArrow(_sorted_rows, _RESULT)
    if hot:
        result = result.unionAll(_of_many(found.join(many, "gram", "left_semi")))
    result = written(result, "contexts-repeated")
    spans.append(mixed.join(result, _KEY).select("id", "th", (F.col("lo") + F.col("first")).alias("s"), (F.col("lo") + F.col("last") + LENGTH).alias("e")))
    # a set: rows repeated whole have the same spans
    return reduce(DataFrame.unionAll, spans).groupBy("id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(spans: list, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of the spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary, kept_sha256)."""

    def cut(batches):
        for b in slices(batches, "packed"):
            rows = []
            for raw, spans in zip(unpacked(b.column(1)), b.column(2).to_pylist()):
                runs = merged([(x["s"], x["e"]) for x in spans or ()], len(raw))
                edges = [0, *[p for r in runs for p in r], len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2]))
                rows.append((len(raw), len(raw) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=[key, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    spans = repeats(docs, key, text, block)
    texts = _keyed(docs, key, text).select("id", "th", packed("text").alias("packed"))
    joined = texts.join(spans, texts["id"].eqNullSafe(spans["id"]) & (texts["th"] == spans["th"]), "left")
    return joined.select(texts["id"].cast(kind).alias(key), "packed", "spans").mapInArrow(cut, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
