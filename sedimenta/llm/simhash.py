"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: XXH64 of each 3-word shingle; a bit is set if over half of a text's shingle hashes have it.

Links (``radius`` 2): equal fingerprints are first folded to one row with a count, so thousands of copies are one
candidate. Two fingerprints that differ in at most 2 bits agree in at least two of four 16-bit blocks, hence in one of
six 32-bit keys. A bucket of at most ``BLOCK`` fingerprints is compared at once; a larger one is split, exactly, by
thirds of its free bits (at least one third agrees) and again by thirds of those, after which at most 2^15 distinct
fingerprints are left. No bucket is capped and no pair is formed within a group but those found to be near. A pair
that shares several keys is reported under the first alone.

Comparison: the bit planes of a run of fingerprints are stored vertically (a machine word holds one bit of 64
fingerprints). Sliding the planes by d lanes compares each fingerprint with its d-th follower; saturating carry-save
counters add the planes up, and words in which every lane has passed the radius are abandoned after each few planes.

Components: local union-find on each partition's links, then large-star and small-star rounds until nothing changes.

Defined results: a null or blank text has fingerprint 0 and is linked like any other; rows with a null id are linked
and counted but never name a component (null if no member has an id); repeated rows count as further copies; no rows
give no rows. Further columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import U64, batched, buffers, documents, free, lowered, slices, text_or_empty, words_of, written

SEED = 42
SHINGLE = 3
RADIUS = 2
#: A bucket of more fingerprints is split before it is compared.
BLOCK = 2048


def fingerprints_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint for each text of the buffer."""
    data = lowered(data)
    starts, ends, first = words_of(data, off)
    rows = len(off) - 1
    out = np.zeros(rows, U64)
    if not len(starts):
        return out
    length = ends - starts
    # words joined by one blank each: where word i lies then
    at = np.zeros(len(starts), np.int64)
    np.cumsum(length[:-1] + 1, out=at[1:])
    joined = np.full(int(at[-1] + length[-1]), 0x20, np.uint8)
    runs = np.repeat(starts - at, length) + _ramp(at, length)
    joined[_ramp(at, length)] = data[runs]
    n = np.diff(first)
    k = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    row = np.repeat(np.arange(rows), k)
    begin = np.zeros(rows + 1, np.int64)
    np.cumsum(k, out=begin[1:])
    i = first[:-1][row] + np.arange(len(row)) - begin[:-1][row]
    j = i + np.minimum(n[row], SHINGLE) - 1
    b, xx = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter([xx(b[s:e], SEED) for s, e in zip(at[i].tolist(), (at[j] + length[j]).tolist())], U64, len(i))
    some = np.flatnonzero(k)
    step = 1 << 17
    count = np.zeros((rows, 64), np.int64)
    for lo in range(0, len(h), step):
        part = h[lo : lo + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r = row[lo : lo + step]
        heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        count[r[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    on = (count * 2 > k[:, None]).astype(np.uint8)
    out[:] = np.packbits(on, axis=1, bitorder="little").view(U64).ravel()
    out[np.setdiff1d(np.arange(rows), some)] = 0
    return out


def _ramp(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """at[0], at[0]+1, ... for each run."""
    total = int(length.sum())
    heads = np.cumsum(length) - length
    return np.arange(total) - np.repeat(heads - at, length)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long)"""

    def run(batches):
        for b in slices(batches):
            fp = fingerprints_of(*buffers(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return batched(docs).select(key, text_or_empty(text).alias("text")).mapInArrow(run, f"{key} {kind}, fp long")


# --- keys ---------------------------------------------------------------------------------------------------------

_BLOCKS = [list(range(b, b + 16)) for b in (0, 16, 32, 48)]
_TABLES = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def _thirds(bits: list[int]) -> list[list[int]]:
    n = len(bits)
    cut = [0, (n + 2) // 3, (n + 2) // 3 + (n + 1) // 3, n]
    return [bits[cut[k] : cut[k + 1]] for k in range(3)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


class _Key:
    """A set of bits that must agree; ``earlier``: if all bits of one of these agree, the pair belongs to that key."""

    def __init__(self, path: int, bits: list[int], earlier: list[int]):
        self.path, self.bits, self.earlier, self.free = path, bits, earlier, [b for b in range(64) if b not in bits]

    def split(self) -> list[_Key]:
        parts = _thirds(self.free)
        return [_Key(self.path * 3 + k + 6, sorted(self.bits + parts[k]), self.earlier + [_mask(p) for p in parts[:k]]) for k in range(3)]

    def value(self, fp="fp"):
        return F.xxhash64(F.col(fp).bitwiseAND(F.lit(_signed(_mask(self.bits)))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _levels() -> list[list[_Key]]:
    top = [_Key(t, sorted(_BLOCKS[i] + _BLOCKS[j]), [_mask(_BLOCKS[a] + _BLOCKS[b]) for a, b in _TABLES[:t]]) for t, (i, j) in enumerate(_TABLES)]
    mid = [c for k in top for c in k.split()]
    return [top, mid, [c for k in mid for c in k.split()]]


LEVELS = _levels()
KEYS = {k.path: k for level in LEVELS for k in level}


# --- comparison ---------------------------------------------------------------------------------------------------


def _planes(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """(len(order), words): bit ``order[p]`` of 64 fingerprints to a word, padded with two words of nothing."""
    n = len(fps)
    words = (n + 63) // 64 + 2
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T[order]), axis=1, bitorder="little").view(U64)


def near_lanes(fps: np.ndarray, group: np.ndarray, order: list[int], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of one group (equal, adjacent values of ``group``) whose fingerprints differ in at most ``radius`` of the bits ``order``."""
    n = len(fps)
    planes = _planes(fps, order)
    levels = max(1, int(radius + 1).bit_length())
    found_i, found_j = [], []
    ends = np.r_[np.flatnonzero(group[1:] != group[:-1]) + 1, n]
    last = np.repeat(ends, np.diff(np.r_[0, ends]))  # end of each lane's group
    reach = last - np.arange(n) - 1  # followers that a lane has
    lanes = np.zeros(planes.shape[1] * 64, bool)
    for d in range(1, int(reach.max(initial=0)) + 1):
        lanes[:n] = reach >= d
        valid = np.packbits(lanes, bitorder="little").view(U64)
        w = np.flatnonzero(valid)
        ok = valid[w]
        hop, bit = divmod(d, 64)
        count = [np.zeros(len(w), U64) for _ in range(levels)]
        over = ~ok
        for p in range(len(order)):
            x = planes[p, w + hop] if w[-1] + hop < planes.shape[1] else _take(planes[p], w + hop)
            if bit:
                x = (x >> U64(bit)) | (_take(planes[p], w + hop + 1) << U64(64 - bit))
            x ^= planes[p, w]
            for c in count:  # carry-save: add one bit to each lane's counter
                carry = c & x
                c ^= x
                x = carry
            over |= x
            if p % 4 == 3 or p == len(order) - 1:
                gone = over | _above(count, radius)
                alive = gone != U64(0xFFFFFFFFFFFFFFFF)
                if not alive.all():
                    w, over, count = w[alive], over[alive], [c[alive] for c in count]
                    if not len(w):
                        break
        if len(w):
            near = ~(over | _above(count, radius))
            r, b = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = w[r] * 64 + b
            found_i.append(i)
            found_j.append(i + d)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _take(plane: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at < len(plane), plane[np.minimum(at, len(plane) - 1)], U64(0))


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more = more | (same & count[k])
            same = same & ~count[k]
    return more


def _compare(batches):
    """Pairs of near fingerprints from rows (path, k, fp) sorted by these; a bucket may span batches."""
    rest = None
    names = ["a", "b"]

    def emit(path, k, fp):
        for p in np.unique(path):
            key = KEYS[int(p)]
            m = path == p
            f, g = fp[m], k[m]
            at = 0
            while at < len(f):  # about 64,000 lanes at once, whole buckets
                to = min(at + 65536, len(f))
                if to < len(f):
                    same = np.searchsorted(g, g[to], "left")
                    to = int(same) if same > at else int(np.searchsorted(g, g[to], "right"))
                i, j = near_lanes(f[at:to], g[at:to], key.free)
                a, b = f[at:to][i], f[at:to][j]
                x = a ^ b
                mine = (x & U64(_mask(key.bits))) == 0  # the bucket's key is a hash of the bits
                for e in key.earlier:
                    mine &= (x & U64(e)) != 0
                a, b = a[mine].view(np.int64), b[mine].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=names)
                at = to

    for batch in batches:
        path, k, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        fp = fp.view(U64)
        if rest is not None:
            path, k, fp = (np.concatenate(x) for x in zip(rest, (path, k, fp)))
        if not len(path):
            continue
        cut = int(np.flatnonzero((path != path[-1]) | (k != k[-1])).max(initial=-1)) + 1
        yield from emit(path[:cut], k[:cut], fp[:cut])
        rest = path[cut:], k[cut:], fp[cut:]
    if rest is not None and len(rest[0]):
        yield from emit(*rest)


def near_pairs(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): each pair of distinct values of ``fp`` within the radius, once. ``fps``: distinct ``fp``."""
    pairs = None
    rows = fps.select("fp")
    for depth, level in enumerate(LEVELS):
        if depth == 0:
            keyed = rows.select("fp", F.explode(F.array(*[F.struct(F.lit(k.path).alias("path"), k.value().alias("k")) for k in level])).alias("x")).select("x.path", "x.k", "fp")
        else:
            sub = F.lit(None)
            for parent in LEVELS[depth - 1]:
                sub = F.when(F.col("path") == parent.path, F.array(*[F.struct(F.lit(k.path).alias("path"), k.value().alias("k")) for k in parent.split()])).otherwise(sub)
            # the bits of the new key include those of the old one
            keyed = rows.select("fp", F.explode(sub).alias("x")).select("x.path", "x.k", "fp")
        sizes = keyed.groupBy("path", "k").agg(F.count("*").alias("n")).filter("n > 1")
        shared = keyed.join(sizes, ["path", "k"])
        last = depth == len(LEVELS) - 1
        if not last:
            shared = written(shared, f"simhash-keys-{depth}")
        now = shared if last else shared.filter(F.col("n") <= block)
        found = now.select("path", "k", "fp").repartition("path", "k").sortWithinPartitions("path", "k", "fp").mapInArrow(_compare, "a long, b long")
        pairs = found if pairs is None else pairs.unionAll(found)
        if last or shared.filter(F.col("n") > block).isEmpty():
            return pairs
        rows = shared.filter(F.col("n") > block).select("path", "fp")


# --- components ---------------------------------------------------------------------------------------------------


#: Nodes of which the local union-find remembers links at a time.
_NODES = 1 << 20


def _forest(kind: str):
    """Links replaced by links from each node to the least of its component among the links at hand."""
    of = pa.int64() if kind == "long" else pa.string()

    def emit(parent, find):
        nodes = [x for x in parent if find(x) != x]
        for at in range(0, len(nodes), 1 << 16):
            part = nodes[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, of), pa.array([find(x) for x in part], of)], names=["u", "v"])

    def run(batches):
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > _NODES:  # what is left is the rounds' work
                yield from emit(parent, find)
                parent.clear()
        yield from emit(parent, find)

    return run


#: Links that one task's union-find settles alone, about 100 MB; more are settled by rounds.
_FEW = 1 << 18


def components(pairs: DataFrame, a: str = "a", b: str = "b", kind: str = "long", few: int = _FEW) -> DataFrame:
    """(u, v): for each node that has a link and isn't the least of its component, that least node. ``kind``: long or string.

    ``pairs`` should be a written table: its rows are counted, and up to ``few`` of them are settled in one task.
    """
    rows = pairs.select(F.col(a).cast(kind), F.col(b).cast(kind))
    if rows.count() <= few:
        return written(rows.coalesce(1).mapInArrow(_forest(kind), f"u {kind}, v {kind}"), "links")
    links = written(rows.mapInArrow(_forest(kind), f"u {kind}, v {kind}"), "links")
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(links)
    while before[0]:
        # large star: every neighbour above a node is linked to the node's least neighbour
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(both.join(least, "u").filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        # small star: a node's lower neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "links")
        links, last, before = now, before, mark(now)
        if before == last:
            break
    return links


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, fp, n_near, component_id) for each row."""
    fps = written(fingerprints(docs, key, text), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min(key).alias("rep")), "simhash-distinct")
    pairs = written(near_pairs(distinct, block), "simhash-pairs")
    ends = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(distinct.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    member = distinct.join(components(pairs).toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = member.join(ids, "root").join(others, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id")
    return fps.join(written(of, "simhash-classes"), "fp").select(key, "fp", "n_near", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id, and of rows with one id the first.

    Rows with a null id stay (they can't be named). Rows of one id but different texts count as that id's document.
    """
    gone, twice, first = (free(c, docs.columns) for c in ("_lost", "_again", "_first"))
    rows = written(linked(docs, key, text, block).select(key, "component_id"), "simhash-linked")
    lost = written(rows.filter(F.col("component_id") < F.col(key)).select(F.col(key).alias(gone)).distinct(), "simhash-lost")
    kept = docs.join(lost, F.col(key) == F.col(gone), "left_anti")
    again = written(rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(twice)).agg(F.count("*").alias("n")).filter("n > 1").select(twice), "simhash-again")
    if again.isEmpty():
        return kept
    one = kept.join(again, F.col(key) == F.col(twice), "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias(first)).select(f"{first}.*")
    return kept.join(again, F.col(key) == F.col(twice), "left_anti").unionAll(one)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
