"""Document fingerprints by MinHash.

Each text is cut into shingles of three words (runs without white space, ASCII case folded; a shorter text is one
shingle). A shingle's 64-bit hash goes through ``PERMUTATIONS`` universal hash functions (multiply-add-shift, random
odd multipliers), all in numpy over whole buffers of text; the least value of each is one place of the fingerprint,
kept as 16 bits. The share of equal places estimates the Jaccard likeness of two texts' shingles.

``near_duplicates`` joins bands of the fingerprint in Spark and verifies by Jaccard:

1. Texts of one shingle set (told by a 128-bit digest) are folded to a class with a count: thousands of copies are one.
2. Classes are placed in ``BANDS`` buckets; each is tied to the least class of its buckets, and the ties' connected
   parts (star rounds) hold every pair that shares a bucket. Bucket keys are aggregated, so a hot one is no bottleneck.
3. The text of one row a class is fetched for classes that share a bucket. A part whose texts exceed ``PART_BYTES`` is cut
   into blocks, and each pair of blocks is a task of its own; in a task, numpy finds the pairs that share a bucket and
   counts their common shingles. No pair is emitted: a class gets its number of links from each task, and a tie to the
   least class of the classes it is linked with there. No bucket or part is capped.
4. The ties' connected parts are the classes of near duplicates.

Defined results: a null or empty text has the fingerprint of no shingle (all ones), like any other such text and
unlike all else; equal texts have equal fingerprints; documents follow one another by id, null ids first, rows of
equal id in an order that their texts fix; the last is followed by the first, so a single row follows itself; ids are
whole numbers (other types raise); a class of null ids alone has the class id null, and rows with a null id are linked
like any other; no rows give no rows. Further columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.common import U64, batched, buffers, documents, fmix, lowered, packed, prefix_hash, slices, span_hash, text_or_empty, unpacked, words_of, written

PERMUTATIONS = 64
SHINGLE = 3
BANDS = 16
SEED = 42
LIKE = 0.8
#: Bytes of text of a part that are compared in one task.
PART_BYTES = 4 << 20
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * U64(2) + U64(1)
_ADD = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_STEP = 1 << 15


def shingle_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle of the buffer's texts and, of each text, where its shingles begin (n+1)."""
    data = lowered(data)
    starts, ends, first = words_of(data, off)
    n = np.diff(first)
    k = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    begin = np.concatenate([[0], np.cumsum(k)])
    if not len(starts):
        return np.zeros(0, U64), begin
    w = span_hash(prefix_hash(data), starts, ends)
    row = np.repeat(np.arange(len(k)), k)
    i = first[:-1][row] + np.arange(len(row)) - begin[:-1][row]
    h = w[i]
    for j in range(1, SHINGLE):
        more = n[row] > j
        h = fmix(h) * U64(0x9FB21C651E98DF25) + np.where(more, w[np.minimum(i + j, len(w) - 1)], U64(j))
    return fmix(h), begin


def signatures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, PERMUTATIONS) uint16."""
    return _least(*shingle_hashes(data, off))


def _least(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The signatures of the shingle hashes ``h``, of which ``begin`` tells where each text's begin."""
    out = np.full((PERMUTATIONS, len(begin) - 1), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(begin))
    for lo in range(0, len(h), _STEP):  # a run that stays in the cache for all permutations
        x = h[lo : lo + _STEP]
        a, b = np.searchsorted(begin[some], lo, "right") - 1, np.searchsorted(begin[some], lo + len(x), "left")
        rows = some[a:b]
        heads = np.maximum(begin[rows] - lo, 0)
        for p in range(PERMUTATIONS):
            v = ((x * _MUL[p] + _ADD[p]) >> U64(32)).astype(np.uint32)
            out[p, rows] = np.minimum(out[p, rows], np.minimum.reduceat(v, heads))
    return np.ascontiguousarray((out & np.uint32(0xFFFF)).astype(">u2").T)


def set_digests(h: np.ndarray, begin: np.ndarray) -> list[str]:
    """128-bit digests of the texts' sets of shingle hashes."""
    return [hashlib.md5(np.unique(h[s:e]).tobytes()).hexdigest() for s, e in zip(begin[:-1].tolist(), begin[1:].tolist())]


def _pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return _pack_bytes([t.encode() for t in texts])


def _pack_bytes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=off[1:])
    return np.frombuffer(b"".join(raw), np.uint8), off


def signatures_of(texts: list[str]) -> np.ndarray:
    return signatures(*_pack(texts))


def _whole(docs: DataFrame, key: str) -> None:
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is no whole number")


def _in_order(docs: DataFrame, key: str) -> DataFrame:
    """(part, i, z, extra): ranges of documents by key; the first of each range is also the ``extra`` of the range before it.

    ``z`` is the compressed text. Only ids are looked at to find the ranges. There is one extra row a range, so the join
    that finds these broadcasts no more rows than there are shuffle partitions.
    """
    _whole(docs, key)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(key).cast("long").alias("i")).filter("i is not null")
    cuts = [c for c in sorted(set(ids.approxQuantile("i", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []))]
    part = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(int(c)) for c in cuts])
        part = F.when(F.col("i").isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e < F.col("i"))))
    rows = batched(docs).select(F.col(key).cast("long").alias("i"), text_or_empty("text").alias("text")).withColumn("part", part.cast("int"))
    # the least row of each range; ties of equal ids are broken by stored text, so only ids at the edge are compared by it
    least = written(rows.groupBy("part").agg(F.min(F.struct(F.col("i").isNotNull().alias("k"), F.col("i").alias("i"))).alias("m")).select("part", "m.i"), "minhash-ranges")
    wrap = Window.orderBy("part")
    firsts = least.select("i", F.coalesce(F.lag("part").over(wrap), F.max("part").over(Window.partitionBy())).alias("to"))
    edge = rows.join(F.broadcast(firsts), rows["i"].eqNullSafe(firsts["i"])).select("to", rows["i"].alias("i"), packed("text").alias("z")).groupBy("to").agg(F.min(F.struct("i", "z")).alias("m"))
    extra = edge.select(F.col("to").cast("int").alias("part"), "m.i", "m.z", F.lit(True).alias("extra"))
    return rows.select("part", "i", packed("text").alias("z"), F.lit(False).alias("extra")).unionAll(extra)


def edited(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, likenesses to that and to the next document, ``digest`` of its shingle set."""

    def emit(rows):
        """Fingerprints of consecutive rows but the last, which only follows."""
        texts = [t for _, _, t in rows]
        n = len(texts) - 1
        mixed = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]
        h, begin = shingle_hashes(*_pack(texts))
        a, b = _least(h, begin), signatures_of(mixed)
        near_edited = (a[:-1] == b).mean(axis=1)
        near_next = (a[:-1] == a[1:]).mean(axis=1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for _, i, _ in rows[:n]], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(m.encode()).hexdigest() for m in mixed]),
                pa.array([x.tobytes().hex() for x in a[:n]]),
                pa.array([x.tobytes().hex() for x in b]),
                pa.array(near_edited),
                pa.array(near_next),
                pa.array(set_digests(h, begin[: n + 1])),
            ],
            names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "digest"],
        )

    def run(batches):
        """Rows sorted by (part, extra, i, z): a part's rows, then the first of the next part."""
        held, size = [], 0
        for b in slices(batches, "z"):
            for part, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), unpacked(b.column(2))):
                if held and (held[-1][0] != part or size > 1 << 20):
                    if len(held) > 1:
                        yield emit(held)
                    held, size = held[-1:] if held[-1][0] == part else [], 0
                held.append((part, i, t.decode()))
                size += len(t)
        if len(held) > 1:
            yield emit(held)

    rows = _in_order(docs, key)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "extra", F.col("i").asc_nulls_first(), "z").select("part", "i", "z")
    return rows.mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, digest string")


# --- near duplicates ------------------------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint hex string)"""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes().hex() for x in signatures(*buffers(b.column(1)))])], names=[key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return batched(docs).select(key, text_or_empty(text).alias("text")).mapInArrow(run, f"{key} {kind}, fingerprint string")


def _prints(rows: DataFrame) -> DataFrame:
    """(i, th, digest, bands binary) of rows (i, th, text): ``bands`` are the bucket keys, 8 bytes each."""

    def run(batches):
        for b in slices(batches):
            h, begin = shingle_hashes(*buffers(b.column(2)))
            keys = [x.tobytes() for x in _least(h, begin)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(set_digests(h, begin)), pa.array(keys, pa.binary())], names=["i", "th", "digest", "bands"])

    return rows.mapInArrow(run, "i long, th long, digest string, bands binary")


_LINKED = "digest string, more long, other string"


def _linked(like: float, bands: int):
    """Rows (part, a, b, block, digest, n, z) sorted by (part, a, b, digest), a task a run of (part, a, b), to links."""

    def emit(rows):
        one = rows[0][1] == rows[0][2]
        rows.sort(key=lambda r: r[3] != r[1])  # the first block's rows first
        first = len(rows) if one else sum(r[3] == r[1] for r in rows)
        n = np.array([r[5] for r in rows], np.int64)
        h, begin = shingle_hashes(*_pack_bytes(unpacked([r[6] for r in rows])))
        keys = _least(h, begin).reshape(len(rows), bands, -1)
        keys = np.stack([np.unique(keys[:, k], axis=0, return_inverse=True)[1].ravel() for k in range(bands)], axis=1)
        sets = [np.unique(h[s:e]) for s, e in zip(begin[:-1].tolist(), begin[1:].tolist())]
        size = np.array([len(x) for x in sets], np.int64)
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        starts = ends - size
        mark = np.zeros(len(number) + 1, np.int32)
        more, head = np.zeros(len(rows), np.int64), list(range(len(rows)))

        def find(i):
            while head[i] != i:
                head[i] = head[head[i]]
                i = head[i]
            return i

        for i in range(first):
            after = i + 1 if one else first
            js = after + np.flatnonzero((keys[after:] == keys[i]).any(axis=1))
            if not len(js):
                continue
            mine = number[starts[i] : ends[i]]
            mark[mine] = 1
            if 2 * len(js) > js[-1] - js[0]:  # a run
                lo, hi = int(js[0]), int(js[-1]) + 1
                both = np.add.reduceat(np.append(mark[number[starts[lo] : ends[hi - 1]]], 0), starts[lo:hi] - starts[lo])[js - lo]
            else:
                heads = np.cumsum(size[js]) - size[js]
                both = np.add.reduceat(np.append(mark[number[np.arange(int(size[js].sum())) - np.repeat(heads - starts[js], size[js])]], 0), heads)
            both = both * (size[js] > 0)
            mark[mine] = 0
            near = js[both >= like * (size[i] + size[js] - both)]
            more[i] += n[near].sum()
            more[near] += n[i]
            for j in near.tolist():
                x, y = find(i), find(j)
                head[max(x, y)] = min(x, y)
        tied = np.flatnonzero(more > 0)
        digests = [r[4] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([digests[i] for i in tied], pa.string()), pa.array(more[tied]), pa.array([digests[find(i)] for i in tied], pa.string())], names=[x.split()[0] for x in _LINKED.split(", ")])

    def run(batches):
        held = []
        for batch in slices(batches, "z"):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:3] != row[:3]:
                    yield emit(held)
                    held = []
                if not held or held[-1][4] != row[4]:  # copies of a row
                    held.append(row)
        if held:
            yield emit(held)

    return run


def classes_of(docs: DataFrame, like: float = LIKE, bands: int = BANDS, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(digest, class_id, n_links) of each shingle set that several rows have or that is linked to others."""
    from sedimenta.llm.simhash import components

    _whole(docs, key)
    rows = batched(docs).select(F.col(key).cast("long").alias("i"), text_or_empty(text).alias("text")).select("i", F.xxhash64("text").alias("th"), "text")
    least = F.min(F.struct(F.col("i").isNull().alias("null"), "i", "th"))
    sets = written(_prints(rows).groupBy("digest").agg(least.alias("at"), F.min("i").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands")), "minhash-sets")
    width = 2 * PERMUTATIONS // bands
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.substring("bands", k * width + 1, F.lit(width)))))
    placed = sets.select("digest", band.alias("band"))
    heads = placed.groupBy("band").agg(F.min("digest").alias("head"), F.count("*").alias("c")).filter("c > 1").select("band", "head")
    ties = written(placed.join(heads, "band").filter("digest <> head").select("digest", "head").distinct(), "minhash-ties")
    parts = components(ties, "digest", "head", "string")
    # a part's least set is in no row of it
    within = parts.select(F.col("u").alias("digest"), F.col("v").alias("part")).unionAll(parts.select(F.col("v").alias("digest"), F.col("v").alias("part")).distinct())
    within = written(within.join(sets.select("digest", "at", "n"), "digest").select("digest", "part", "n", F.col("at.i").alias("at_i"), F.col("at.th").alias("at_th")), "minhash-parts")
    fetched = rows.join(within, rows["i"].eqNullSafe(within["at_i"]) & (rows["th"] == within["at_th"])).select("part", "digest", "n", packed("text").alias("z"))
    fetched = written(fetched, "minhash-texts")
    weight = written(fetched.groupBy("part").agg(F.ceil(F.sum(F.length("z")) * 2 / part_bytes).cast("int").alias("g")).filter("g > 1"), "minhash-large")
    many = fetched.join(weight, "part", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    many = many.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("g")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    pairs = many.select("part", F.least("block", "x").alias("a"), F.greatest("block", "x").alias("b"), "block", "digest", "n", "z")
    links = written(pairs.repartition("part", "a", "b").sortWithinPartitions("part", "a", "b", "digest").mapInArrow(_linked(like, bands), _LINKED), "minhash-links")
    more = links.groupBy("digest").agg(F.sum("more").alias("more"))
    roots = components(links.filter("digest <> other").select("digest", "other"), "digest", "other", "string").toDF("digest", "root")
    known = sets.select("digest", "rep", "n").join(roots, "digest", "left").join(more, "digest", "left").filter("n > 1 or more > 0").withColumn("root", F.coalesce("root", "digest"))
    known = written(known.select("digest", "rep", "root", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "minhash-known")
    least = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    return written(known.join(least, "root").select("digest", "class_id", "n_links"), "minhash-classes")


def _classed(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``class_id`` and ``n_links`` by their ``digest``."""
    joined = rows.join(classes.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left").drop("_digest", "digest")
    # a class of null ids alone keeps a null
    return joined.withColumn("class_id", F.when(F.col("n_links").isNull(), F.col(key).cast("long")).otherwise(F.col("class_id"))).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))


def near_duplicates(docs: DataFrame, like: float = LIKE, bands: int = BANDS, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, class_id, n_links): documents linked by a shared band and a verified Jaccard likeness of ``like`` or more.

    ``class_id`` is the least id of the document's class; ``n_links`` counts the documents that it is linked to, copies
    of its own text included.
    """
    rows = batched(docs).select(F.col(key).cast("long").alias("i"), F.lit(0).cast("long").alias("th"), text_or_empty(text).alias("text"))
    prints = _prints(rows).select(F.col("i").alias(key), "digest")
    return _classed(prints, classes_of(docs, like, bands, key, text, part_bytes), key)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _classed(edited(docs), classes_of(docs), "doc_id")


QUERIES = {"op7_fingerprints": op7_fingerprints}
ORACLES: dict[str, str] = {}
