"""Token ids in ORC: stripes, integer run-length encoding, row indexes and Bloom filters on document ids.

Texts are range-partitioned by document id and sorted within partitions before they are encoded, so ids go straight
from the encoder to the writer and each file holds a contiguous range of documents. ORC stores them in stripes
(readers take stripes in parallel), integers run-length encoded, with a row index for every ``ROW_STRIDE`` rows and a
Bloom filter on the id column, so that a lookup by id opens few stripes.

The tokenizers library encodes each distinct word once for a worker; a text is split as the tokenizer's own
normaliser and pre-tokenizer split it, and its words' ids are put together in numpy. Texts with characters outside of
what that split is proven for (above U+024F, or not composed) go to the library whole.

Defined results: a null or empty text has only the end id; rows with a null id come first; rows of equal id are in an
order that their texts fix, and ``start`` follows the order in the files; no rows give no rows. Further columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import batched, documents, slices, table_path, text_or_empty, written

END = 2
ROW_STRIDE = 1000
STRIPE_BYTES = 16 << 20
#: Words that a worker remembers before it starts anew.
REMEMBERED = 1_000_000

_LETTERS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)))
_DIGITS = "0-9²³¹¼-¾"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
_SIMPLE = re.compile(r"[\t-\r\x20-ɏ]*")


class Encoder:
    """Texts to ids, with a memory of words."""

    def __init__(self, path: str, end: int | None = END):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.offset = np.zeros(1 << 14, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode new words and append them to the memory."""
        if len(self.number) + len(words) > REMEMBERED and self.number:
            self._forget()
        got, sizes = self._encode(words)
        at = len(self.number)
        need = at + len(words) + 1
        if need > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros(max(need, len(self.offset)), np.int64)])
        self.offset[at + 1 : need] = self.offset[at] + np.cumsum(sizes)
        total = int(self.offset[need - 1])
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.uint32)])
        self.flat[self.offset[at] : total] = got
        self.number.update(zip(words, range(at, at + len(words))))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and how many each has: many words in one call, told apart by the ids that end a word."""
        parts, sizes = [], []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                each = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                ids, ends = np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
            parts.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(parts), np.concatenate(sizes)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the n+1 offsets of the texts in them."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        whole = {}
        for k, t in enumerate(texts):
            if _SIMPLE.fullmatch(t) and (t.isascii() or unicodedata.is_normalized("NFC", t)) and "<|" not in t and "İ" not in t:
                found = _WORD.findall(t.lower())
                counts[k] = len(found)
                words += found
            else:
                whole[k] = self.tokenizer.encode(t, add_special_tokens=False).ids
        new = list(set(words).difference(self.number))
        if new:
            before = len(self.number)
            self._learn(new)
            if len(self.number) < before + len(new):  # it forgot: what this call needs is learnt again
                self._learn(list(set(words).difference(self.number)))
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        begin, size = self.offset[number], self.offset[number + 1] - self.offset[number]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) - np.repeat(ends - size - begin, size)]
        first = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if not whole and self.end is None:
            return ids, first
        lens = np.diff(first)
        for k, x in whole.items():
            lens[k] = len(x)
        off = np.concatenate([[0], np.cumsum(lens + (self.end is not None))])
        out = np.full(int(off[-1]), self.end or 0, np.uint32)
        plain = np.diff(first)
        out[np.arange(total) + np.repeat(off[:-1] - first[:-1], plain)] = ids
        for k, x in whole.items():
            out[off[k] : off[k] + len(x)] = x
        return out, off


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end: int | None = END) -> Encoder:
    """This worker's encoder."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def encode(docs: DataFrame, tokenizer: str, end: int | None = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>), rows where they were."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(tokenizer, end)
        for b in slices(batches):
            ids, off = enc(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return batched(docs).select(key, text_or_empty(text).alias("text")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def write_orc(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, key: str = "doc_id", text: str = "text") -> None:
    """The ids of every document as ORC files, each a range of document ids in ascending order; their names are in that order.

    Ranges are of (id, hash of the text), so an id that many rows share is split too.
    """
    order = [F.col(key).asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(key, text_or_empty(text).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    options = {"orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(ROW_STRIDE), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zlib"}
    encode(rows, tokenizer, end, key).write.options(**options).orc(path)


def read_orc(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """Per document, from the files: ``start`` (ids before it), ``n_tokens`` and ``ids_crc32``."""

    def digest(batches):
        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(3)
            off = np.asarray(col.offsets).astype(np.int64)
            raw = memoryview(np.ascontiguousarray(np.asarray(col.values)).astype("<u4", copy=False).view(np.uint8))
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            nth = []
            for piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = n + 1 if piece == last else 0
                last = piece
                nth.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nth, pa.int64()), b.column(2), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["file", "block", "nth", key, "n_tokens", "ids_crc32"])

    files = spark.read.schema(f"{key} {kind}, ids array<int>").orc(path)
    rows = files.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), key, "ids")
    # read once; a piece of a file is read in order
    rows = written(rows.mapInArrow(digest, f"file string, block long, nth long, {key} {kind}, n_tokens long, ids_crc32 long"), "token-digests")
    # files are ranges in the order of their numbers: one row a file gives where each begins, and only rows of one file are sorted together
    per = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    begins = per.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    here = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("begin") + F.coalesce(F.sum("n_tokens").over(here), F.lit(0))
    return rows.join(begins, "file").select(key, start.alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: list, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """(key, ids) of some documents: the filter is pushed into the scan, where statistics, row index and Bloom filters skip what can't match."""
    return spark.read.schema(f"{key} {kind}, ids array<int>").orc(path).filter(F.col(key).isin(keys))


def op2_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = table_path(spark, "token-ids")
    write_orc(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_orc(spark, path)


QUERIES = {"op2_orc_token_ids": op2_orc_token_ids}
ORACLES: dict[str, str] = {}
