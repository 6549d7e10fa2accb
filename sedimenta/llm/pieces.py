"""SentencePiece encoding and decoding with seeded merge-dropout.

A BPE SentencePiece model is applied by agenda: of all adjacent symbols whose concatenation is a piece, the best-scored
(leftmost of equals) merges first. Each candidate, told by its span in the word, is skipped for good if its keyed hash
lies under the dropout rate, so segmentations vary in which merges they use, yet all decode to the same text. The key
is (seed, document id, place of the word in it), so each occurrence draws for itself, results don't depend on
partitioning and a rerun agrees. Rate 0 gives the library's own segmentation.

No piece of such a vocabulary joins text across a blank that follows a non-blank, nor across a line feed, so words are
segmented on their own: thousands at once in numpy (a round merges the best candidate of every word). A worker
remembers segmentations as a tree: a node is a word and the candidates skipped so far, it knows the merges that follow
if none of them is skipped, and the first of an occurrence's draws that skips one leads to a child. So each occurrence
gets what its own draws give, while frequent outcomes are looked up. A word of over ``LONG`` characters has an agenda of
its own, a heap, which takes n log n steps.

Lossless: characters without a piece become byte pieces, and so does a literal U+2581, which the library would turn
into a blank.

Defined results: a null text gives null ids and decodes to null; an empty text has no ids; texts of any length are
encoded whole; rows with a null id are keyed as the empty string; repeated rows are encoded alike; no rows give no
rows. Further columns don't matter.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import U64, batched, buffers, documents, fmix, slices

SEED = 42
DROPOUT = 0.1
#: Segmentations that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Words of more characters are segmented alone and not remembered.
LONG = 128
_BLANK = "▁"
_WORD = re.compile(r" *[^ \n]+| +|\n+")
_NEVER = np.iinfo(np.int64).max
_ALL = (1 << 64) - 1


def _mix(x: int) -> int:
    """``fmix`` of one number."""
    x &= _ALL
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & _ALL
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & _ALL
    return x ^ x >> 33


def _span(begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of a candidate: where its two symbols begin in the word and where the second ends."""
    return fmix(begin.astype(U64) << U64(42) | middle.astype(U64) << U64(21) | end.astype(U64))


def _in_word(word: np.ndarray, span: np.ndarray) -> np.ndarray:
    return fmix(span + word.astype(U64) * U64(0x9E3779B97F4A7C15))


class Pieces:
    """The vocabulary of a BPE SentencePiece model with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        raw, plain = [b""] * n, {}
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                raw[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                plain[p] = i
                raw[i] = p.replace(_BLANK, " ").encode()
        if any(_BLANK in p.lstrip(_BLANK) for p in plain):
            raise ValueError("a piece joins words")
        self.unknown = n
        chars = sorted((ord(" ") if p == _BLANK else ord(p), i) for p, i in plain.items() if len(p) == 1 and p != " ")
        self.chars = np.array([c for c, _ in chars], np.uint32)
        self.char_ids = np.array([i for _, i in chars], np.int64)
        # pairs of pieces whose concatenation is a piece, by rank (best score first)
        rank = {i: r for r, i in enumerate(sorted(plain.values(), key=lambda i: (-sp.get_score(i), i)))}
        same = {}
        for i in plain.values():  # equal scores tie
            same.setdefault(sp.get_score(i), rank[i])
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (i, same[sp.get_score(i)])
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = keys
        self.pair_ids = np.array([pairs[k][0] for k in keys.tolist()], np.int64)
        self.pair_ranks = np.array([pairs[k][1] for k in keys.tolist()], np.int64)
        self.bits = int(len(keys) * 4).bit_length()
        order = self._slot(keys)
        self.first = np.searchsorted(np.sort(order), np.arange((1 << self.bits) + 1))
        by = np.argsort(order, kind="stable")
        self.pair_keys, self.pair_ids, self.pair_ranks = keys[by], self.pair_ids[by], self.pair_ranks[by]
        self.deepest = int(np.diff(self.first).max())
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.table: dict[int, tuple[int, int]] | None = None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (fmix(keys.astype(U64)) >> U64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each concatenation; rank ``_NEVER`` if it is no piece."""
        keys = left << 20 | right
        slot = self._slot(keys)
        at, to = self.first[slot], self.first[slot + 1]
        ids, ranks = np.zeros(len(keys), np.int64), np.full(len(keys), _NEVER)
        for _ in range(self.deepest):
            some = np.flatnonzero(at < to)
            if not len(some):
                break
            hit = some[self.pair_keys[at[some]] == keys[some]]
            ids[hit], ranks[hit] = self.pair_ids[at[hit]], self.pair_ranks[at[hit]]
            at = at + 1
        return ids, ranks

    def _symbols(self, code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        return np.where((self.chars[at] == code) & (code != 0x2581), self.char_ids[at], self.unknown)

    def _with_bytes(self, sym: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the number of ids of each symbol; ``code`` is the first character of each."""
        odd = sym == self.unknown
        width = np.ones(len(sym), np.int64)
        c = code[odd].astype(np.int64)
        width[odd] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        ids = np.repeat(sym, width)
        if len(c):
            heads = (np.cumsum(width) - width)[odd]
            k = width[odd]
            first = np.where(k == 1, c, np.where(k == 2, 0xC0 | c >> 6, np.where(k == 3, 0xE0 | c >> 12, 0xF0 | c >> 18)))
            ids[heads] = self.byte_id[first]
            for j in range(1, 4):
                m = k > j
                ids[heads[m] + j] = self.byte_id[0x80 | c[m] >> 6 * (k[m] - 1 - j) & 0x3F]
        return ids, width

    def segment(self, words: list[str], skips: tuple[np.ndarray, np.ndarray] | None = None, done: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has. ``skips``: candidates not to merge, as words' numbers and span hashes.

        ``done`` gets the merges in order: arrays of the words' numbers and the spans' hashes.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self._symbols(code)
        word = np.repeat(np.arange(len(words)), sizes)
        begin = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(code))  # in ``code``; of a symbol its first character
        barred = np.zeros(0, U64) if skips is None else np.sort(_in_word(*skips))

        def candidates(i: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Merging the symbols i and i + 1, where the latter ends before ``last``."""
            ids, ranks = self.merged(sym[i], sym[i + 1])
            if len(barred):
                some = np.flatnonzero(ranks != _NEVER)
                j = i[some]
                x = _in_word(word[j], _span(begin[j], begin[j + 1], last[some]))
                ranks[some[barred[np.minimum(np.searchsorted(barred, x), len(barred) - 1)] == x]] = _NEVER
            return ids, ranks

        out_word, out_sym, out_place = [], [], []
        n = len(sym)
        end = np.repeat(sizes, sizes)

        def lasts(i: np.ndarray) -> np.ndarray:
            """Where symbol i + 1 ends within its word."""
            nxt = np.minimum(i + 2, len(sym) - 1)
            inside = (i + 2 < len(sym)) & (word[nxt] == word[i])
            return np.where(inside, begin[nxt], end[i])

        into, rank = np.zeros(n, np.int64), np.full(n, _NEVER)
        pair = np.flatnonzero(word[1:] == word[:-1]) if n > 1 else np.zeros(0, np.int64)
        if len(pair):
            into[pair], rank[pair] = candidates(pair, lasts(pair))
        while len(sym):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, heads)
            going = best != _NEVER
            span = np.diff(np.r_[heads, len(sym)])
            if not going.all():
                stay = np.repeat(~going, span)
                out_word.append(word[stay]), out_sym.append(sym[stay]), out_place.append(place[stay])
                move = ~stay
                sym, word, begin, place, end, into, rank = (x[move] for x in (sym, word, begin, place, end, into, rank))
                if not len(sym):
                    break
                best, span = best[going], span[going]
            hit = np.flatnonzero(rank == np.repeat(best, span))
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]  # the leftmost of each word
            if done is not None:
                done.append((word[hit], _span(begin[hit], begin[hit + 1], lasts(hit))))
            sym[hit] = into[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, begin, place, end, into, rank = (x[keep] for x in (sym, word, begin, place, end, into, rank))
            hit = hit - np.arange(len(hit))
            rank[hit] = _NEVER
            fresh = np.concatenate([hit, hit[hit > 0] - 1])
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            if len(fresh):
                into[fresh], rank[fresh] = candidates(fresh, lasts(fresh))
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, sym, place = np.concatenate(out_word), np.concatenate(out_sym), np.concatenate(out_place)
        order = np.argsort(place, kind="stable")
        word, sym, place = word[order], sym[order], place[order]
        ids, width = self._with_bytes(sym, code[place])
        return ids, np.bincount(word, weights=width, minlength=len(words)).astype(np.int64)

    def long(self, word: str, key: int, limit: int) -> np.ndarray:
        """Ids of one word, by a heap of candidates (rank, first character, ...); those of a draw under ``limit`` are never put in."""
        code = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        n = len(code)
        symbols = self._symbols(code)
        into, rank = self.merged(symbols[:-1], symbols[1:])
        at = np.arange(n - 1)
        if limit:
            rank[fmix(U64(key) ^ _span(at, at + 1, at + 2)) < U64(limit)] = _NEVER
        some = np.flatnonzero(rank != _NEVER)
        heap = [(r, i, i + 1, i + 2, t) for r, i, t in zip(rank[some].tolist(), some.tolist(), into[some].tolist())]
        heapq.heapify(heap)
        if self.table is None:
            self.table = dict(zip(self.pair_keys.tolist(), zip(self.pair_ids.tolist(), self.pair_ranks.tolist())))
        sym, end, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))  # a symbol is named by its first character
        pop, push, known = heapq.heappop, heapq.heappush, self.table.get
        while heap:
            _, i, j, e, t = pop(heap)
            if sym[i] < 0 or end[i] != j or end[j] != e:
                continue  # one of the two has merged since
            sym[i], sym[j], end[i] = t, -1, e
            if e < n:
                before[e] = i
            for a, b in ((before[i], i), (i, e)):
                if a >= 0 and b < n:
                    found = known(sym[a] << 20 | sym[b])
                    if found is not None and not (limit and _mix(key ^ _mix(a << 42 | b << 21 | end[b])) < limit):
                        push(heap, (found[1], a, b, end[b], found[0]))
        left = np.array(sym, np.int64)
        place = np.flatnonzero(left >= 0)
        return self._with_bytes(left[place], code[place])[0]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the rows' ids and their offsets, without the blank put before each text."""
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.raw[np.arange(total) - np.repeat(ends - size - self.raw_at[ids], size)]
        at = np.concatenate([[0], ends])[off]
        some = np.flatnonzero(np.diff(at))
        keep = np.ones(total, bool)
        keep[at[some]] = False
        gone = np.zeros(len(at), np.int64)
        gone[1:] = np.cumsum(np.diff(at) > 0)
        return data[keep], at - gone


class _Runs:
    """Runs of numbers, one a node, in one buffer that grows."""

    def __init__(self, kind):
        self.flat, self.used = np.zeros(1 << 12, kind), 0
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ``nodes`` end to end, and each number's place in its run."""
        size = self.size[nodes]
        ends = np.cumsum(size)
        nth = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        return self.flat[np.repeat(self.at[nodes], size) + nth], nth

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), self.flat.dtype)])
        self.flat[self.used : need] = values
        self.at = np.concatenate([self.at, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used = need


class Coder:
    """Texts to ids, with a memory of segmentations."""

    def __init__(self, path: str, seed: int = SEED, dropout: float = DROPOUT):
        self.pieces, self.seed, self.limit = Pieces(path), seed, min(int(dropout * 2.0**64), _ALL)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}  # the root node of each word
        self.child: dict[int, int] = {}  # node << 16 | number of the merge that is skipped
        self.word: list[str] = []
        # of each node its ids, the merges still open to a skip, the candidates skipped
        self.ids, self.spans, self.skips = _Runs(np.int32), _Runs(U64), _Runs(U64)

    def _learn(self, words: list[str], skips: np.ndarray | None = None, n_skips: int = 0, known: np.ndarray | int = 0) -> None:
        """New nodes of ``n_skips`` skips each; ``known``: how many merges of each come before its last skip, so are decided."""
        done: list = []
        number = np.arange(len(words))
        ids, size = self.pieces.segment(words, None if skips is None else (np.repeat(number, n_skips), skips), done)
        self.skips.add(np.zeros(0, U64) if skips is None else skips, np.full(len(words), n_skips))
        self.ids.add(ids.astype(np.int32), size)
        word = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in done)])
        span = np.concatenate([np.zeros(0, U64), *(s for _, s in done)])
        order = np.argsort(word, kind="stable")
        n = np.bincount(word, minlength=len(words)).astype(np.int64)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        known = np.broadcast_to(known, n.shape)
        self.spans.add(span[order][nth >= np.repeat(known, n)], np.maximum(n - known, 0))
        self.word += words

    def _children(self, keys: np.ndarray, depth: np.ndarray, n_skips: int) -> np.ndarray:
        """The nodes that ``keys`` (node << 16 | merge) lead to, by their ``n_skips``-th skip; ``depth``: how many merges precede that one."""
        at = np.array([*map(self.child.get, keys.tolist(), repeat(-1))], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            parent = keys[new] >> 16
            skips = np.empty((len(new), n_skips), U64)
            skips[:, :-1] = self.skips.of(parent)[0].reshape(len(new), n_skips - 1)
            skips[:, -1] = self.spans.flat[self.spans.at[parent] + (keys[new] & 0xFFFF)]
            first = len(self.word)
            self._learn([*map(self.word.__getitem__, parent.tolist())], skips.ravel(), n_skips, depth[new])
            at[new] = first + np.arange(len(new))
            self.child.update(zip(keys[new].tolist(), at[new].tolist()))
        return at

    def _drawn(self, node: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The nodes that occurrences of the words ``node`` with the keys ``own`` end at."""
        node = node.copy()
        left = np.flatnonzero(self.spans.size[node] > 0)
        depth = np.zeros(len(node), np.int64)
        n_skips = 0
        while len(left):
            s = node[left]
            size = self.spans.size[s]
            span, nth = self.spans.of(s)
            skip = fmix(np.repeat(own[left], size) ^ span) < U64(self.limit)
            first = np.minimum.reduceat(np.where(skip, nth, _NEVER), np.cumsum(size) - size)
            hit = first != _NEVER
            left, first, s = left[hit], first[hit], s[hit]
            if not len(left):
                break
            n_skips += 1
            keys, some, inverse = np.unique(s << 16 | first, return_index=True, return_inverse=True)
            depth[left] += first
            node[left] = self._children(keys, depth[left][some], n_skips)[inverse]
            left = left[self.spans.size[node[left]] > 0]
        return node

    def __call__(self, texts: list[str], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        find = _WORD.findall
        lists = [find(" " + t) if t else [] for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        words = [w for x in lists for w in x]
        first = np.concatenate([[0], np.cumsum(counts)])
        if not words:
            return np.zeros(0, np.int32), first
        if len(self.word) > REMEMBERED:
            self._forget()
        distinct = set(words)
        long = {w for w in distinct if len(w) > LONG}
        new = [w for w in distinct if w not in self.number and w not in long]
        if new:
            self.number.update(zip(new, range(len(self.word), len(self.word) + len(new))))
            self._learn(new)
        number = self.number if not long else {**dict.fromkeys(long, -1), **{w: self.number[w] for w in distinct - long}}
        node = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        own = np.zeros(len(words), U64)
        if self.limit:
            doc = np.fromiter((xxhash.xxh64_intdigest(k, self.seed) for k in keys), U64, len(keys))
            place = (np.arange(len(words)) - np.repeat(first[:-1], counts)).astype(U64)
            own = fmix(np.repeat(doc, counts) + place * U64(0x9E3779B97F4A7C15))
        short = np.flatnonzero(node >= 0)
        if self.limit:
            node[short] = self._drawn(node[short], own[short])
        begin, size, flat = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), self.ids.flat
        begin[short], size[short] = self.ids.at[node[short]], self.ids.size[node[short]]
        if long:
            alone = np.flatnonzero(node < 0)
            each = [self.pieces.long(words[i], int(own[i]), self.limit).astype(np.int32) for i in alone.tolist()]
            n = np.array([len(x) for x in each])
            begin[alone], size[alone] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate([flat, *each])
        ends = np.cumsum(size)
        ids = flat[np.arange(int(ends[-1])) - np.repeat(ends - size - begin, size)]
        return ids, np.concatenate([[0], ends])[first]


_CODERS: dict[tuple, Coder] = {}


def coder(*args) -> Coder:
    """This worker's coder."""
    if args not in _CODERS:
        _CODERS[args] = Coder(*args)
    return _CODERS[args]


def _lists(ids: np.ndarray, off: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)), mask=pa.array(null))


def encode(docs: DataFrame, model: str, seed: int = SEED, dropout: float = DROPOUT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int>; every column is kept."""

    @F.arrow_udf("array<int>")
    def ids_of(keys: pa.Array, texts: pa.Array) -> pa.Array:
        run = coder(model, seed, dropout)
        parts = []
        for b in slices([pa.RecordBatch.from_arrays([keys, texts], names=["k", "text"])]):
            null = np.asarray(b.column(1).is_null())
            ids, off = run([t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist())
            parts.append(_lists(ids, off, null))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return batched(docs).withColumn("ids", ids_of(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text).cast("string")))


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text that ``ids`` stand for."""

    @F.arrow_udf("string")
    def text_of(col: pa.Array) -> pa.Array:
        pieces = coder(model, SEED, 0.0).pieces
        null = np.asarray(col.is_null())
        col = col.fill_null([])
        values, off = np.asarray(col.flatten()).astype(np.int64), np.asarray(col.offsets).astype(np.int64)
        data, at = pieces.decode(values, off - off[0])
        out = pa.StringArray.from_buffers(len(col), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes()))
        return pa.array([None if n else t for n, t in zip(null, out.to_pylist())], pa.string()) if null.any() else out

    return batched(rows).withColumn(text, text_of(ids))


def coded(docs: DataFrame, model: str, seed: int = SEED, dropout: float = DROPOUT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, n_tokens, ids_crc32, n_bytes, lossless): encoded, decoded again and compared in one pass."""

    def run(batches):
        c = coder(model, seed, dropout)
        for b in slices(batches):
            null = np.asarray(b.column(2).is_null())
            ids, off = c([t or "" for t in b.column(2).to_pylist()], b.column(1).to_pylist())
            data, at = c.pieces.decode(ids.astype(np.int64), off)
            want, where = buffers(b.column(2))
            same = [bool(np.array_equal(data[s:e], want[p:q])) for s, e, p, q in zip(at[:-1].tolist(), at[1:].tolist(), where[:-1].tolist(), where[1:].tolist())]
            raw = memoryview(np.ascontiguousarray(ids.astype("<i4", copy=False)).view(np.uint8))
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids, off, null), pa.array(np.diff(off)), pa.array(crc, pa.int64()), pa.array(np.diff(where)), pa.array(same)], names=[key, "ids", "n_tokens", "ids_crc32", "n_bytes", "lossless"])

    kind = docs.schema[key].dataType.simpleString()
    rows = batched(docs).select(key, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} {kind}, ids array<int>, n_tokens long, ids_crc32 long, n_bytes long, lossless boolean")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(documents(spark, sf_dir), model_path())


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
