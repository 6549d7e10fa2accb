import zlib

import numpy as np
import pytest

from sedimenta.llm import pieces as P
from sedimenta.llm import tokenids as T

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "it's they'll I'd DON'T 'S x's5", "½ ² 3 x1y", "ΑΣ Σ", "éa é", "<|endoftext|> a", "İstanbul", "a\x00b\x1cc\x85d e", "日本語 text 😀", "a_b __ --", "K Å ªº", "aaaa" * 50, "\n\n x \n", "▁ lit ▁x", "tab\there", " " * 40, "word " * 3000]


def test_encoder_as_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, lib = T.Encoder(path), Tokenizer.from_file(path)
    ids, off = enc(ODD)
    assert [ids[s:e].tolist() for s, e in zip(off, off[1:])] == [lib.encode(t, add_special_tokens=False).ids + [2] for t in ODD]


def test_orc(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(500 - i, f"text {i} of some") for i in range(60)] + [(1000, None)]
    out = f"file://{tmp_path}/ids"
    T.write_orc(docs(rows, "ids file"), out, path)
    got = {r.doc_id: r for r in T.read_orc(spark, out).collect()}
    at = 0
    for i, t in sorted(rows):
        want = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert len(got) == len(rows)


def test_orc_repeated_null_and_no_rows(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    T.write_orc(docs([(5, "a"), (5, "b b b"), (None, "c"), (4, "d")]), f"{tmp_path}/a", path)
    got = sorted((r.start, r.doc_id or -1, r.n_tokens) for r in T.read_orc(spark, f"{tmp_path}/a").collect())
    assert [g[0] for g in got] == [0, 2, 4, got[3][0]] and got[0][1] == -1 and got[-1][0] + got[-1][2] == 10
    T.write_orc(docs([]), f"{tmp_path}/b", path)
    assert T.read_orc(spark, f"{tmp_path}/b").collect() == []


def test_orc_stripes_indexes_and_lookup(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "STRIPE_BYTES", 4 << 10)
    monkeypatch.setattr(T, "ROW_STRIDE", 1000)
    rng = np.random.default_rng(2)
    words = [f"w{k}x{k * k}" for k in range(4000)]
    rows = [(i * 7, " ".join(rng.choice(words, 40).tolist())) for i in range(12_000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    T.write_orc(docs(rows).coalesce(1), f"file://{tmp_path}/x", path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stripes, kinds, encodings = 0, set(), set()
    for f in tmp_path.glob("x/*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows_ = reader.rows()
        for k in range(reader.getStripes().size()):
            stripes += 1
            footer = rows_.readStripeFooter(reader.getStripes().get(k))
            kinds |= {(footer.getStreams(i).getColumn(), footer.getStreams(i).getKind().toString()) for i in range(footer.getStreamsCount())}
            encodings |= {(i, footer.getColumns(i).getKind().toString()) for i in range(footer.getColumnsCount())}
        assert reader.getRowIndexStride() == 1000
        rows_.close()
    n_files = len(list(tmp_path.glob("x/*.orc")))
    assert stripes >= n_files > 1
    assert {(1, "BLOOM_FILTER_UTF8"), (1, "ROW_INDEX"), (3, "ROW_INDEX")} <= kinds and not any(c != 1 and k.startswith("BLOOM") for c, k in kinds)
    assert {(1, "DIRECT_V2"), (3, "DIRECT_V2")} <= encodings  # integers, run-length encoded
    found = T.lookup(spark, f"file://{tmp_path}/x", [7, 8, 700])
    enc = T.Encoder(path)
    ids, off = enc([dict(rows)[7], dict(rows)[700]])
    assert {r.doc_id: r.ids for r in found.collect()} == {7: ids[: off[1]].tolist(), 700: ids[off[1] :].tolist()}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_start_follows_the_files(spark, docs, tmp_path):
    """Rows of one id: ``start`` points at their own ids in the files' order."""
    path = public_tokenizers.path("word_bpe_49k.json")
    T.write_orc(docs([(5, t) for t in ("c c", "a", "b b b b", "a", None)] + [(4, "d"), (9, "e e")]), f"{tmp_path}/a", path)
    stored = [(r.doc_id, r.ids) for f in sorted((tmp_path / "a").glob("*.orc")) for r in spark.read.orc(f"file://{f}").coalesce(1).collect()]
    stored.sort(key=lambda r: r[0])
    flat = [i for _, x in stored for i in x]
    got = sorted(T.read_orc(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [zlib.crc32(np.array(flat[r.start : r.start + r.n_tokens], "<u4").tobytes()) for r in got] == [r.ids_crc32 for r in got]
    assert [r.doc_id for r in got] == [i for i, _ in stored] and len(got) == 7


def test_hot_id_is_split(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(5, f"some text {k}") for k in range(3000)] + [(k, f"t {k}") for k in range(10)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write_orc(docs(rows), f"{tmp_path}/a", path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    sizes = [spark.read.orc(f"file://{f}").filter("doc_id = 5").count() for f in sorted((tmp_path / "a").glob("*.orc"))]
    assert sum(sizes) == 3001 and max(sizes) < 1000
    got = sorted(T.read_orc(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_without_dropout_as_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t for t in ODD if "▁" not in t and "\x00" not in t]
    ids, off = P.Coder(MODEL, 1, 0.0)(texts, texts)
    assert [ids[s:e].tolist() for s, e in zip(off, off[1:])] == sp.encode(texts)


def _agenda(pieces, word, key, rate):
    """The agenda on one word, in plain Python."""
    from sedimenta.llm.common import fmix

    table = {int(k): (int(i), int(r)) for k, i, r in zip(pieces.pair_keys, pieces.pair_ids, pieces.pair_ranks)}
    char = dict(zip(pieces.chars.tolist(), pieces.char_ids.tolist()))
    syms = [(char.get(ord(c), pieces.unknown) if c != "▁" else pieces.unknown, k, k + 1) for k, c in enumerate(word)]
    skipped = set()
    while True:
        best = None
        for j in range(len(syms) - 1):
            (a, s, m), (b, _, e) = syms[j], syms[j + 1]
            if a << 20 | b in table and (s, m, e) not in skipped:
                piece, rank = table[a << 20 | b]
                if best is None or rank < best[0]:
                    best = (rank, j, piece, (s, m, e))
        if best is None:
            return [x for x, _, _ in syms]
        _, j, piece, (s, m, e) = best
        h = fmix(np.array([key], np.uint64) ^ fmix(np.array([s << 42 | m << 21 | e], np.uint64)))[0]
        if h < np.uint64(int(rate * 2.0**64)):
            skipped.add((s, m, e))
            continue
        syms[j : j + 2] = [(piece, s, e)]


def test_dropout_as_agenda():
    c = P.Coder(MODEL, 1, 0.1)
    p = c.pieces
    words = [" international", " hello", " x", "unbelievable", " Donaudampfschiff", " été", "aaaaaaaa"]
    keys = np.arange(1, 8, dtype=np.uint64) * np.uint64(0x123456789ABCDEF)
    for rate in (0.0, 0.1, 0.5, 0.9):
        c.limit = int(rate * 2.0**64)
        c._forget()
        c.number.update(zip(words, range(len(words))))
        c._learn(words)
        for again in range(3):  # learnt, then remembered
            node = c._drawn(np.arange(len(words)), keys) if rate else np.arange(len(words))
            for k, w in enumerate(words):
                at, n = c.ids.at[node[k]], c.ids.size[node[k]]
                want = _agenda(p, w, int(keys[k]), rate)
                assert c.ids.flat[at : at + n].tolist() == want == p.long(w, int(keys[k]), c.limit).tolist()


def test_long_words(docs):
    import time

    import sentencepiece

    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefghijklmnopeeeéß"), 300_000).tolist())
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    began = time.time()
    plain, _ = P.Coder(MODEL, 1, 0.0)([text], ["d"])
    varied, off = P.Coder(MODEL, 1, 0.1)([text], ["d"])
    assert time.time() - began < 30
    assert plain.tolist() == sp.encode(text) and len(varied) > len(plain)
    data, _ = P.Coder(MODEL, 1, 0.1).pieces.decode(varied.astype(np.int64), off)
    assert data.tobytes().decode() == text
    word = " " + text[:200]
    ids, _ = P.Coder(MODEL, 1, 0.3)([text[:200] + " x"], ["k"])
    import xxhash

    from sedimenta.llm.common import fmix

    own = int(fmix(np.array([xxhash.xxh64_intdigest("k", 1)], np.uint64))[0])
    want = _agenda(P.Pieces(MODEL), word, own, 0.3)
    assert ids[: len(want)].tolist() == want


def test_lossless_and_varied(docs):
    rows = list(enumerate(ODD)) + [(90 + i, "the same international sentence about segmentation " * 5) for i in range(9)] + [(99, None), (None, "x y"), (90, "again")]
    got = P.coded(docs(rows, "k ids"), MODEL).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert len({tuple(r.ids) for r in got if 90 <= (r.doc_id or 0) < 99 and r.n_bytes > 9}) > 3
    d = docs(rows, "clash")
    enc = P.encode(d, MODEL)
    back = P.decode(enc, MODEL, text="back").collect()
    assert all(r.back == r.text for r in back) and enc.columns == [*d.columns, "ids"]
    assert {(r.doc_id, tuple(r.ids or ())) for r in back if r.text} == {(r.doc_id, tuple(r.ids)) for r in got if r.ids}
    assert P.coded(docs([]), MODEL).collect() == []


def test_each_occurrence_draws():
    """Of a word's many occurrences the expected share skips nothing, and each is the agenda with its own key."""
    import xxhash

    from sedimenta.llm.common import fmix

    n, word = 3000, " international"
    c = P.Coder(MODEL, 1, 0.1)
    ids, off = c([(word * n)[1:]], ["d"])
    done = []
    plain, _ = c.pieces.segment([word], None, done)
    merges = sum(len(x) for _, x in done)
    place = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = fmix(np.uint64(xxhash.xxh64_intdigest("d", 1)) + place)
    want = [_agenda(c.pieces, word, int(k), 0.1) for k in keys[:200]]
    assert ids[: sum(map(len, want))].tolist() == [i for w in want for i in w]
    each = [tuple(c.pieces.long(word, int(k), c.limit).tolist()) for k in keys]
    assert ids.tolist() == [i for w in each for i in w] and len(set(each)) > 8
    undrawn = c._drawn(np.full(n, c.number[word]), keys) == c.number[word]
    assert abs(np.mean(undrawn) - 0.9**merges) < 0.03
    assert all(e == tuple(plain.tolist()) for e, u in zip(each, undrawn) if u)
