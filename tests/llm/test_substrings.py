import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sedimenta.llm import substrings as S


def _brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    out = []
    for i, b in texts:
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                cover[k : k + 200] = True
        edge = np.diff(np.r_[0, cover.astype(int)])
        out.append((i, len(b), int(cover.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()))
    return sorted(map(repr, out))


def _rows(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(n) for n in (150, 199, 200, 201, 260, 500, 900)]
    rows = []
    for i in range(40):
        parts = [word(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 3)
            parts += [s[a : len(s) - rng.randrange(0, len(s) // 3)], word(rng.randrange(0, 50))]
        rows.append((i, "".join(parts)))
    return rows + [(50, None), (51, ""), (52, "x" * 150), (53, "ab" * 400), (54, "ab" * 300), (55, rows[3][1]), (3, rows[3][1]), (None, shared[5]), (56, "a" * 201), (57, word(9000) + shared[6])]


@pytest.mark.parametrize("block", [S.BLOCK, 1])
def test_as_brute_force(docs, block):
    rows = _rows(block)
    got = S.deduplicated(docs(rows, "id th gram"), block=block).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == _brute(rows)


def test_hot_gram_as_brute_force(docs):
    """A gram with more contexts than ``BLOCK``, some of whose strings repeat; rows repeated whole."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shared, ends = word(150), [word(80) for _ in range(40)]
    rows = [(i, word(70) + shared + (rng.choice(ends) if i % 3 else word(80))) for i in range(S.BLOCK + 300)] + [(9000, word(400))] * 5
    got = S.deduplicated(docs(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = _brute(rows)
    assert sorted(repr(tuple(r)) for r in got) == want and sum(", 1, " in w for w in want) > 1000


def test_planted_collisions():
    """Different grams of one hash, and different strings of one hash, are told apart by their bytes."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    text = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    same = text(210)
    rows = [(7, k, 0, 1, 30, 11, b) for k, b in enumerate([same, text(210), text(210), bytes(c ^ 1 for c in same[:3]) + same[3:], text(210)])]
    names = [x.split()[0] for x in S._CONTEXT.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    got = [r for b in S._sorted_rows(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["c1"], r["first"], r["last"]) for r in got) == [(0, 3, 10), (3, 3, 10)]
    strings = sorted([(7, k, 0, 5, 1, 99, b) for k, b in enumerate([same[:200], text(200), same[:200], same[:200], same[:200], text(200)])], key=lambda r: r[6])
    names = [x.split()[0] for x in S._BYTES.split(", ")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=names) for part in (strings[:2], strings[2:])]
    got = [r for b in S._sorted_strings(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["c1"], r["first"], r["last"]) for r in got) == [(k, 5, 5) for k in (0, 2, 3, 4)]


def test_no_rows(docs):
    assert S.deduplicated(docs([])).collect() == []


def test_suffix_sort():
    rng = random.Random(3)
    data = np.frombuffer(("".join(rng.choice("ab") for _ in range(600)) + "a" * 300).encode(), np.uint8)
    starts = np.array(rng.sample(range(650), 400))
    group = np.sort(np.array([rng.randrange(6) for _ in starts]))
    order = S.suffix_sort(S.Extensions(data, 60), starts, group)
    raw = data.tobytes() + bytes(61)
    for g in range(6):
        keys = [raw[s : s + 60] for s in starts[order][group == g].tolist()]
        assert keys == sorted(keys)
    assert sorted(order.tolist()) == list(range(400))


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(5)
    shared = rng.integers(97, 101, 700).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 101, n).astype(np.uint8), shared]) for n in (333, 78))
    data, off = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    row, h, place, lo, hi = S.anchors(data, off)
    at = {}
    for r, p, s, e in zip(row, place, lo, hi):
        for k in range(s, e + 1):
            at[r, k - off[r]] = p - k
    for k in range(501):
        assert at[0, 333 + k] == at[1, 78 + k]
    assert len(at) == len(a) + len(b) - 2 * 199
