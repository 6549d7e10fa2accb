import random
import re

import numpy as np
import pytest
import xxhash

from sedimenta.llm import simhash as S


def _fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _brute(rows):
    fps = [_fp(t) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = [[j for j in range(n) if j != i and bin(fps[i] ^ fps[j]).count("1") <= 2] for i in range(n)]
    for i in range(n):
        for j in near[i]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    ids = [min((rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None), default=None) for i in range(n)]
    return sorted(repr((rows[i][0], fps[i], len(near[i]), ids[i])) for i in range(n))


def _rows(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("alpha beta gamma delta Ünï côde x y".split()) for _ in range(rng.choice([1, 2, 3, 60, 200]))) for _ in range(25)]
    rows = []
    for i in range(120):
        w = rng.choice(base).split()
        if rng.random() < 0.5 and len(w) > 20:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, "\t".join(w) if i % 7 == 0 else " ".join(w)))
    return rows + [(200, None), (201, ""), (202, " \n"), (None, rows[0][1]), (None, "lonely text here"), (5, rows[5][1]), (203, "Word " * 3000)]


@pytest.mark.parametrize("block", [S.BLOCK, 1])
def test_linked_as_brute_force(docs, block):
    rows = _rows(block)
    got = S.linked(docs(rows, "fp n rep root"), block=block).collect()
    assert sorted(repr((r.doc_id, r.fp & (2**64 - 1), r.n_near, r.component_id)) for r in got) == _brute(rows)


def test_no_rows(docs):
    assert S.linked(docs([])).collect() == [] and S.keep_one(docs([])).collect() == []


def test_keep_one(docs):
    rows = [(3, "a b c d"), (1, "a b c d"), (2, "z " * 50), (None, "a b c d"), (2, "z " * 50), (9, None), (8, "")]
    d = docs(rows, "component_id fp")
    got = S.keep_one(d)
    assert got.columns == d.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "8", "None"]


def test_bit_sliced_comparison():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, np.uint64)
    f = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), base ^ np.uint64(7)])
    group = np.sort(rng.integers(0, 5, len(f)))
    for radius in (0, 1, 2, 3, 5):
        i, j = S.near_lanes(f, group, list(range(64)), radius)
        want = {(a, b) for a in range(len(f)) for b in range(a + 1, len(f)) if group[a] == group[b] and bin(int(f[a] ^ f[b])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 3)]
    got = {r.u: r.v for r in S.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {i: i // 20 * 20 for i in range(60) if i % 20} | {100: 0}


def test_components_in_one_task_and_by_rounds(spark):
    import random

    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root if find(x) != x}
    df = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    names = spark.createDataFrame([(f"{a:05d}", f"{b:05d}") for a, b in pairs], "a string, b string").repartition(7)
    for few in (10**6, 0):
        assert {tuple(r) for r in S.components(df, few=few).collect()} == want
        assert {tuple(r) for r in S.components(names, kind="string", few=few).collect()} == {(f"{a:05d}", f"{b:05d}") for a, b in want}
    assert S.components(df.limit(0)).collect() == []
