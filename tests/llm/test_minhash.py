import hashlib
import random
import re

import pytest

from sedimenta.llm import minhash as M


def _shingles(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def _like(a, b):
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


ROWS = [(i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(120 + i))) for i in range(40)]


def test_edited_as_brute_force(docs):
    rows = ROWS + [(50, None), (51, ""), (52, "é"), (53, "one two"), (54, "X " * 9000)]
    got = {r.doc_id: r for r in M.edited(docs(rows, "part i extra")).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for _, t in rows]
    err = []
    for k, (i, _) in enumerate(rows):
        t, u = texts[k], texts[(k + 1) % len(rows)]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b = (x.tobytes().hex() for x in M.signatures_of([t, e]))
        assert (r.fingerprint, r.edited_fingerprint) == (a, b)
        err += [abs(r.near_edited - _like(t, e)), abs(r.near_next - _like(t, u))]
    assert sum(err) / len(err) < 0.06


@pytest.mark.parametrize("rows", [[], [(1, "a b c d")], [(1, "a"), (1, "b"), (None, "c"), (1, "a")]])
def test_edited_few_rows(docs, rows):
    got = M.edited(docs(rows)).collect()
    assert len(got) == len(rows)
    if len(rows) == 1:
        assert got[0].edited_sha256 == hashlib.sha256(b"a ba b").hexdigest() or got[0].near_next == 1.0


def test_signatures_do_not_depend_on_the_buffer():
    texts = [t for _, t in ROWS] + ["", "word " * 20000, "a b"]
    one = [M.signatures_of([t])[0].tolist() for t in texts]
    assert M.signatures_of(texts).tolist() == one


def test_near_duplicates(docs):
    rows = ROWS + [(100 + i, t + " tail") for i, t in ROWS[:10]] + [(200 + i, ROWS[0][1]) for i in range(5)] + [(300, None), (301, ""), (None, "zz")]
    got = {r.doc_id: r for r in M.near_duplicates(docs(rows, "rep band head")).collect()}
    assert all(got[100 + i].class_id == got[i].class_id for i in range(10))
    assert all(got[200 + i].class_id == 0 and got[200 + i].n_links >= 5 for i in range(5))
    assert got[301].class_id == 300 and got[30].n_links == 0 and got[30].class_id == 30
    assert got[None].class_id is None and got[None].n_links == 0
    assert M.near_duplicates(docs([])).collect() == []
    with pytest.raises(TypeError):
        M.near_duplicates(docs(rows).selectExpr("cast(doc_id AS string) AS doc_id", "text"))


def test_chains_as_brute_force(docs):
    """Gradual edits: texts up to four steps apart are alike, the ends are not; all pairs that share a band count."""
    rows, k = [], 0
    for c in range(6):
        words = [f"c{c}w{k}" for k in range(200)]
        for step in range(8):
            at = step * 3
            rows.append((k, " ".join(words[at : at + 128])))
            k += 1
    random.Random(1).shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    prints = M.signatures_of([t for _, t in rows])
    shared = (prints.reshape(len(rows), M.BANDS, -1)[:, None] == prints.reshape(len(rows), M.BANDS, -1)[None]).all(axis=3).any(axis=2)
    near = {(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and shared[a, b] and _like(rows[a][1], rows[b][1]) >= M.LIKE}
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    want = {i: (root[i], sum(a == i for a, _ in near)) for i, _ in rows}
    assert {r.doc_id: (r.class_id, r.n_links) for r in M.near_duplicates(docs(rows)).collect()} == want
    # parts cut into blocks, a task a pair of these
    assert {r.doc_id: (r.class_id, r.n_links) for r in M.near_duplicates(docs(rows), part_bytes=2000).collect()} == want
    assert len(near) > 60
    like = {(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and _like(rows[a][1], rows[b][1]) >= M.LIKE}
    assert len(near) >= 0.95 * len(like)


def test_query_links_every_document(docs, folder, spark):
    rows = ROWS + [(100 + i, t + " tail") for i, t in ROWS[:10]] + [(200 + i, ROWS[0][1]) for i in range(5)] + [(300, None), (301, ""), (302, "")]
    got = {r.doc_id: r for r in M.op7_fingerprints(spark, folder(documents=docs(rows))).collect()}
    plain = {r.doc_id: (r.class_id, r.n_links) for r in M.near_duplicates(docs(rows)).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == plain and len(got) == len(rows)
    texts = {i: t or "" for i, t in rows}
    assert all(r.n_links == sum(j != i and _like(texts[i], texts[j]) >= M.LIKE for j in texts) for i, r in got.items())
