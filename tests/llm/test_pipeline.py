import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from sedimenta.llm import mixing, pieces, simhash, toxicity


def _tables(spark, docs):
    rng = random.Random(5)
    words = [a + b for a in "ba de ki lo mu na po ra si tu".split() for b in "s t n r l k".split()]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randrange(40, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), "vilefoo")
        rows.append((i, " ".join(w) + "\nfooter of the site", f"s{i % 3}"))
        labels.append((i, 1, toxic))
    rows += [(2000 + i, rows[1][1], "s1") for i in range(9)] + [(3000, None, None), (3001, "", "s0"), (None, "lonely words here", "s2"), (3002, "word " * 4000, "s0")]
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_stages(spark, docs, folder):
    d, labels = _tables(spark, docs)
    sf = folder(documents=d, labels=labels)
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    columns = rows.columns
    clean = C.drop_toxic(spark, rows, sf).persist()
    left = {r.doc_id for r in clean.collect()}
    assert len([i for i in range(0, 900, 4) if i in left]) < 5 and len([i for i in range(900) if i % 4 and i not in left]) < 5
    lined = C.drop_boilerplate(spark, clean, sf).persist()
    assert lined.columns == columns and lined.filter(F.col("text").contains("footer of")).count() == 0
    assert all(r.n_chars == len(r.text) for r in lined.collect() if r.text is not None) and lined.count() == clean.count()
    one = C.drop_near_copies(spark, lined, sf).persist()
    assert one.columns == columns
    want = {r.component_id for r in simhash.linked(lined).collect()}
    assert {r.doc_id for r in one.collect()} == want | {None}
    mixed = C.mix_sources(spark, one, sf).persist()
    assert mixed.columns == columns
    taken = Counter({r.doc_id: r.repeats for r in mixing.mix(one).collect() if r.repeats})
    assert Counter(r.doc_id for r in mixed.collect()) == taken
    last = C.to_pieces(spark, mixed, sf)
    assert last.columns == [*columns, "ids", "n_tokens"]
    back = pieces.decode(last, pieces.model_path(), text="back").collect()
    assert len(back) == mixed.count() and all(r.back == r.text for r in back)
    run = C.run(spark, sf)
    assert Counter(map(repr, run.collect())) == Counter(map(repr, last.collect()))


def test_toxicity_by_a_model_beyond_what_is_broadcast(spark, docs, folder, monkeypatch):
    """The stage keeps the same rows if the model is more than may be broadcast."""
    d, labels = _tables(spark, docs)
    d = d.unionAll(docs([(None, None, None), (None, None, None), (1, "vilefoo " * 9, "s1"), (4000, "vilefoo " * 9, None)]))
    for c in ("_score", "_digest", "_evidence", "_weighed"):
        d = d.withColumn(c, F.lit("clash"))
    sf = folder(documents=d, labels=labels)
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    want = Counter(map(repr, C.drop_toxic(spark, rows, sf).collect()))
    assert sum(want.values()) < rows.count() - 200
    sizes, ratios = [], toxicity.ratios
    monkeypatch.setattr(toxicity, "MOST", 3)
    monkeypatch.setattr(toxicity, "ratios", lambda *a, **k: sizes.append((out := ratios(*a, **k)).count()) or out)
    clean = C.drop_toxic(spark, rows, sf)
    assert clean.columns == rows.columns and Counter(map(repr, clean.collect())) == want
    assert sizes[0] > 3  # the whole model


def test_no_rows(spark, docs, folder):
    sf = folder(documents=docs([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert C.run(spark, sf).collect() == []
    assert toxicity.scored(docs([]), toxicity.labels_of(spark, sf)).count() == 0


def test_odd_rows_and_clashing_columns(spark, docs, folder):
    """Nulls in any column, ties, rows repeated whole, and columns named as what operators add."""
    d, labels = _tables(spark, docs)
    d = d.unionAll(docs([(None, None, None), (None, None, None), (7, "another text of id seven", "s1"), (4000, "x " * 50_000, None)]))
    for c in ("score", "predicted", "n_lines", "n_dropped", "component_id", "fp", "size", "repeats", "target", "ids", "n_tokens", "_lost"):
        d = d.withColumn(c, F.lit("clash"))
    sf = folder(documents=d, labels=labels)
    got = C.run(spark, sf)
    rows = got.collect()
    assert got.columns == d.columns and {r.score for r in rows} == {"clash"} == {r.component_id for r in rows}
    assert all((r.ids is None) == (r.text is None) and r.n_tokens == (None if r.ids is None else len(r.ids)) for r in rows)
    assert not any(r.text and "vilefoo" in r.text and r.doc_id is not None for r in rows)
    again = Counter(map(repr, C.run(spark, sf).collect()))
    assert again == Counter(map(repr, rows))
