import random

import numpy as np
import pytest

from talkmill.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = q.digest(docs, labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count()
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    right = sum(r.predicted == y for r, y in held)
    assert right >= 0.93 * len(held), (right, len(held))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_odd_rows(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choices(["the", "tree", "stands", "by", "a", "river."], k=60)) for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(["buy", "now", "cheap"], k=60)) for _ in range(80)]
    rows = [(i, t, 1) for i, t in enumerate(good + bad)] + [(900, None, 1), (901, "", 1), (None, good[0], 1), (902, "a " * 100_000, 1), (1, good[1], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score int")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(3, None, 0), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = q.digest(docs, labels).collect()
    assert len(got) == len(rows)
    assert np.mean([r.predicted == (r.doc_id < 80) for r in got if r.doc_id is not None and r.doc_id < 160]) > 0.97
    kept = q.keep_good(docs, labels)
    clashing = docs.withColumnRenamed("quality_score", "Quality_Score").withColumnRenamed("text", "Text")
    assert q.keep_good(clashing, labels).columns == clashing.columns
    assert kept.columns == docs.columns and 70 <= kept.filter("doc_id < 160").count() <= 90
    with pytest.raises(ValueError):
        q.scored(docs, labels)
    assert {r.score for r in q.digest(docs, labels.limit(0)).collect()} == {0.5}
    assert q.digest(docs.limit(0), labels).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2 * q.DIM + 2))
    truth = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(3000) < truth).astype(float)
    net = q.train(x[:2000], y[:2000], epochs=8)
    p = net.probability(x[2000:])
    high = p > 0.8
    assert abs(y[2000:][high].mean() - p[high].mean()) < 0.1


def test_units():
    assert q.parts(b"It's-2024!!") == (b"its2024", b"Xx'x-9!") and q.parts("Été".encode())[1] == b"x"
    u = q.Units([b"the", b"tree"], [b"x"])
    hashes, words, shapes = u.of(b"the The oak oak tree")
    assert words.tolist() == [1, 1, 0, 0, 2] and shapes.tolist() == [u.first + 2, u.first, u.first + 2, u.repeat, u.first + 2]
    assert hashes[0] == hashes[1] and hashes[2] == hashes[3] != hashes[0]


def test_context_vectors_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["the", "Tree", "oak", "rare1", "rare2", "RIVER!"], k=rng.randrange(9))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = ([b"the", b"tree", b"river"], [b"x", b"X!"])
    u = q.Units(*words)
    want = np.zeros((u.rows, q.DIM))
    for t in texts:
        hashes, ws, shapes = u.of((t or "").encode())
        seq = [x for h, w, s in zip(hashes, ws, shapes) for x in ((w, int(h) & (2**q._CODE - 1)), (s, int(u.codes[s])))]
        for i, (row, _) in enumerate(seq):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if row and 0 <= j < len(seq):
                    for where, sign in q.places(np.array([seq[j][1]])):
                        want[row, where[0]] += sign[0]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.allclose(q.word_vectors(docs, words), want, atol=1e-6)


def test_scores_against_brute_force(spark):
    """The registered query's scores, worked out again text by text with the same vocabulary and network."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = q.taught(docs, labels, q.fold("doc_id", 4) == 2)
    words = q.vocabulary(rows)
    vectors = q.word_vectors(docs, words)
    net = q.fit(rows, spark.sparkContext.broadcast((words, vectors)))
    units = q.Units(*words)
    got = {r.doc_id: r for r in q.digest(docs, labels).collect()}
    for r in docs.collect():
        x = q.pooled((r.text or "").encode(), units, vectors).astype(float)
        h = np.tanh(((x - net.mean) / net.scale) @ net.w1 + net.b1)
        z = float(np.clip((h @ net.w2 + net.b2) / net.temperature, -30, 30))
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-9 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
