import random
import zlib
from collections import Counter

import numpy as np
import pytest

from talkmill.llm import class_lm as m

SF = "/root/testdata/sf0.001"


def check(rows, out, **kw):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts: Counter = Counter()
    for i, t in rows:
        if not held(i):
            counts.update((t or "").encode().lower().split())
            counts[m.END] += 1
    want = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        want.append((str(i), held(i), len(w) + 1, sum(counts[x] > 0 for x in [*w, m.END]), sum(counts.values()), round(m.base_score(counts, w), 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-5)


def test_counts_and_base_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = m.digest(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], out)
    held = [r for r in out if r.held_out]
    # the class bigrams tell more of unseen texts than single words do
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_by_the_join_and_odd_rows(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(120)]
    rows += [(None, "a b"), (500, None), (501, ""), (502, "x" * 100_000), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, score string").repartition(3)
    held = m.fold("doc_id", 5) == 1
    out = m.scored(docs, held, frequent=20, classes=6, hot=30).collect()
    check(rows, out)
    full = {(r.doc_id, r.n_tokens): r.score for r in m.scored(docs, held, frequent=20, classes=6).collect()}
    for r in out:
        assert r.score == pytest.approx(full[r.doc_id, r.n_tokens], abs=1e-6) and r.score <= 0
    assert m.digest(docs.limit(0)).count() == 0
    only_held = docs.filter(held)
    assert {r.train_tokens for r in m.digest(only_held).collect()} == {0}


def test_words_of_one_ending_get_classes_of_their_own(spark):
    rng = random.Random(5)
    # words on -ing stand either where "dog" does or where "run" does, never both; all share one bucket
    noun, verb = [f"n{i}ing" for i in range(60)], [f"v{i}ing" for i in range(60)]
    rows = []
    for i in range(600):
        rows.append((i, " ".join(w for _ in range(12) for w in ("the", rng.choice(["dog", rng.choice(noun)]), "will", rng.choice(["run", rng.choice(verb)]), "and"))))
    rows += [(9001, "the n1ing will v1ing and"), (9002, "the v1ing will n1ing and")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (m.HOT, 10):
        got = {r.doc_id: r.score for r in m.scored(docs, m.F.col("doc_id") > 9000, frequent=6, classes=8, hot=hot).filter("doc_id > 9000").collect()}
        assert got[9001] > got[9002] + 2


def brute_scores(rows, held, frequent, classes):
    """Scores as the docstring words them, told with dictionaries and loops over whole texts."""
    import math

    texts = {i: [*(t or "").encode().lower().split(), m.END] for i, t in rows}
    train = [w for i, w in texts.items() if i not in held]
    counts = Counter(x for w in train for x in w)
    top = sorted((w for w in counts if w != m.END), key=lambda w: (-counts[w], w))[:frequent]
    units = m.Units([m.END, *top])
    n = np.zeros((units.size, units.size))
    for w in train:
        for a, b in zip([m.END, *w], w):
            n[units[a], units[b]] += 1
    of = m.exchange(n, 0, classes)
    k = int(of.max()) + 1
    pairs = np.zeros((k, k))
    for a in range(units.size):
        for b in range(units.size):
            pairs[of[a], of[b]] += n[a, b]

    def step(table, a, b):
        share = (table[:, b].sum() + m.ADD) / (table.sum() + m.ADD * k)
        return math.log10((table[a, b] + k * share) / (table[a].sum() + k))

    first = lambda w: int(of[units[w]])
    cls = {w: first(w) for w in counts if w in top or w == m.END}
    for w in counts.keys() - cls.keys():
        gain = {}
        for c in range(1, k):
            if pairs[:, c].sum():
                gain[c] = 0.0
                for text in train:
                    seq = [m.END, *text]
                    for j in range(1, len(seq)):
                        if seq[j] == w:
                            gain[c] += step(pairs, first(seq[j - 1]), c) + step(pairs, c, first(seq[j + 1])) - math.log10(pairs[:, c].sum())
        best = max(gain.values())
        cls[w] = min(c for c, g in gain.items() if round(g, 6) == round(best, 6))
    table, sums, places = np.zeros((k, k)), Counter(), Counter()
    of_word = lambda w: cls.get(w, first(w))
    for w in train:
        for a, b in zip([m.END, *w], w):
            table[of_word(a), of_word(b)] += 1
    for w, c in counts.items():
        sums[cls[w]] += c
        places[cls[w]] += 1
    emit = lambda w: math.log10((counts.get(w, 0) + m.ADD) / (sums[of_word(w)] + m.ADD * (places[of_word(w)] + 1)))
    return {i: sum(step(table, of_word(a), of_word(b)) + emit(b) for a, b in zip([m.END, *w], w)) for i, w in texts.items()}


def test_scores_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"{rng.choice('abcd')}{rng.randrange(30)}" for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 61), k=rng.randrange(25)))) for i in range(60)] + [(70, "unseen word"), (71, ""), (72, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_scores(rows, {i for i, _ in rows if i % 5 == 0 or i >= 70}, 12, 6)
    for hot in (15, m.HOT):
        got = m.scored(docs, (m.F.col("doc_id") % 5 == 0) | (m.F.col("doc_id") >= 70), frequent=12, classes=6, hot=hot).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.score == pytest.approx(want[r.doc_id], abs=1e-6), r
            assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_frequent_long_words_are_hot_too(spark):
    long = "z" * 500
    rows = [(i, f"{long} a b {long}c") for i in range(30)] + [(40, long), (41, "a")]
    out = {r.doc_id: r for r in m.scored(spark.createDataFrame(rows, "doc_id long, text string"), m.F.col("doc_id") >= 40, hot=3).collect()}
    assert out[40].n_known == 2 and out[40].base_score == pytest.approx(m.base_score(Counter({b"a": 30, b"b": 30, b"l": 30, b"c": 30, m.END: 30}), [b"l"]))


def test_distributions_sum_to_one():
    rng = np.random.default_rng(1)
    assert np.allclose((10 ** m.transitions(rng.integers(0, 9, size=(7, 7)).astype(float))).sum(1), 1)
    model = m.Model(m.Units([m.END]), np.zeros(1, int), np.zeros((1, 1)), np.array([10.0]), np.array([4.0]), 10, 3, {})
    p = 10 ** model.emission(np.array([5.0, 3.0, 2.0, 0.0]), np.zeros(4, int))
    assert p.sum() == pytest.approx(1)


def likelihood(n, of):
    k = of.max() + 1
    h = np.eye(k)[of]
    c = h.T @ n @ h
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(c) - f(c.sum(0)) - f(c.sum(1))


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(6)
    truth = np.array([0, *([1] * 8), *([2] * 8), *([3] * 8)])
    step = np.array([[0, 0.8, 0.1, 0.1], [0.1, 0, 0.9, 0], [0.1, 0, 0, 0.9], [0.1, 0.9, 0, 0]])
    n = rng.poisson(step[truth][:, truth] * 60)
    of = m.exchange(n, 0, 4)
    assert of[0] == 0 and (of[1:] > 0).all()
    groups = [set(of[truth == k]) for k in (1, 2, 3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert likelihood(n.astype(float), of) == pytest.approx(likelihood(n.astype(float), truth))


def test_most_frequent_words(spark):
    rng = random.Random(3)
    rows = [(f"w{i}".encode(), rng.choice([1, 2, 3, 70, 71, 72, 73, 1000])) for i in range(300)]
    df = spark.createDataFrame([(bytearray(w), c) for w, c in rows], "word binary, c long").repartition(4)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for n in (0, 1, 40, 77, 150, 299, 300, 1000):
        got = m.most_frequent(df, n)
        assert list(zip(got["word"].to_pylist(), got["c"].to_pylist())) == want[:n]
    assert m.most_frequent(df.limit(0), 5).num_rows == 0
