import random

import numpy as np

from talkmill.llm import near_dedup as n
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"


def test_equals_oracle(spark):
    same(n.digest(n.groups(spark.read.parquet(f"{SF}/documents.parquet"))), n.oracle(), SF)


def words_set(text, k):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k=4):
    sets = [words_set(t or "", k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return [(d, len(s), ids.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def family(rng, size, spread, length):
    """Texts that drift away from one another, so that links are chains and buckets hold strangers."""
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(length)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(spread)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(11)
    texts = family(rng, 120, 14, 150) + family(rng, 60, 3, 8) + family(rng, 50, 40, 400) + ["a b c", "A  b\tc", "x", "", None, "  \n"] + ["same copy of one text here"] * 40
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [(None, texts[0]), (None, "alone among nulls and nothing else"), (ids[3], texts[3])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in n.groups(docs).collect())
    assert got == sorted((str(d), k, str(c)) for d, k, c in brute(rows))


def joined_rows(df):
    """Rows that the joins on buckets made as the table was read."""
    out, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if "Join" in name and "bucket" in plan.simpleString(100):
            out += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
        if name == "AdaptiveSparkPlan" or name.endswith("QueryStage"):
            plans.append(plan.plan() if name.endswith("QueryStage") else plan.executedPlan())
    return out


def test_a_pair_of_near_copies_is_made_once_and_not_in_each_bucket(spark, monkeypatch):
    linked, made, pairs = n._linked, [], []

    def count(spark, edges, bodies, size, threshold, folder):
        if "round-" in folder:
            pairs.extend((r.a, r.b) for r in edges.collect())
            made.append(joined_rows(edges))
        return linked(spark, edges, bodies, size, threshold, folder)

    monkeypatch.setattr(n, "_linked", count)
    texts = family(random.Random(3), 150, 12, 150) + family(random.Random(4), 150, 9, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in n.groups(docs).collect())
    assert got == brute(list(enumerate(texts)))
    assert len(pairs) > 50 and sum(made) == len(pairs) == len(set(pairs))


def test_keep_one(spark):
    rows = [(1, "a b c d e f g", 5), (2, "a b c d e f g", 6), (3, "other words stand in this one", 1), (4, "", 2), (5, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    assert sorted(map(tuple, n.keep_one(docs).collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "no id at all but words", 1)] * 2, docs.schema))
    got = [tuple(r) for r in n.keep_one(twice).collect()]
    assert sorted(x[0] for x in got if x[0] is not None) == [1, 3, 4, 4, 5, 5] and sum(x[0] is None for x in got) == 1
    assert n.keep_one(docs.limit(0)).count() == 0


def test_groups_that_share_an_id_or_have_none_keep_a_row_each(spark):
    a, b, c = ("first text of seven words stands here", "a second one that shares no such run", "the third is again of other words")
    schema = "doc_id long, text string"
    nulls = [(None, a), (None, b), (None, b), (None, c), (4, c)]
    assert sorted(map(str, map(tuple, n.keep_one(spark.createDataFrame(nulls, schema)).collect()))) == sorted(map(str, [(None, a), (None, b), (4, c)]))
    # 7 names two unlinked texts; 8 leads one group and only follows 1 in another
    rows = [(7, a), (7, b), (8, c), (8, "one more text that comes under two ids"), (1, "one more text that comes under two ids")]
    assert sorted(map(tuple, n.keep_one(spark.createDataFrame(rows, schema)).collect())) == sorted([*rows[:3], rows[4]])


def test_densified_bins_match_as_often_as_sets_are_similar():
    signer = n.Signer()
    rng = np.random.default_rng(1)
    for size in (5, 30, 1000):
        rate = []
        for _ in range(60):
            h = np.unique(rng.integers(0, 2**64, size=size * 6 // 5, dtype=np.uint64))
            rate.append((signer.bins_of(h) == signer.bins_of(np.sort(h[rng.permutation(len(h))[:size]]))).mean())
        assert abs(np.mean(rate) - 5 / 6) < 0.03


def test_sketches_let_similar_pairs_through():
    signer = n.Signer(n.SKETCH, 1)
    rng = np.random.default_rng(5)
    for size in (9, 40, 400, 3000):
        passed = strangers = 0
        for k in range(80):
            h = np.unique(rng.integers(0, 2**64, size=size, dtype=np.uint64))
            for share, similar in ((1 / 9, True), (0.4, False)):  # similarity 0.8 and 3/7
                other = h.copy()
                other[rng.permutation(len(h))[: int(len(h) * share)]] = rng.integers(0, 2**64, size=int(len(h) * share), dtype=np.uint64)
                agree = n.SKETCH - int(np.unpackbits((signer.sketch(h) ^ signer.sketch(np.unique(other))).view(np.uint8)).sum())
                ok = agree >= n.SKETCH * (0.9 - n.SIGMAS * (0.09 / min(n.SKETCH, len(h))) ** 0.5)
                passed += ok and similar
                strangers += ok and not similar
        assert passed == 80 and (size < 400 or strangers == 0)
