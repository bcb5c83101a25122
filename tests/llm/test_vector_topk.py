import numpy as np

from talkmill.llm import vector_topk as t
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"


def test_equals_oracle(spark):
    same(t.topk(spark.read.parquet(f"{SF}/embeddings.parquet")), t.oracle(), SF)


def test_bounds_hold_and_search_is_exact():
    rng = np.random.default_rng(2)
    for spread, bits in ((3, 6), (5000, 4), (40, 2)):
        v = np.floor(rng.normal(size=(500, 9)) * spread)
        ids = rng.permutation(500)
        q, q_ids = v[:30], ids[:30]
        file = t.VAFile.of(v, bits)
        centre, off = file.bounds(q)
        assert (np.abs(centre - q @ v.T) <= off[:, None]).all()
        best = [t._empty() for _ in q]
        for part in (slice(0, 200), slice(200, 500)):
            t.search(t.VAFile.of(v[part], bits), ids[part], q, q_ids, 7, best, step=3)
        for i in range(len(q)):
            want = sorted((-int(s), int(o)) for s, o in zip(v @ q[i], ids) if o != q_ids[i])[:7]
            assert [(-int(s), int(o)) for s, o in zip(*best[i])] == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (3, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (4, None, 1), (5, [1.0, None], 1), (6, [inf, 1.0], 1),
        (7, [nan, 1.0], 1), (None, [1.0, 1.0], 1), (8, [1.0, 2.0, 3.0], 1), (40, [], 1), (9, [1e307, 1.0], 1), (10, [-1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, t.topk(df, query_block=1).collect()))
    hi, lo = 64 * 64 + 128 * 128, -64 * 64
    assert got == [(0, 1, 3, hi), (0, 2, 3, hi), (0, 3, 20, hi), (0, 4, 10, lo), (20, 1, 0, hi), (20, 2, 3, hi), (20, 3, 3, hi), (20, 4, 10, lo)]
    assert t.topk(df.limit(0)).count() == 0


def test_scores_beyond_doubles_are_exact():
    q, rows = np.array([2.0**30, 1.0]), np.array([[2.0**30, 1.0], [2.0**30, 0.0]])
    assert t.exact(q, rows).tolist() == [2**60 + 1, 2**60]


def test_copies_of_a_query_push_no_neighbour_out():
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(300, 8)) * 40)
    ids = np.arange(300)
    v[:25], ids[:25] = v[0] * 3, 0  # all lead the scores
    best = [t._empty()]
    t.search(t.VAFile.of(v, 6), ids, v[:1], ids[:1], 7, best)
    want = sorted((-int(s), int(o)) for s, o in zip(v @ v[0], ids) if o != 0)[:7]
    assert [(-int(s), int(o)) for s, o in zip(*best[0])] == want


def test_large_components_take_part_and_rank_exactly(spark):
    rows = [(0, [2.0**50, 1.0]), (1, [2.0**50, 0.0]), (2, [2.0**50, 1.0]), (3, [-(2.0**50), 0.0]), (4, [1.0, 2.0]), (5, [2.0**60, 0.0])]
    got = sorted(map(tuple, t.topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    top = 2**63 - 1
    assert got == [(0, 1, 5, top), (0, 2, 2, top), (0, 3, 1, top), (0, 4, 4, 64 * 64 * 2**50 + 64 * 64 * 2), (0, 5, 3, -(2**63))]


def test_components_of_any_finite_size_against_brute_force(spark):
    import random

    rng = random.Random(7)
    big = [1.0, -2.5, 2.0**25, 1e9, -1e12, 1e30, -1e150, 1e300, 3.0**19]
    rows = [(i, [rng.choice(big) for _ in range(3)]) for i in range(90)] + [(100, [1e9, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = lambda x: int(64 * x) if abs(64 * x) >= 2**53 else int((64 * x) // 1)
    ints = {i: [whole(x) for x in v] for i, v in rows}
    want = []
    for q in ints:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:20]
            want += [(q, r, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scored, 1)]
    for block in (1, 3, 100):
        assert sorted(map(tuple, t.topk(df, query_block=block).collect())) == sorted(want)
