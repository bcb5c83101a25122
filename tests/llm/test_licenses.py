import pytest

from talkmill.llm import licenses as L
from tests.llm.oracle import same

SF = "/root/testdata/sf0.001"


def test_equals_oracle(spark):
    same(L.scan(spark.read.parquet(f"{SF}/documents.parquet")), L.oracle(), SF)


def test_filters_lose_nothing_against_brute_force(spark, tmp_path):
    import random

    rng = random.Random(3)
    pool = sorted({w for _, t in L.TEMPLATES for w in L.words_of(t)}) + ["zz", "yy"]
    rows = []
    for i in range(120):
        _, t = rng.choice(L.TEMPLATES)
        ws = [w if rng.random() > 0.12 else rng.choice(pool) for w in L.words_of(t)]
        rows.append((i, " ".join([*rng.choices(pool, k=rng.randrange(40)), *ws, *rng.choices(["zz", "q"], k=rng.randrange(60))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = L.scan(docs)
    same(out, L.oracle(), str(tmp_path))
    assert out.filter("containment > 0 and containment < 1").count() > 5


def test_odd_rows(spark):
    rows = [
        (1, None, "a"), (2, "", None), (3, "Released under the MIT  License.\n cc-BY cc by", "x"), (3, "Released under the MIT  License.\n cc-BY cc by", "x"),
        (None, "the mit licenses, xmit license", "x"), (5, "mit license " * 3000, "x"), (6, "...", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    assert L.scan(docs).count() == len(rows)
    assert tuple(got[3])[1:6] == (9, 3, 3, 7, "cc-by,mit") and got[3].score == 1.0
    assert got[1].n_words == got[2].n_words == got[6].n_words == 0 and got[1].first_word is None and got[1].labels == ""
    assert got[None].n_base == 0 and got[None].base_labels == ""
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (3000, 0, 5998)
    assert L.scan(docs.limit(0)).count() == 0


def test_template_bound(spark):
    with pytest.raises(ValueError):
        L.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), templates=())
