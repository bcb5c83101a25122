import random

from hypothesis import given, settings
from hypothesis import strategies as st

from talkmill.llm import decontamination as d
from talkmill.llm.common import sha256_hex
from tests.llm.oracle import same


def brute(items, words, w):
    hit, found = [0] * len(words), set()
    for item, iw in items:
        k = min(w, len(iw))
        for a in range(len(iw) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == iw[a : a + k]:
                    hit[i : i + k] = [1] * k
                    found.add(item)
    return hit, found


letters = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(letters, max_size=6), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30), st.integers(1, 5))
def test_scan_equals_brute_force(items, words, w):
    named = [(str(i), x) for i, x in enumerate(items)]
    hit, found, _ = d.SuffixAutomaton(named, w).scan(words)
    assert (list(hit), found) == brute(named, words, w)


SCHEMA = "doc_id long, text string, n_words string, n_chars long"


def test_report_on_odd_rows(spark):
    rng = random.Random(1)
    item = " ".join(rng.choice("abcdefgh") + str(i) for i in range(20))
    clean_text = " ".join(f"w{i}" for i in range(600))
    rows = [
        (1, f"x {item.upper()} y", "q", 0), (1, f"x {item.upper()} y", "q", 0), (2, None, None, None), (3, "", "", 0),
        (None, "one short", "", 0), (4, clean_text, "", 0), (5, clean_text + "! " + item + ". tail", "", 0), (6, item[:20], "", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(7, item), (8, "short"), (8, "short"), (9, None), (10, "...")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in d.digest(d.contamination(docs, items)).collect()}
    assert d.contamination(docs, items).count() == len(rows)
    r = got[1, 22]
    assert (r.n_hit, r.n_items, r.contaminated) == (20, 1, True)
    assert r.items_sha256 == sha256_hex("7")
    assert got[None, 2].n_hit == 1 and got[None, 2].items_sha256 == sha256_hex("8")
    assert got[2, 0].items_sha256 == sha256_hex("") and not got[2, 0].contaminated
    assert got[4, 600].n_hit == 0 and got[5, 621].n_hit == 20
    kept = {r.doc_id: r for r in d.clean(docs, items).collect()}
    assert set(kept) == {2, 3, 4, 5, 6} and kept[2].text is None
    assert kept[5].text == clean_text + "! . tail" and kept[5].n_chars == len(kept[5].text)
    assert kept[4].text == clean_text


def test_empty_tables_and_blocks(spark):
    docs = spark.createDataFrame([(1, "a b c d", "", 7)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(docs, none).collect()[0].n_hit == 0
    assert d.contamination(docs.limit(0), none).count() == 0
    items = spark.createDataFrame([(1, "a b"), (2, "d"), (3, "c d")], "item_id long, text string")
    assert len(list(d.automata(items, 2, block_words=2))) == 3
    r = d.contamination(docs, items, 2, block_words=2).first()
    assert (r.n_hit, r.item_ids, r.word_spans, r.longest_match) == (4, ["1", "2", "3"], [[0, 4]], 2)


def test_passes_of_many_blocks_give_what_one_does(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(6)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(60)] + [None, "", "w1 w2"]
    rows = [(i, t, "x", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "again", 1), (None, texts[5], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, Spans string, n_chars long").repartition(3)
    items = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(1, 30)] + [(None, "w1 w2 w3")], "item_id long, text string")
    one = d.contamination(docs, items, 6)
    many = d.contamination(docs, items, 6, block_words=20)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    one, many = d.clean(docs, items, 6, cover=3), d.clean(docs, items, 6, cover=3, block_words=20)
    assert one.columns == many.columns == docs.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect())) and 0 < one.count() < len(rows)


def test_equals_oracle(spark):
    sf = "/root/testdata/sf0.001"
    out = d.contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    same(d.digest(out), d.oracle(), sf)
