"""Queries over whole texts, against brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from talkmill.functions import text as tx
from talkmill.operators import conversations
from talkmill.plans import registry
from tests.oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def long_docs(spark, tmp_path):
    texts = ["e" * 4095 + "\u00e9 cut by the sample", "a" * 4096 + "\x00", "b" * 4095 + "\x00", "c" * 9000, "", "short", "d" * 300 + "[name] ````` \r\n [a b][name]", " \n```x```\n" + "f" * 60]
    texts = [t + f"{pad}" for pad in ("", "``` [x] \r\n") for t in texts for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), {i: t for i, t, *_ in rows}


def got(spark, name, sf):
    rows = [tuple(r) for r in registry.QUERIES[name](spark, sf).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def textual(head):
    try:
        head.decode()
    except UnicodeDecodeError:
        return False
    return not re.search(rb"[\x00-\x08\x0B\x0E-\x1F]", head)


def test_text_sniff_covers_long_bodies(spark, long_docs):
    sf, texts = long_docs
    body = lambda i, t: ["", t + "\x0b", "\x08" + t, t, t][i % 5]
    assert got(spark, "f8_text_sniff", sf) == {i: textual(body(i, t).encode()[:4096]) for i, t in texts.items()}


def test_documents_are_read_to_their_ends(spark, long_docs):
    sf, texts = long_docs
    ticks = {i: f"{t}{'`' * (i % 6)}\r\nx``y" for i, t in texts.items()}
    fence = lambda t: "`" * max(3, 1 + max(map(len, re.findall("`+", t))))
    assert got(spark, "x16_fence", sf) == {i: fence(t) for i, t in ticks.items()}
    unix = {i: t.replace("\r\n", "\n") for i, t in ticks.items()}
    assert got(spark, "x17_unix_newlines", sf) == unix
    fenced = lambda t: f"{fence(t)}python\n{t}\n{fence(t)}"
    assert got(spark, "s14_text_ingestion", sf) == {i: fenced(t) if i % 6 == 3 else t for i, t in unix.items()}
    brackets = {i: f"{t}[name]{i} [a b] [] [name]" for i, t in texts.items()}
    assert got(spark, "x33_placeholders", sf) == {i: "|".join(re.findall(r"\[[^\]]+\]", t)) for i, t in brackets.items()}
    filled = {i: t.replace("[name]", "Ann").replace("[a b]", "c") for i, t in brackets.items()}
    assert got(spark, "x20_filled_placeholders", sf) == filled

    def block(i, t):
        t = t if i % 2 else f"Sure:\n```python\n{t}\n```\nand ```x```"
        m = re.search(r"(?s)```(?:python)?[ \t\n\x0b\f\r]*\n(.*?)```", t)
        return (m[1] if m else t).strip(" \t\n\x0b\f\r")

    assert got(spark, "x11_code_block", sf) == {i: block(i, t) for i, t in texts.items()}


@pytest.mark.parametrize("name", ["f8_text_sniff", "x16_fence", "x17_unix_newlines", "s14_text_ingestion", "x33_placeholders", "x20_filled_placeholders", "x11_code_block", "x10_renamed"])
def test_long_documents_equal_the_oracle(spark, long_docs, name):
    sf, _ = long_docs
    same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)


def test_code_blocks_of_odd_fences(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["`", "```", "````", "python", "\n", " ", "x", "py"]) for _ in range(rng.randrange(14))) for _ in range(600)]

    def block(t):
        m = re.search(r"(?s)```(?:python)?[ \t\n\x0b\f\r]*\n(.*?)```", t)
        return (m[1] if m else t).strip(" \t\n\x0b\f\r")

    df = spark.createDataFrame([(t,) for t in texts], ["t"])
    for r in df.select("t", tx.code_block(F.col("t")).alias("c")).collect():
        assert r.c == block(r.t), r.t


def test_search_grows_with_the_places_not_with_their_square(spark):
    def places(n):
        text = "é ab " * n
        df = spark.createDataFrame([("c", 0, text)], "chat_id string, message_id long, content string")
        began = time.perf_counter()
        rows = conversations.search(df, "AB").collect()
        assert [r["at"] for r in rows] == list(range(2, 5 * n, 5))
        assert rows[n // 2].excerpt == "..." + text[rows[n // 2]["at"] - 30 : rows[n // 2]["at"] + 32] + "..."
        return time.perf_counter() - began

    places(2000)
    assert places(60_000) < 6 * max(places(20_000), 0.3)


def test_causes_are_followed_to_any_depth(spark):
    deep = '{"message": "m", "cause": ' * 40 + '{"message": "inner"}' + "}" * 40
    texts = [deep, '{"message": "o", "cause": {"message": ""}}', '{"message": "o", "cause": {}}', '{"cause": null, "message": "say \\"cause\\""}', "{}", "no json", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.innermost_message(F.col("t"))).collect()] == ["inner", "o", "o", 'say "cause"', None, None, None]
