import ast
import random

import pytest
from pyspark.sql import functions as F

from talkmill.functions import text as tx
from talkmill.operators import conversations, files


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(c.alias("x")).first().x


def places(text, q):
    out, at = [], text.lower().find(q.lower())
    while at >= 0:
        out.append(at)
        at = text.lower().find(q.lower(), at + 1)
    return out


@pytest.mark.parametrize("q", ["aa", "a", "éé", "b\\E", ".", "ab ", "$"])
def test_occurrences_overlap_and_are_literal(spark, q):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbé\\E. $\n") for _ in range(rng.randrange(60))) for _ in range(150)] + ["", "aaa", q]
    df = spark.createDataFrame([(t,) for t in texts], ["t"])
    for r in df.select("t", tx.occurrences(F.col("t"), q).alias("x")).collect():
        assert r.x == places(r.t, q)


def test_search_excerpts(spark):
    text = "x" * 35 + "AAA" + "y" * 35
    m = spark.createDataFrame([("c", 0, text), ("c", 1, "aa"), ("d", 0, None), ("d", 1, "")], "chat_id string, message_id long, content string")
    got = sorted(tuple(r)[1:] for r in conversations.search(m, "aa").collect())
    assert got == [(0, 35, "..." + "x" * 30 + "AA" + "A" + "y" * 29 + "..."), (0, 36, "..." + "x" * 29 + "AAA" + "y" * 30 + "..."), (1, 0, "aa")]
    assert conversations.search(m, "").count() == 0


def test_names_and_flattening(spark):
    rows = [("a", 0, "", "answer", None), ("a", 1, "later", "x", None), ("b", 0, "q" * 32, "", None), ("c", 0, "q" * 33, "", 5)]
    r = spark.createDataFrame(rows, "chat_id string, response_idx long, query string, content string, task_id int")
    assert {x.chat_id: x.name for x in conversations.chat_names(r).collect()} == {"a": "answer", "b": "q" * 32, "c": "q" * 32 + "…"}
    m = conversations.flatten_messages(r)
    assert sorted((x.message_id, x.role, x.content) for x in m.filter("chat_id = 'a'").collect()) == [(0, "user", ""), (1, "assistant", "answer"), (2, "user", "later"), (3, "assistant", "x")]


def test_listing_is_stable(spark):
    c = spark.createDataFrame([("s", "x", "n", 2, 5), ("s", "y", "n", 0, 5), ("s", "z", "n", 1, 9)], "session_id string, chat_id string, name string, pos int, time_modified int")
    assert [r.chat_id for r in conversations.list_chats(c).orderBy("rank").collect()] == ["z", "y", "x"]


@pytest.mark.parametrize(("url", "kind", "want"), [
    ("http://h/a/b.tar.gz?x=/y.z#q", "image/jpg", "b.tar.jpg"), ("http://h/a/", "application/pdf; x", "file.pdf"), ("http://h", None, "file.bin"),
    ("https://h/.htaccess", "IMAGE/PNG", ".png"), ("http://h/n", "text/x", "n.bin"),
])
def test_file_names(spark, url, kind, want):
    df = spark.createDataFrame([(url, kind)], "u string, k string")
    assert df.select(tx.file_name(F.col("u"), F.col("k"))).first()[0] == want


@pytest.mark.parametrize(("url", "want"), [("http://a.b.c/x", "a-b-c"), ("http://a//b.d/x", "b-d"), ("no.host", "no-host"), ("x//", "x//")])
def test_server_labels(spark, url, want):
    assert one(spark, tx.server_label(F.col("u")), u=url) == want


@pytest.mark.parametrize(("body", "want"), [
    (b"", True), (b"a\tb\n\x0c\r", True), (b"a\0", False), (b"\xff\xfe", False), (b"\x0b", False), ("é".encode() * 3, True), (b"a" * 4095 + "é".encode(), False),
    (b"a" * 4096 + b"\0", True),
])
def test_text_or_binary(spark, body, want):
    df = spark.createDataFrame([(bytearray(body),)], "b binary")
    assert df.select(tx.looks_textual(F.col("b"))).first()[0] is want


def test_code_blocks_and_replies(spark):
    assert one(spark, tx.code_block(F.col("t")), t="x ```python\n a = 1\n``` y ```\nb\n```") == "a = 1"
    assert one(spark, tx.code_block(F.col("t")), t="  plain \n") == "plain"
    reply = '```json\n{"agentId": "a", "action": "go", "params": {"x": 1}}\n```'
    assert tuple(one(spark, tx.reply_action(F.col("t")), t=reply)) == ("a", "go", '{"x":1}')
    assert one(spark, tx.reply_action(F.col("t")), t='{"agentId": "a"}') is None and one(spark, tx.reply_action(F.col("t")), t="hello") is None
    assert one(spark, tx.braced(F.col("t")), t="a {\n{1} } b") == "{\n{1} }" and one(spark, tx.braced(F.col("t")), t="}{") is None


def test_fences_and_ingestion(spark):
    assert one(spark, tx.fence(F.col("t")), t="a ```` b `") == "`````" and one(spark, tx.fence(F.col("t")), t="") == "```"
    assert one(spark, tx.ingested(F.col("n"), F.col("t")), n="x.PY", t="a\r\n```") == "````python\na\n```\n````"
    assert one(spark, tx.ingested(F.col("n"), F.col("t")), n="x.md", t="a\r\nb") == "a\nb"


def test_logged_calls(spark):
    text = "Tool: 3\nAgent: A\nAction: go\nArguments:\n- x: 1\n- y: 2\n\nResult: " + "long  text " * 5
    assert one(spark, tx.logged_call(F.col("t")), t=text) == "3. A: go( x: 1\n- y: 2) → " + ("long text " * 5)[:30] + " [...]"
    assert one(spark, tx.logged_call(F.col("t")), t="other") is None


def test_placeholders_numbers_cookies_errors(spark):
    assert one(spark, tx.placeholders(F.col("t")), t="[a] [] [b c] [a]") == ["[a]", "[b c]", "[a]"]
    values = F.create_map(F.lit("[a]"), F.lit("1"), F.lit("[b]"), F.lit("[a]"))
    assert one(spark, tx.filled(F.col("t"), values), t="[a] [b] [a] [c]") == "1 1 [a] [c]"
    args = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, tx.numbered(F.col("t"), args), t="%1-%2 %3 %12 100% %0 %2") == "x-y %3 %12 100% %0 y"
    assert one(spark, tx.cookies(F.col("t")), t="a=1; b=x=y; c; a=2") == {"a": "2", "b": "x=y"}
    assert one(spark, tx.innermost_message(F.col("t")), t='{"message": "o", "cause": {"message": "m", "cause": {"message": "i"}}}') == "i"
    assert one(spark, tx.setting_name(F.col("t")), t="apiKeyName2Go") == "VITE_API_KEY_NAME2_GO"
    assert one(spark, tx.pretty_json(F.col("t")), t='{"a":1}').startswith("{\n") and one(spark, tx.pretty_json(F.col("t")), t="[oops") == "[oops"


def test_previews(spark):
    assert one(spark, tx.preview(F.col("t")), t="\n a \r\n\n b\nc\nd") == "a\nb\nc"
    long = one(spark, tx.preview(F.col("t")), t="x" * 300)
    assert len(long) == 240 and long.endswith("...")


def test_last_expressions(spark):
    df = spark.createDataFrame([("a = 1\na + 1",), ("a = 1",), ("def",), (None,), ("",)], "c string")
    got = [r[0] for r in df.select(files.returning(F.col("c"))).collect()]
    assert got == ["a = 1\n_result = a + 1", "a = 1", "def", None, ""]


def test_programs_are_dealt_out_before_they_are_rewritten(spark, tmp_path):
    """One file of programs is rewritten in several tasks, and programs of one key or none stay rows of their own."""
    rows = [(k, f"a = {k}\na  +  1  # so") for k in range(400)] + [(7, "b"), (None, "c"), (None, None)]
    spark.createDataFrame(rows, "k long, code string").coalesce(1).write.parquet(str(tmp_path / "programs"))
    few, width = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = {c: spark.conf.get(c) for c in (few, width)}
    try:
        spark.conf.set(few, "false")
        spark.conf.set(width, "4")
        df = files.returned(spark.read.parquet(str(tmp_path / "programs")), "k")
        got = [(r.k, r.code) for r in df.collect()]
        assert len({r[0] for r in df.select(F.spark_partition_id()).collect()}) == 4
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want = [(k, f"a = {k}\n_result = a + 1") for k in range(400)] + [(7, "_result = b"), (None, "_result = c"), (None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_rewritten_programs_keep_their_other_statements():
    long = "class A:\n    'd'\n    def f(self, x: int=1, *a, **k) -> int:\n        return f'{x!r:>{k}}' + 'q'\nfor i in b:\n    pass\nelse:\n    y = -1\n(yield_ := [*c, {**d}])"
    tree = ast.parse(long)
    tree.body[-1] = ast.fix_missing_locations(ast.copy_location(ast.Assign([ast.Name("_result", ast.Store())], tree.body[-1].value), tree.body[-1]))
    assert files.code_that_returns(long) == ast.unparse(tree)
    assert files.code_that_returns("'text'") == "_result = 'text'" and files.code_that_returns("a; b # c") == "a\n_result = b"


def test_first_uploads_and_parts(spark, tmp_path):
    u = spark.createDataFrame([("s", 2, "a", "new"), ("s", 1, "a", "old"), ("t", 3, "a", "x")], "session_id string, seq long, file_name string, body string")
    assert {(r.session_id, r.body) for r in files.first_uploads(u).collect()} == {("s", "old"), ("t", "x")}
    f = spark.createDataFrame([("1", "a.PDF", {"h": "x"}), ("2", "b.jpeg", {}), ("3", None, {}), ("4", "c.txt", {}), ("5", "d.png", {"h": "y"})], "file_id string, file_name string, host_ids map<string,string>")
    active = f.select("file_id")
    assert [r.file_id for r in files.unsent(f, active, "h").collect()] == ["2"]
    assert {tuple(r) for r in files.message_parts(f, active, "h").collect()} == {("1", "input_file", "x"), ("5", "input_image", "y")}
    files.write_files(u.select("session_id", F.col("seq").alias("file_id"), "body"), str(tmp_path / "f"))
    assert files.drop_session(spark, str(tmp_path / "f"), "s") and spark.read.parquet(str(tmp_path / "f")).count() == 1
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.bin").write_bytes(b"xyz")
    assert files.read_uploads(spark, str(tmp_path / "up")).select("content").first()[0] == b"xyz"
