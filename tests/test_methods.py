import dataclasses

import pytest

from talkmill.operators import code, methods
from talkmill.operators.registry import tools
from talkmill.plans import registry


def test_another_method_is_plugged_in(spark):
    @dataclasses.dataclass
    class Own:
        model: str = "m0"
        max_rounds: int = 2
        check: bool = False

    ms = methods.Methods()
    ms.add(methods.Method("own", Own, (("first", "model", None), ("second", "model", "check"))))
    with pytest.raises(ValueError):
        ms.add(ms["own"])
    q = spark.createDataFrame([("s", "own", "hello"), ("t", "own", "hello"), ("u", "other", "hello")], "session_id string, method string, query string")
    c = spark.createDataFrame([("t", "own", "check", "true"), ("t", "own", "model", "m1"), ("s", "own", "model", None), ("s", "other", "model", "x"), ("t", "own", "unknown", "y")], "session_id string, method string, key string, value string")
    got = sorted(map(tuple, ms.requests(q, c).collect()))
    assert got == [("s", "own", 0, "first", "m0", 2), ("t", "own", 0, "first", "m1", 2), ("t", "own", 1, "second", "m1", 2)]
    assert {tuple(r) for r in ms.properties(spark).collect()} == {("own", "model", "string", "m0"), ("own", "max_rounds", "integer", "2"), ("own", "check", "boolean", "false")}


def test_attempts(spark):
    a = spark.createDataFrame([("x", 1, "a", "error"), ("x", 2, None, "success"), ("x", 3, "c", "error"), ("x", 4, "d", "success"), ("y", 2, "b", "success"), ("y", 1, "a", "error"), ("y", 3, "c", "success")], "task_id string, attempt int, code string, status string")
    got = {r.task_id: (r.attempt, r.code, r.status, [tuple(p) for p in r.previous]) for r in code.solved(a).collect()}
    assert got == {"x": (3, "c", "error", [(1, "a", "error"), (2, None, "no code")]), "y": (2, "b", "success", [(1, "a", "error")])}
    assert tools.call("CodeExecution--SolveWithCode", {"attempts": a}, task="x", max_code_retries=3).first().status == "success"


def test_executions(spark):
    p = spark.createDataFrame([(1, "1 + 1"), (2, "x = 1"), (3, "y"), (4, "z")], "run_id int, code string")
    asked = code.requests(p, timeout_s=3)
    assert {(r.run_id, r.code, r.deadline_s, r.memory_mb) for r in asked.collect()} == {(1, "_result = 1 + 1", 8, 1024), (2, "x = 1", 8, 1024), (3, "_result = y", 8, 1024), (4, "_result = z", 8, 1024)}
    answers = spark.createDataFrame([(1, "success", "2", "", 7.5, 5), (2, "success", "o", "", 8.5, 5), (3, "error", "", "no y", 1.0, 2000)], "run_id int, status string, stdout string, stderr string, seconds double, used_mb int")
    got = {r.run_id: (r.status, r.stdout) for r in code.executed(asked, answers).collect()}
    assert got == {1: ("success", "2"), 2: ("timeout", None), 3: ("error", None), 4: ("timeout", None)}
    assert tools.call("CodeExecution--ExecuteCode", {"programs": p, "answers": answers}, code="1 + 1", timeout_s=3).first().stdout == "2"


def test_programs_meet_their_answers_once(spark):
    """What a request asks comes along with its outcome: two programs of one run stay two rows, as do those without a run_id."""
    p = spark.createDataFrame([(1, "1"), (1, "2"), (None, "3")], "run_id long, code string")
    answers = spark.createDataFrame([(1, "success", "o", "", 1.0, 5)], "run_id long, status string, stdout string, stderr string, seconds double, used_mb int")
    got = code.executed(code.requests(p), answers, "code")
    assert {tuple(r) for r in got.collect()} == {(1, "_result = 1", "success", "o", ""), (1, "_result = 2", "success", "o", ""), (None, "_result = 3", "timeout", None, None)}
    plan = registry.QUERIES["v2_executions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("ArrowEvalPython") == 1


def test_downloads(spark):
    rows = [("http://h/a.txt", 200, "image/png", bytearray(b"x")), ("http://h/a.txt", 503, None, None), ("http://h/", None, None, None), ("file:///etc", 200, None, bytearray(b"y"))]
    d = spark.createDataFrame(rows, "url string, status int, content_type string, body binary")
    got = sorted((r.ok, r.file_name, r.error) for r in tools.call("Files--ReadFileFromUrl", {"downloads": d}, url="http://h/a.txt").collect())
    assert got == [(False, None, "status 503"), (True, "a.png", None)]
    assert tools.call("Files--ReadFileFromUrl", {"downloads": d}, url="http://h/").first().error == "no answer"
    assert tools.call("Files--ReadFileFromUrl", {"downloads": d}, url="file:///etc").first().error == "not a web address"
