import json

import pytest
from pyspark.sql import functions as F

from talkmill.operators import catalog as c
from talkmill.operators import prompts as p


def test_policy(spark):
    t = spark.createDataFrame(
        [("remote", "Desk--Open", "Open", None), ("remote", "Desk--Shut", "Shut", "deny"), ("mcp", "BAD--Open", "Open", "ask"), ("mcp", "m--badTool", "badTool", None), ("remote", "Bad--x", "x", "allow")],
        "source string, name string, short_name string, approval string",
    )
    assert [r.name for r in c.usable(t, ["bAd"]).collect()] == ["Desk--Open", "BAD--Open"]
    got = [r[0] for r in t.select(c.effective_approval(F.col("name"), F.col("approval"), ["bad--"], ["open", "SHUT"])).collect()]
    assert got == ["ask", "deny", "deny", "allow", "deny"]
    assert [r[0] for r in t.select(c.invocation_allowed(F.col("short_name"), F.col("name"), [])).collect()] == [True] * 5


def test_openapi(spark, tmp_path):
    op = lambda oid, **k: {"operationId": oid, "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/S"}}}}, **k}
    spec = {"paths": {"/a": {"post": op("c;A;go", description="d" * 2000)}, "/b": {"post": op("c;B;go", summary="s"), "get": op("c;B")}, "/c": {"post": op("a;b;c;d")}}, "components": {"schemas": {"S": {"type": "object", "properties": {"n": {"$ref": "#/components/schemas/N"}}}, "N": {"type": "integer"}}}}
    (tmp_path / "spec.json").write_text(json.dumps(c.inline_references(spec)))
    ops = c.read_openapi(spark, str(tmp_path / "spec.json"))
    functions, errors = c.openapi_functions(ops)
    got = {r.name: r for r in functions.collect()}
    assert set(got) == {"A--go", "B--go"} and len(got["A--go"].description) == 1024 and got["B--go"].description == "s"
    assert json.loads(got["A--go"].schema)["properties"]["n"] == {"type": "integer"}
    assert {(r.path, r.method) for r in errors.collect()} == {("/b", "get"), ("/c", "post")}
    assert [r.name for r in c.openapi_functions(ops, "B")[0].collect()] == ["B--go"]


def test_validation(spark):
    tools = spark.createDataFrame([("A--f", 1, ["x"], ["x", "y"]), ("A--f", 2, [], []), ("B--g", 3, None, None)], "name string, pos int, required array<string>, properties array<string>")
    calls = spark.createDataFrame([(1, "remote", "A--f", ["y", "z", "z"]), (2, "remote", "none", ["q"]), (3, "mcp", "none", []), (4, "internal", "B--g", ["q"])], "call_id int, type string, name string, args array<string>")
    got = {r.call_id: (r.unknown, r.missing, r.improper) for r in c.validated(calls, tools).collect()}
    assert got == {1: (False, ["x"], ["z"]), 2: (True, [], []), 4: (False, [], ["q"])}


def test_first_of_several(spark):
    agents = spark.createDataFrame([("Room", 0), ("RoomAgent", 1)], "name string, pos int")
    tasks = spark.createDataFrame([(1, 0, "the RoomAgent", "t"), (1, 1, "room", "t")], "plan_id int, pos int, agent string, task string")
    got = {r.pos: r for r in c.planned_agents(tasks, agents).collect()}
    assert got[0].agent == "Room" and got[1].agent == "GeneralAgent" and got[1].task.endswith("\n\nt")
    with pytest.raises(ValueError):
        c.planned_agents(tasks, agents, most=1)
    one = lambda cid, pos, name: (cid, pos, [("A", [(name, None)]), ("B", [])])
    cont = spark.createDataFrame([one("c1", 0, "go"), one("c2", 1, "run"), one("c3", 2, "go")], "container_id string, pos int, agents array<struct<agent_id: string, actions array<struct<name: string, description: string>>>>".replace("actions array", "actions: array"))
    assert {r.agent: r.actions for r in c.agent_actions(cont).collect()} == {"A": ["go"], "B": []}
    calls = spark.createDataFrame([("A", "go"), ("A", "no")], "agent string, action string")
    assert {r.action: r.container_id for r in c.container_of(cont, calls).collect()} == {"go": "c1", "no": None}


def test_registrations(spark):
    r = spark.createDataFrame([(1, "http://a.b/x", ""), (2, "http://a.b/x", "other"), (3, "http://a.b/y", None), (4, "ftp://q", "q"), (5, "http://old", "n"), (6, "http://n", "known")], "request_id int, server_url string, server_label string")
    s = spark.createDataFrame([("http://old", "known")], "server_url string, server_label string")
    got = {x.request_id: (x.server_label, x.status) for x in c.registrations(r, s).collect()}
    assert got == {1: ("a-b", "ok"), 2: ("other", "repeated address"), 3: ("a-b", "repeated label"), 4: ("q", "malformed address"), 5: ("n", "repeated address"), 6: ("known", "repeated label")}


def test_tree(spark):
    t = spark.createDataFrame([("Home", "Lamp", "on", "switch light"), ("Home", "Door", "open", None), ("Office", "lamp2", "dim", "x" * 60 + "LIGHT" + "y" * 60)], "container string, agent string, action string, description string")
    assert {r.action for r in c.filtered_tree(t, "lamp").collect()} == {"on", "dim"}
    assert {r.action for r in c.filtered_tree(t, "HOME").collect()} == {"on", "open"}
    got = {(r.level, r.path): r.context for r in c.tree_hits(t, "light").collect()}
    assert got == {("action", "Home › Lamp › on"): "switch light", ("action", "Office › lamp2 › dim"): "…" + "x" * 40 + "LIGHT" + "y" * 40 + "…"}
    assert c.tree_hits(t, " ").count() == 0


LIB = {"en": [{"id": "a", "header": "H", "icon": "i", "is_default": True, "questions": [{"question": "Open the door"}, {"question": "Shut it", "icon": "q"}]}, {"id": "u", "header": "U", "is_default": False, "visible": False, "questions": [{"question": "mine"}]}], "de": [{"id": "d", "header": "D", "is_default": False, "questions": [{"question": "Tür"}]}]}


def test_prompts(spark, tmp_path):
    (tmp_path / "base.json").write_text(json.dumps(LIB))
    rows = p.read_library(spark, str(tmp_path / "none.json"), str(tmp_path / "base.json"))
    assert rows.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        p.read_library(spark, str(tmp_path / "no"), str(tmp_path / "nor"))
    assert [r.question for r in p.found(rows, "DOOR open").collect()] == ["Open the door"]
    assert [r.shown_icon for r in p.with_icons(rows.filter("id = 'a'")).orderBy("q_pos").collect()] == ["i", "q"]
    assert p.picked(rows, None, k=2).count() == 2 and p.picked(rows, "the", category="U").count() == 0
    defaults = rows.filter("is_default")
    out = p.reset(defaults, rows).orderBy("source", "q_pos").collect()
    assert [(r.lang, r.question) for r in out] == [("en", "Open the door"), ("en", "Shut it"), ("en", "mine")]
    saved = json.loads(p.nest_library(rows).first().value)
    assert set(saved) == {"en", "de"} and saved["en"][0]["questions"][1] == {"question": "Shut it", "icon": "q"}
    assert rows.filter("visible").count() == 3


def test_translations_and_settings(spark):
    texts = spark.createDataFrame([("de", "a", "Hallo %1"), ("en", "a", "Hello %1"), ("en", "b", "Only"), ("de", "b", "")], "lang string, key string, text string")
    keys = spark.createDataFrame([("a", ["Ann"]), ("b", []), ("c", [])], "key string, args array<string>")
    assert {r.key: r.text for r in p.translated(keys, texts, "de", "en").collect()} == {"a": "Hallo Ann", "b": "Only", "c": "[UNKNOWN: c]"}
    rules = spark.createDataFrame(
        [("m", "rounds", "integer", 1.0, 10.0, 1.0, None, []), ("m", "temp", "number", 0.0, 2.0, 0.1, None, []), ("m", "name", "string", None, None, None, "^[a-z]+$", []), ("m", "mode", "string", None, None, None, None, ["x", "y"]), ("m", "on", "boolean", None, None, None, None, None)],
        "method string, key string, kind string, least double, most double, step double, pattern string, choices array<string>",
    )
    conf = spark.createDataFrame([("m", k, v) for k, v in [("rounds", "5"), ("rounds", "11"), ("rounds", "x"), ("rounds", "0"), ("temp", "0.3"), ("temp", "0.35"), ("name", "ok"), ("name", "No"), ("mode", "x"), ("mode", "z"), ("on", "maybe"), ("new", "1"), ("on", None)]], "method string, key string, value string")
    got = {(r.key, r.value): r.problem for r in p.violations(conf, rules).collect()}
    assert got == {("rounds", "11"): "too large", ("rounds", "x"): "wrong type", ("rounds", "0"): "too small", ("temp", "0.35"): "not a multiple", ("name", "No"): "wrong format", ("mode", "z"): "no such choice", ("on", "maybe"): "wrong type", ("new", "1"): "unknown key", ("on", None): "no value"}
    hosts = spark.range(1).select(p.host_models("h1;h2;h3", "k1;k2", "a,b;c;d").alias("x")).first().x
    assert [(h.host, h.key, h.models) for h in hosts] == [("h1", "k1", ["a", "b"]), ("h2", "k2", ["c"])]
    calls = spark.createDataFrame([("big-1", {"temperature": "1", "x": "2"}), ("other", {"temperature": "1"})], "model string, params map<string,string>")
    support = spark.createDataFrame([("b", ["x"]), ("big", ["temperature"])], "prefix string, dropped array<string>")
    assert {r.model: r.params for r in p.supported_parameters(calls, support).collect()} == {"big-1": {"x": "2"}, "other": {"temperature": "1"}}
    books = spark.createDataFrame([(0, "b", True), (1, "A", True), (2, "c", False)], "pos int, name string, enabled boolean")
    assert [r.name for r in p.enabled_play_books(books).collect()] == ["A", "b"]
    assert spark.range(1).select(p.layered(F.lit(None), F.lit("cookie"), F.lit("env"))).first()[0] == "cookie"


def test_function_specs(spark):
    t = spark.createDataFrame([("P", "t", "does", [("a", "string")], None)], "provider string, tool string, description string, properties array<struct<name: string, type: string>>, required array<string>")
    spec = json.loads(c.internal_catalogue(t, "function").first().spec)
    assert spec == {"type": "function", "name": "P--t", "description": "does", "parameters": {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}}
