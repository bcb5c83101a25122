import dataclasses
import json

from talkmill.operators import evaluation, prompts
from talkmill.operators.registry import tools
from talkmill.sources import results

Q = {"question": "q", "time": 2.0, "server_time": 1.0, "score": 4, "agent_time": {"a": 1.5}, "response_metadata": {"total_tokens": 7}, "tool_matches": {"match": [], "missed": [], "extra": ["x"]}}
S = {"questions": 2, "correct_tool_usage": 1, "perfect_tool_usage": 0, "total_time": 2.0, "total_server_time": 1.0, "agent_time": {"a": 1.5}, "total_token_usage": 7, "average_score": 4.0}


def test_result_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"m": {"x": {"questions": [Q], "summary": S}}, "n": {"x": {"questions": [], "summary": S}}}, indent=1))
    r = results.read_results(spark, str(tmp_path / "r.json"))
    own = evaluation.summary(results.answers(r)).first()
    assert (own.method, own.correct, own.perfect, own.tokens, own.average_score) == ("m", 1, 0, 7, 4.0)
    report = evaluation.compared(results.summaries(r), results.summaries(r))
    assert report.count() == 2 and report.first().score_percent == 100.0
    for _ in range(2):
        results.write_json(report, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_config_rows_and_schema(spark):
    @dataclasses.dataclass
    class Settings:
        model: str
        rounds: int = 5
        on: bool = True

    assert prompts.schema_of(Settings) == {"type": "object", "properties": {"model": {"type": "string"}, "rounds": {"type": "integer", "default": 5}, "on": {"type": "boolean", "default": True}}, "required": ["model"]}
    c = spark.createDataFrame([("a", "k", "1"), ("a", "l", "2"), ("b", "k", "3")], "method string, key string, value string")
    d = spark.createDataFrame([("a", "k", "0")], c.schema)
    assert {tuple(r) for r in prompts.reset_config(c, d, "a").collect()} == {("a", "k", "0"), ("b", "k", "3")}


def test_chat_tools(spark):
    m = spark.createDataFrame([("c", 0, "user", "hello ann"), ("c", 1, "assistant", None)], "chat_id string, message_id long, role string, content string")
    assert tools.call("Chats--SearchChats", {"messages": m}, query="ANN").first().excerpt == "hello ann"
    assert tools.call("Chats--GatherUserInfo", {"messages": m}).first().transcript == "user: hello ann\nassistant: "
    b = spark.createDataFrame([("1", "n", "w", "x", True, 0)], "id string, name string, when_to_use string, what_to_do string, enabled boolean, pos int")
    assert tools.call("PlayBooks--LoadPlayBook", {"play_books": b}, name="n").first().what_to_do == "x"
    assert tools.call("PlayBooks--CreatePlayBook", {"play_books": b}, id="2", name="m", when_to_use="", what_to_do="").count() == 2
