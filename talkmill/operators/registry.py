"""Named, typed functions that a caller may run by name with arguments."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import schedule

_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


class Tools:
    """A registry of ``provider--name`` functions over DataFrames."""

    def __init__(self) -> None:
        self._tools: dict[str, Callable] = {}

    def add(self, provider: str, name: str):
        def put(f: Callable) -> Callable:
            self._tools[f"{provider}--{name}"] = f
            return f

        return put

    def names(self) -> list[str]:
        return list(self._tools)

    def schema(self, name: str) -> dict:
        """Parameters by JSON type; those without a default are required. The first, the state, is the platform's."""
        params = list(inspect.signature(self._tools[name], eval_str=True).parameters.values())[1:]
        return {
            "type": "object",
            "properties": {p.name: {"type": _TYPES.get(p.annotation, "string")} for p in params},
            "required": [p.name for p in params if p.default is p.empty],
        }

    def call(self, name: str, state: dict[str, DataFrame], /, **args) -> DataFrame:
        if name not in self._tools:
            raise KeyError(f"no tool {name}")
        schema = self.schema(name)
        if missing := [p for p in schema["required"] if p not in args]:
            raise TypeError(f"missing parameters: {missing}")
        if improper := [p for p in args if p not in schema["properties"]]:
            raise TypeError(f"improper parameters: {improper}")
        return self._tools[name](state, **args)

    def catalogue(self, spark: SparkSession) -> DataFrame:
        rows = []
        for n in self._tools:
            provider, tool = n.split("--", 1)
            s = self.schema(n)
            rows.append((provider, tool, (self._tools[n].__doc__ or "").strip(), [(k, v["type"]) for k, v in s["properties"].items()], s["required"]))
        return spark.createDataFrame(rows, "provider string, tool string, description string, properties array<struct<name: string, type: string>>, required array<string>")


tools = Tools()


@tools.add("PlayBooks", "LoadPlayBook")
def load_play_book(state: dict, name: str) -> DataFrame:
    """The text of an enabled play book."""
    return state["play_books"].filter(F.col("enabled") & (F.col("name") == name)).select("name", "what_to_do")


@tools.add("PlayBooks", "CreatePlayBook")
def create_play_book(state: dict, id: str, name: str, when_to_use: str, what_to_do: str) -> DataFrame:
    """The play books with a new or replaced one."""
    from talkmill.operators import sessions

    new = state["play_books"].sparkSession.createDataFrame([(id, name, when_to_use, what_to_do, True)], "id string, name string, when_to_use string, what_to_do string, enabled boolean")
    return sessions.upsert_at_place(state["play_books"], new)


@tools.add("Scheduling", "ScheduleIntervalTask")
def schedule_interval_task(state: dict, query: str, delay_seconds: int, repetitions: int) -> DataFrame:
    """The tasks with one more that runs every so many seconds."""
    from talkmill.operators import scheduling

    if repetitions == 0:
        raise ValueError("repetitions must not be zero")
    return scheduling.added(state["tasks"], state["clock"], query, interval=delay_seconds, repetitions=repetitions)


@tools.add("Scheduling", "ScheduleCalendarTask")
def schedule_calendar_task(state: dict, query: str, time_of_day: str, weekdays: str) -> DataFrame:
    """The tasks with one more that runs at a time of day on weekdays (all without any)."""
    from talkmill.operators import scheduling

    return scheduling.added(state["tasks"], state["clock"], query, time_of_day=time_of_day, weekdays=weekdays or ",".join(schedule.DAYS), repetitions=-1)


@tools.add("Scheduling", "GetScheduledTasks")
def get_scheduled_tasks(state: dict) -> DataFrame:
    """All scheduled tasks."""
    return state["tasks"]


@tools.add("Scheduling", "CancelScheduleTask")
def cancel_scheduled_task(state: dict, task_id: int) -> DataFrame:
    """The tasks without this one."""
    return state["tasks"].filter(F.col("task_id") != task_id)


@tools.add("Chats", "SearchChats")
def search_chats(state: dict, query: str) -> DataFrame:
    """Places of a text in all chats."""
    from talkmill.operators import conversations

    return conversations.search(state["messages"], query)


@tools.add("Chats", "GatherUserInfo")
def gather_user_info(state: dict) -> DataFrame:
    """All chats as transcripts: what a model is given to tell about the user."""
    from talkmill.operators import conversations

    return conversations.transcripts(state["messages"])


@tools.add("Files", "ReadFileFromUrl")
def read_file_from_url(state: dict, url: str) -> DataFrame:
    """What the download of an address brought: a file for the model, or why there is none."""
    from talkmill.operators import files

    return files.downloaded(state["downloads"].filter(F.col("url") == url))


@tools.add("CodeExecution", "ExecuteCode")
def execute_code(state: dict, code: str, timeout_s: int = 10) -> DataFrame:
    """What a sandbox, whose answers are given, made of a program."""
    from talkmill.operators import code as ops

    return ops.executed(ops.requests(state["programs"].filter(F.col("code") == code), timeout_s), state["answers"])


@tools.add("CodeExecution", "SolveWithCode")
def solve_with_code(state: dict, task: str, timeout_s: int = 10, max_code_retries: int = 2) -> DataFrame:
    """What the attempts at a task, which are given, came to."""
    from talkmill.operators import code as ops

    return ops.solved(state["attempts"].filter(F.col("task_id") == task), max_code_retries)
