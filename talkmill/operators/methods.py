"""Pluggable answering methods: a name, a class of settings, and the model requests a query leads to.

Models are called elsewhere; a method only says whom to ask, in which order and with which settings. Another method is
plugged in by ``METHODS.add``.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prompts import schema_of


@dataclasses.dataclass
class Simple:
    model: str = "default"
    max_rounds: int = 5
    ask_policy: str = "never"


@dataclasses.dataclass
class SimpleTools:
    model: str = "default"
    max_rounds: int = 5


@dataclasses.dataclass
class ToolLoop:
    tool_gen_model: str = "default"
    tool_eval_model: str = "default"
    output_model: str = "default"
    max_rounds: int = 5


@dataclasses.dataclass
class Orchestrated:
    orchestrator_model: str = "default"
    worker_model: str = "default"
    evaluator_model: str = "default"
    generator_model: str = "default"
    max_rounds: int = 5
    max_iterations: int = 3
    use_agent_planner: bool = True
    use_agent_evaluator: bool = False


@dataclasses.dataclass(frozen=True)
class Method:
    """name, settings class, and its steps as (agent, setting that names the model, setting that switches it on or None)."""

    name: str
    config: type
    steps: tuple[tuple[str, str, str | None], ...]

    def config_schema(self) -> dict:
        return schema_of(self.config)

    def defaults(self) -> dict[str, str]:
        shown = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        return {f.name: shown(f.default) for f in dataclasses.fields(self.config)}

    def query(self, queries: DataFrame, settings: DataFrame) -> DataFrame:
        """The requests of one round: session_id, method, step (from 0), agent, model and max_rounds.

        queries: session_id, query; settings: session_id, method, key, value (what a session has changed; null and
        unknown keys count as not given).
        """
        keys = self.defaults()
        own = settings.filter((F.col("method") == self.name) & F.col("value").isNotNull())
        own = own.groupBy("session_id").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys))
        rows = queries.select("session_id", "query").join(own, "session_id", "left")
        value = {k: F.coalesce(k, F.lit(v)) for k, v in keys.items()}
        step = lambda agent, model, switch: F.when(value[switch] == "true" if switch else F.lit(True), F.struct(F.lit(agent).alias("agent"), value[model].alias("model")))
        asked = F.array_compact(F.array(*(step(*s) for s in self.steps)))
        rows = rows.select("session_id", value["max_rounds"].cast("int").alias("max_rounds"), F.posexplode(asked).alias("step", "s"))
        return rows.select("session_id", F.lit(self.name).alias("method"), "step", "s.agent", "s.model", "max_rounds")


class Methods(dict):
    """Methods by name."""

    def add(self, method: Method) -> None:
        if method.name in self:
            raise ValueError(f"there is a method {method.name} already")
        self[method.name] = method

    def requests(self, queries: DataFrame, settings: DataFrame) -> DataFrame:
        """The requests of queries with a ``method`` each; queries of a method that nobody plugged in have none."""
        return reduce(DataFrame.unionByName, (m.query(queries.filter(F.col("method") == m.name), settings) for m in self.values()))

    def properties(self, spark: SparkSession) -> DataFrame:
        """The settings of all methods by their schemas: method, key, type, default."""
        rows = [(m.name, k, p["type"], m.defaults()[k]) for m in self.values() for k, p in m.config_schema()["properties"].items()]
        return spark.createDataFrame(rows, "method string, key string, type string, default string")


#: The names of the methods and of their settings.
METHODS = Methods()
METHODS.add(Method("simple", Simple, (("assistant", "model", None),)))
METHODS.add(Method("simple-tools", SimpleTools, (("assistant", "model", None),)))
METHODS.add(Method("tool-llm", ToolLoop, (("generator", "tool_gen_model", None), ("evaluator", "tool_eval_model", None), ("output", "output_model", None))))
METHODS.add(Method("self-orchestrated", Orchestrated, (
    ("orchestrator", "orchestrator_model", None), ("planner", "orchestrator_model", "use_agent_planner"), ("worker", "worker_model", None),
    ("evaluator", "evaluator_model", "use_agent_evaluator"), ("output", "generator_model", None),
)))

