"""Tool catalogues and their policy: schemas, filters, approvals, call validation, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkmill.functions import text as tx

MAX_TOOLS = 128
#: Fragments of admin rules are a setting; more than this many are no setting any more.
MAX_FRAGMENTS = 10_000

FUNCTION_SCHEMA = "struct<type: string, required: array<string>, properties: map<string, string>>"


def _bounded(fragments: list[str]) -> list[str]:
    if len(fragments) > MAX_FRAGMENTS:
        raise ValueError(f"at most {MAX_FRAGMENTS} fragments are expected")
    return [f.lower() for f in fragments]


def matches_any(name: Column, fragments: list[str]) -> Column:
    """Whether the name holds one of the fragments, in any case; the fragments are literals of the plan."""
    low = F.lower(name)
    if not _bounded(fragments):
        return F.lit(False)
    return F.exists(F.array(*map(F.lit, _bounded(fragments))), lambda f: F.contains(low, f))


def usable(tools: DataFrame, forbidden: list[str]) -> DataFrame:
    """Tools that the user does not deny and no admin fragment forbids.

    tools: source (remote, internal, mcp), name (full), short_name, approval. Of MCP tools the short name counts.
    """
    name = F.when(F.col("source") == "mcp", F.col("short_name")).otherwise(F.col("name"))
    return tools.filter((F.coalesce("approval", F.lit("allow")) != "deny") & ~matches_any(name, forbidden))


def effective_approval(name: Column, user: Column, forbidden: list[str], confirm: list[str]) -> Column:
    """deny by the admin, deny by the user, ask by the admin, then what the user chose (allow by default)."""
    return (
        F.when(matches_any(name, forbidden), "deny")
        .when(user == "deny", "deny")
        .when(matches_any(name, confirm), "ask")
        .otherwise(F.coalesce(user, F.lit("allow")))
    )


def invocation_allowed(action: Column, agent: Column, forbidden: list[str]) -> Column:
    """Neither the action nor the agent holds a forbidden fragment."""
    return ~(matches_any(action, forbidden) | matches_any(F.coalesce(agent, F.lit("")), forbidden))


def joined(*tools: DataFrame) -> DataFrame:
    """The sources' tools one after another, with repeats; ``source_rank`` and ``pos`` keep the order."""
    out = None
    for i, t in enumerate(tools):
        t = t.withColumn("source_rank", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def capped(tools: DataFrame, most: int = MAX_TOOLS) -> DataFrame:
    """The first tools in order."""
    return tools.orderBy("source_rank", "pos").limit(most)


#: Fixed value: the warning, by how many tools there are and may be.
_WARNING = "WARNING: Your number of tools (%d) exceeds the maximum tool limit of {most}. All tools after index {most} will be ignored!\n"


def cap_warning(tools: DataFrame, most: int = MAX_TOOLS) -> DataFrame:
    """One row with a warning where there are more tools than may be used."""
    n = tools.agg(F.count(F.lit(1)).alias("n"))
    text = F.format_string(_WARNING.format(most=most), F.col("n"))
    return n.select("n", F.when(F.col("n") > most, text).otherwise("").alias("warning"))


def openapi_functions(operations: DataFrame, agent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Operations as function rows, and error rows for ids that are not container;agent;action.

    operations: path, method, operation_id, description, summary, schema (JSON).
    """
    parts = F.split("operation_id", ";", -1)
    rows = operations.withColumn("_p", parts)
    good = F.coalesce(F.size("_p") == 3, F.lit(False))
    errors = rows.filter(~good).select("path", "method", F.concat(F.lit("Error while splitting the operation id "), F.coalesce("operation_id", F.lit("None")), F.lit(".")).alias("error"))
    rows = rows.filter(good).withColumns({"container_id": F.get("_p", F.lit(0)), "agent": F.get("_p", F.lit(1)), "action": F.get("_p", F.lit(2))})
    if agent:
        rows = rows.filter(F.col("agent") == agent)
    text = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 1024)
    functions = rows.select(
        "container_id", F.concat_ws("--", "agent", "action").alias("name"),
        F.coalesce(F.nullif(text("description"), F.lit("")), text("summary")).alias("description"), "schema",
    )
    return functions, errors


def read_openapi(spark: SparkSession, path: str) -> DataFrame:
    """A specification file as operations, one row per path and method; references to its own parts stay as they are."""
    spec = spark.read.text(path, wholetext=True).select(F.from_json("value", "paths map<string, map<string, string>>").alias("s"))
    by_path = spec.select(F.explode("s.paths").alias("path", "methods"))
    each = by_path.select("path", F.explode("methods").alias("method", "o"))
    field = lambda p: F.get_json_object("o", p)
    return each.select(
        "path", "method", field("$.operationId").alias("operation_id"), field("$.description").alias("description"), field("$.summary").alias("summary"),
        field("$.requestBody.content['application/json'].schema").alias("schema"),
    )


def inline_references(spec: dict, depth: int = 20) -> dict:
    """The specification with local ``$ref`` objects replaced by what they point to (a document, not data)."""

    def at(ref: str):
        node = spec
        for part in ref.removeprefix("#/").split("/"):
            node = node[part.replace("~1", "/").replace("~0", "~")]
        return node

    def walk(node, left: int):
        if isinstance(node, dict):
            if isinstance(node.get("$ref"), str) and node["$ref"].startswith("#/") and left:
                return walk(at(node["$ref"]), left - 1)
            return {k: walk(v, left) for k, v in node.items()}
        return [walk(v, left) for v in node] if isinstance(node, list) else node

    return walk(spec, depth)


def function_spec(name: Column, description: Column, properties: Column, required: Column | None = None) -> Column:
    """A tool as a JSON function specification; without a list, all parameters are required."""
    props = F.map_from_entries(F.transform(properties, lambda p: F.struct(p["name"], F.struct(p["type"].alias("type")))))
    needed = F.transform(properties, lambda p: p["name"])
    needed = F.coalesce(required, needed) if required is not None else needed
    schema = F.struct(F.lit("object").alias("type"), props.alias("properties"), needed.alias("required"))
    return F.to_json(F.struct(F.lit("function").alias("type"), name.alias("name"), description.alias("description"), schema.alias("parameters")))


def internal_catalogue(tools: DataFrame, shape: str) -> DataFrame:
    """Internal tools (provider, tool, description, properties, required) as simple, container or function rows."""
    name = F.concat_ws("--", "provider", "tool")
    if shape == "simple":
        return tools.select(name.alias("name"), "description", F.transform("properties", lambda p: p["name"]).alias("parameters"))
    if shape == "container":
        action = F.struct(F.col("tool").alias("name"), "description")
        return tools.groupBy("provider").agg(F.array_sort(F.collect_list(action)).alias("actions"))
    return tools.select(name.alias("name"), function_spec(name, F.col("description"), F.col("properties"), F.col("required")).alias("spec"))


def mcp_function(tools: DataFrame) -> DataFrame:
    """MCP tools (server_label, tool, description, input_schema JSON) under their full names."""
    return tools.select(F.concat_ws("--", "server_label", "tool").alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.col("input_schema").alias("parameters"))


def agent_details(*parts: DataFrame) -> DataFrame:
    """agent, description and functions of all sources; of an agent that occurs twice the last counts.

    Each part: pos, agent, description, functions array<string>; agents without functions (servers whose
    tools are all denied) go if the part says so by a null array.
    """
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source", F.lit(i))
        out = p if out is None else out.unionByName(p)
    last = F.max_by(F.struct("description", "functions"), F.struct("source", "pos"))
    return out.filter(F.col("functions").isNotNull()).groupBy("agent").agg(last.alias("a")).select("agent", "a.description", "a.functions")


def agents_as_tools(details: DataFrame) -> DataFrame:
    names = F.concat(F.lit("["), F.array_join(F.transform("functions", lambda f: F.concat(F.lit("'"), f, F.lit("'"))), ", "), F.lit("]"))
    return details.select(F.col("agent").alias("name"), F.concat("description", F.lit("\n\nFunctions:\n"), names).alias("description"))


def actions_of(containers: DataFrame) -> DataFrame:
    """Nested containers (container_id, pos, agents array<struct<agent_id, actions array<struct<name, description>>>>) as one row per action."""
    agents = containers.select("container_id", "pos", F.posexplode("agents").alias("agent_pos", "a"))
    acts = agents.select("container_id", "pos", "agent_pos", F.col("a.agent_id").alias("agent"), F.posexplode("a.actions").alias("action_pos", "x"))
    return acts.select("container_id", "pos", "agent_pos", "agent", "action_pos", F.col("x.name").alias("action"), F.col("x.description").alias("description"))


def agent_actions(containers: DataFrame) -> DataFrame:
    """The actions of each agent; where two containers have an agent, the later one's."""
    agents = containers.select("pos", F.posexplode("agents").alias("agent_pos", "a"))
    names = F.transform("a.actions", lambda x: x["name"])
    return agents.groupBy(F.col("a.agent_id").alias("agent")).agg(F.max_by(names, F.struct("pos", "agent_pos")).alias("actions"))


def container_of(containers: DataFrame, calls: DataFrame) -> DataFrame:
    """For each (agent, action) the first container that has it; null if none."""
    first = actions_of(containers).groupBy("agent", "action").agg(F.min_by("container_id", "pos").alias("container_id"))
    return calls.join(first, ["agent", "action"], "left")


def tool_type(calls: DataFrame, internal: DataFrame, servers: DataFrame) -> DataFrame:
    """internal before mcp before remote, by the part of ``name`` before the first double hyphen."""
    c = calls.withColumn("provider", tx.provider(F.col("name")))
    c = c.join(internal.select("provider").distinct().withColumn("_i", F.lit("internal")), "provider", "left")
    c = c.join(servers.select("provider").distinct().withColumn("_m", F.lit("mcp")), "provider", "left")
    return c.withColumn("type", F.coalesce("_i", "_m", F.lit("remote"))).drop("_i", "_m")


def first_approval(tools: DataFrame, approvals: DataFrame) -> DataFrame:
    """The user's setting by the first container that has one for the tool, else allow."""
    first = approvals.groupBy("tool_name").agg(F.min_by("approval", "container_pos").alias("approval"))
    return tools.join(first, "tool_name", "left").withColumn("approval", F.coalesce("approval", F.lit("allow")))


#: What stands before and after the name of an agent that does not exist, and who gets its task.
_ASSIGNED = "You have been given a task which was assigned to the agent "
_MISSING = ". This agent does not exist however. Check if the task could be solved by the current environment. This was the original task:\n\n"
_GENERAL = "GeneralAgent"


def planned_agents(tasks: DataFrame, agents: DataFrame, most: int = 1000) -> DataFrame:
    """The first agent whose name is part of the task's agent name, else the general agent with a reworded task.

    tasks: plan_id, pos, agent, task; agents: name, pos. Agents are what one platform offers: their number is checked,
    and they go into the plan as an array in order, so tasks are never multiplied.
    """
    rows = agents.orderBy("pos").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} agents")
    names = F.array(*(F.lit(r["name"]) for r in rows)).cast("array<string>")
    found = F.get(F.filter(names, lambda n: F.contains(F.col("agent"), n)), F.lit(0))
    note = F.concat(F.lit(_ASSIGNED), "agent", F.lit(_MISSING), "task")
    return tasks.select("plan_id", "pos", F.coalesce(found, F.lit(_GENERAL)).alias("agent"), F.when(found.isNotNull(), F.col("task")).otherwise(note).alias("task"))


def validated(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Unknown names, required parameters that are missing, and parameters that the tool does not have.

    calls: call_id, type, name, args array<string> (keys); tools: name, required, properties. MCP calls pass.
    """
    first = tools.groupBy("name").agg(F.min_by(F.struct("required", "properties"), "pos").alias("t"))
    c = calls.filter(F.col("type") != "mcp").join(first, "name", "left")
    known = F.col("t").isNotNull()
    none = F.array().cast("array<string>")
    return c.select(
        "call_id", "name", (~known).alias("unknown"),
        F.when(known, F.array_except(F.coalesce("t.required", none), "args")).otherwise(none).alias("missing"),
        F.when(known, F.array_except("args", F.coalesce("t.properties", none))).otherwise(none).alias("improper"),
    )


def extra_ports(containers: DataFrame, tokens: DataFrame, host: str) -> DataFrame:
    """Addresses of the TCP ports that containers offer, with each container's token.

    containers: container_id, ports map<string, struct<protocol, description>>.
    """
    each = containers.select("container_id", F.explode("ports").alias("port", "p")).filter("p.protocol = 'TCP'")
    each = each.join(tokens, "container_id", "left")
    one = F.struct(F.col("port").cast("int").alias("port"), F.concat(F.lit(f"{host}:"), "port", F.coalesce(F.concat(F.lit("?token="), "token"), F.lit(""))).alias("address"))
    return each.groupBy("container_id").agg(F.array_sort(F.collect_list(one)).alias("ports"))


def registrations(requests: DataFrame, servers: DataFrame) -> DataFrame:
    """What becomes of requests to register tool servers: ok, malformed, or a repeated address or label.

    requests: request_id, server_url, server_label; of several new requests for one address or label the
    first one counts. servers: server_url, server_label.
    """
    label = F.coalesce(F.nullif("server_label", F.lit("")), tx.server_label(F.col("server_url")))
    r = requests.withColumn("server_label", label).withColumn("_valid", tx.is_web_address(F.col("server_url")))
    known_url = servers.select("server_url").distinct().withColumn("_u", F.lit(True))
    known_label = servers.select("server_label").distinct().withColumn("_l", F.lit(True))
    r = r.join(known_url, "server_url", "left").join(known_label, "server_label", "left")
    first_url = r.filter("_valid").groupBy("server_url").agg(F.min("request_id").alias("_first_url"))
    r = r.join(first_url, "server_url", "left")
    url_ok = F.col("_valid") & F.col("_u").isNull() & (F.col("request_id") == F.col("_first_url"))
    first_label = r.filter(url_ok & F.col("_l").isNull()).groupBy("server_label").agg(F.min("request_id").alias("_first_label"))
    r = r.join(first_label, "server_label", "left")
    status = (
        F.when(~F.col("_valid"), "malformed address")
        .when(~url_ok, "repeated address")
        .when(F.col("_l").isNotNull() | (F.col("request_id") != F.col("_first_label")), "repeated label")
        .otherwise("ok")
    )
    return r.select("request_id", "server_url", "server_label", status.alias("status"))


def filtered_tree(actions: DataFrame, query: str) -> DataFrame:
    """Actions left by a search: all below a matching container or agent, else those that match themselves.

    actions: container, agent, action, description; containers and agents without actions are not in it.
    """
    q = query.strip().lower()
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    return actions.filter(has(F.col("container")) | has(F.col("agent")) | has(F.col("action")) | has(F.col("description")))


def tree_hits(actions: DataFrame, query: str) -> DataFrame:
    """One row per matching container, agent and action, with its path and an excerpt."""
    q = query.strip().lower()
    if not q:
        return actions.limit(0).select(F.lit("").alias("level"), F.lit("").alias("path"), F.lit("").alias("context"))
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    cut = lambda c: tx.first_excerpt(c, q)
    container, agent, action, about = (F.col(c) for c in ("container", "agent", "action", "description"))
    row = lambda level, parts, text: (F.lit(level).alias("level"), F.concat_ws(" › ", *parts).alias("path"), cut(text).alias("context"))
    tops = actions.select("container").distinct().filter(has(container)).select(*row("container", [container], container))
    mids = actions.select("container", "agent").distinct().filter(has(agent)).select(*row("agent", [container, agent], agent))
    leaf = actions.filter(has(action) | has(about)).select(*row("action", [container, agent, action], F.when(has(about), about).otherwise(action)))
    return tops.unionByName(mids).unionByName(leaf)


def tree_order(actions: DataFrame, internal: str) -> DataFrame:
    """Ranks for display: the internal container first, then names in any case, at all three levels."""
    first = F.desc(F.col("container") == internal)
    c = F.dense_rank().over(Window.orderBy(first, F.lower("container"), "container"))
    names = actions.select("container").distinct().withColumn("container_rank", c)  # one row per container
    within = Window.partitionBy("container").orderBy(F.lower("agent"), "agent")
    below = Window.partitionBy("container", "agent").orderBy(F.lower("action"), "action")
    ranked = actions.withColumn("agent_rank", F.dense_rank().over(within)).withColumn("action_rank", F.row_number().over(below))
    return ranked.join(names, "container")


def servers_found(tools: DataFrame, query: str) -> DataFrame:
    """Server labels that match, or that have a tool that does."""
    q = query.strip().lower()
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    return tools.filter(has(F.col("server_label")) | has(F.col("tool"))).select("server_label").distinct()
