"""Queries over the catalogue: regions as containers, nations as agents, customers as actions; parts as tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import text as tx
from talkmill.operators import catalog as ops
from talkmill.sources.tables import load

from .base import query

FORBIDDEN, CONFIRM = ["Brand#1", "LACE"], ["RED", "brand#2"]


def _tree(spark, sf):
    r, n, c = (load(spark, sf, t) for t in ("region", "nation", "customer"))
    return c.join(F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)), c.c_nationkey == n.n_nationkey).select(  # 25 nations at any scale
        F.col("r_name").alias("container"), F.col("n_name").alias("agent"), F.col("c_name").alias("action"), F.col("c_mktsegment").alias("description")
    )


_TREE = "t AS (SELECT r_name AS container, n_name AS agent, c_name AS action, c_mktsegment AS description FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _any(column: str, q: str) -> str:
    return f"contains(lower({column}), '{q}')"


@query("f14_catalogue_filter", f"WITH {_TREE} SELECT container, agent, action FROM t WHERE {_any('container', 'asi')} OR {_any('agent', 'asi')} OR {_any('action', 'asi')} OR {_any('description', 'asi')}")
def catalogue_filter(spark, sf):
    return ops.filtered_tree(_tree(spark, sf), " ASI ").select("container", "agent", "action")


@query("f15_catalogue_hits", f"""WITH {_TREE} SELECT 'container' AS level, container AS path, container AS context FROM (SELECT DISTINCT container FROM t) WHERE {_any('container', 'ma')}
UNION ALL SELECT 'agent', container || ' › ' || agent, agent FROM (SELECT DISTINCT container, agent FROM t) WHERE {_any('agent', 'ma')}
UNION ALL SELECT 'action', container || ' › ' || agent || ' › ' || action, CASE WHEN {_any('description', 'ma')} THEN description ELSE action END FROM t WHERE {_any('action', 'ma')} OR {_any('description', 'ma')}""")
def catalogue_hits(spark, sf):
    return ops.tree_hits(_tree(spark, sf), "MA")


@query("l6_catalogue_order", f"""WITH {_TREE}, c AS (SELECT container, dense_rank() OVER (ORDER BY container = 'EUROPE' DESC, lower(container), container)::INT AS container_rank FROM (SELECT DISTINCT container FROM t))
SELECT container, container_rank, agent, dense_rank() OVER (PARTITION BY container ORDER BY lower(agent), agent)::INT AS agent_rank,
action, row_number() OVER (PARTITION BY container, agent ORDER BY lower(action), action)::INT AS action_rank FROM t JOIN c USING (container)""")
def catalogue_order(spark, sf):
    return ops.tree_order(_tree(spark, sf), "EUROPE").select("container", "container_rank", "agent", "agent_rank", "action", "action_rank")


def _tools(spark, sf):
    p = load(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 == 0, "mcp").when(F.col("p_partkey") % 3 == 1, "remote").otherwise("internal").alias("source"),
        F.concat_ws("--", "p_brand", "p_name").alias("name"), F.col("p_name").alias("short_name"),
        F.when(F.col("p_size") % 7 == 0, "deny").when(F.col("p_size") % 7 == 1, "ask").when(F.col("p_size") % 7 == 2, "allow").alias("approval"),
    )


_TOOLS = """t AS (SELECT p_partkey AS pos, CASE p_partkey % 3 WHEN 0 THEN 'mcp' WHEN 1 THEN 'remote' ELSE 'internal' END AS source, p_brand || '--' || p_name AS name, p_name AS short_name,
CASE p_size % 7 WHEN 0 THEN 'deny' WHEN 1 THEN 'ask' WHEN 2 THEN 'allow' END AS approval FROM part)"""


def _one_of(column: str, fragments: list[str]) -> str:
    return "(" + " OR ".join(_any(column, f.lower()) for f in fragments) + ")"


@query("f1_usable_tools", f"""WITH {_TOOLS} SELECT pos, name FROM t WHERE coalesce(approval, 'allow') <> 'deny'
AND NOT CASE WHEN source = 'mcp' THEN {_one_of('short_name', FORBIDDEN)} ELSE {_one_of('name', FORBIDDEN)} END""")
def usable_tools(spark, sf):
    return ops.usable(_tools(spark, sf), FORBIDDEN).select("pos", "name")


@query("f4_invocation_guard", f"SELECT p_partkey, NOT ({_one_of('p_name', FORBIDDEN)} OR {_one_of('p_brand', FORBIDDEN)}) AS allowed FROM part")
def guard(spark, sf):
    return load(spark, sf, "part").select("p_partkey", ops.invocation_allowed(F.col("p_name"), F.col("p_brand"), FORBIDDEN).alias("allowed"))


@query("f5_effective_approval", f"""WITH {_TOOLS} SELECT pos, CASE WHEN {_one_of('name', FORBIDDEN)} THEN 'deny' WHEN approval = 'deny' THEN 'deny'
WHEN {_one_of('name', CONFIRM)} THEN 'ask' ELSE coalesce(approval, 'allow') END AS approval FROM t""")
def approval(spark, sf):
    return _tools(spark, sf).select("pos", ops.effective_approval(F.col("name"), F.col("approval"), FORBIDDEN, CONFIRM).alias("approval"))


@query("u3_tool_union", f"WITH {_TOOLS} SELECT CASE source WHEN 'remote' THEN 0 WHEN 'internal' THEN 1 ELSE 2 END AS source_rank, pos, name FROM t")
def union(spark, sf):
    t = _tools(spark, sf)
    return ops.joined(*(t.filter(F.col("source") == s) for s in ("remote", "internal", "mcp"))).select("source_rank", "pos", "name")


@query("l2_tool_cap", f"WITH {_TOOLS} SELECT pos, name FROM t ORDER BY CASE source WHEN 'remote' THEN 0 WHEN 'internal' THEN 1 ELSE 2 END, pos LIMIT 128")
def cap(spark, sf):
    t = _tools(spark, sf)
    return ops.capped(ops.joined(*(t.filter(F.col("source") == s) for s in ("remote", "internal", "mcp")))).select("pos", "name")


@query("l2_cap_warning", "SELECT count(*) AS n, CASE WHEN count(*) > 128 THEN 'WARNING: Your number of tools (' || count(*) || ') exceeds the maximum tool limit of 128. All tools after index 128 will be ignored!' || chr(10) ELSE '' END AS warning FROM part")
def warning(spark, sf):
    return ops.cap_warning(load(spark, sf, "part"))


@query("j18_first_approval", """WITH a AS (SELECT p_brand AS tool_name, p_partkey AS pos, CASE p_size % 3 WHEN 0 THEN 'deny' WHEN 1 THEN 'ask' ELSE 'allow' END AS approval FROM part WHERE p_size < 20 AND p_brand < 'Brand#3'),
f AS (SELECT tool_name, arg_min(approval, pos) AS approval FROM a GROUP BY ALL) SELECT p_partkey, coalesce(approval, 'allow') AS approval FROM part LEFT JOIN f ON p_brand = tool_name""")
def first_approval(spark, sf):
    p = load(spark, sf, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "deny").when(F.col("p_size") % 3 == 1, "ask").otherwise("allow")
    a = p.filter("p_size < 20 AND p_brand < 'Brand#3'").select(F.col("p_brand").alias("tool_name"), F.col("p_partkey").alias("container_pos"), kind.alias("approval"))
    return ops.first_approval(p.select("p_partkey", F.col("p_brand").alias("tool_name")), a).select("p_partkey", "approval")


@query("j4_planned_agents", """WITH n AS (SELECT o_orderkey, o_clerk, (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE contains(o_clerk, n_name)) AS found
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 30 < 25 THEN (SELECT any_value(n_name) FROM nation WHERE n_nationkey = o_custkey % 30) || '-Agent' ELSE 'Nobody' END AS o_clerk FROM orders))
SELECT o_orderkey, coalesce(found, 'GeneralAgent') AS agent, CASE WHEN found IS NULL THEN 'You have been given a task which was assigned to the agent ' || o_clerk
|| '. This agent does not exist however. Check if the task could be solved by the current environment. This was the original task:' || chr(10) || chr(10) || 'ship' ELSE 'ship' END AS task FROM n""")
def planned(spark, sf):
    o, n = load(spark, sf, "orders"), load(spark, sf, "nation")
    t = o.withColumn("k", (F.col("o_custkey") % 30).cast("int")).join(F.broadcast(n), F.col("k") == n.n_nationkey, "left")  # 25 nations
    t = t.select(F.col("o_orderkey").alias("plan_id"), F.lit(0).alias("pos"), F.coalesce(F.concat("n_name", F.lit("-Agent")), F.lit("Nobody")).alias("agent"), F.lit("ship").alias("task"))
    agents = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    return ops.planned_agents(t, agents).select(F.col("plan_id").alias("o_orderkey"), "agent", "task")


@query("j5_tool_type", """SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size < 3) THEN 'internal' WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 45) THEN 'mcp' ELSE 'remote' END AS type FROM part""")
def tool_type(spark, sf):
    p = load(spark, sf, "part")
    of = lambda c: p.filter(c).select(F.col("p_brand").alias("provider"))
    calls = p.select("p_partkey", F.concat_ws("--", "p_brand", "p_name").alias("name"))
    return ops.tool_type(calls, of("p_size < 3"), of("p_size > 45")).select("p_partkey", "type")


_OPS = """o AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN p_brand || ';' || p_name WHEN p_size % 10 = 1 THEN 'a;b;c;d' ELSE 'c' || p_size || ';' || p_brand || ';' || p_name END AS operation_id,
CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN repeat(p_type, 100) END AS description, p_type AS summary FROM part)"""


def _operations(spark, sf):
    size = F.col("p_size")
    oid = F.when(size % 10 == 0, F.concat_ws(";", "p_brand", "p_name")).when(size % 10 == 1, "a;b;c;d").otherwise(F.concat_ws(";", F.concat(F.lit("c"), size.cast("string")), "p_brand", "p_name"))
    about = F.when(size % 3 == 0, "").when(size % 3 == 1, F.repeat("p_type", F.lit(100)))
    return load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("post").alias("method"), oid.alias("operation_id"), about.alias("description"), F.col("p_type").alias("summary"), F.lit("{}").alias("schema"))


@query("p5_openapi_functions", f"""WITH {_OPS} SELECT split_part(operation_id, ';', 1) AS container_id, split_part(operation_id, ';', 2) || '--' || split_part(operation_id, ';', 3) AS name,
coalesce(nullif(substr(coalesce(description, ''), 1, 1024), ''), summary) AS description, '{{}}' AS schema FROM o WHERE len(string_split(operation_id, ';')) = 3""")
def functions(spark, sf):
    return ops.openapi_functions(_operations(spark, sf))[0]


@query("p5_openapi_errors", f"WITH {_OPS} SELECT p_partkey::VARCHAR AS path, 'post' AS method, 'Error while splitting the operation id ' || operation_id || '.' AS error FROM o WHERE len(string_split(operation_id, ';')) <> 3")
def function_errors(spark, sf):
    return ops.openapi_functions(_operations(spark, sf))[1]


def _internal(spark, sf):
    p = load(spark, sf, "part")
    props = F.array(F.struct(F.lit("size").alias("name"), F.lit("integer").alias("type")), F.struct(F.col("p_type").alias("name"), F.lit("string").alias("type")))
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("provider"), F.col("p_name").alias("tool"), F.col("p_type").alias("description"), props.alias("properties"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("size"))).alias("required"))


@query("p6_internal_simple", "SELECT p_brand || '--' || p_name AS name, p_type AS description, 'size,' || p_type AS parameters FROM part")
def internal_simple(spark, sf):
    return ops.internal_catalogue(_internal(spark, sf), "simple").withColumn("parameters", F.array_join("parameters", ","))


@query("p6_internal_container", "SELECT p_brand AS provider, count(*)::INT AS n, string_agg(p_name || ':' || p_type, '|' ORDER BY p_name, p_type) AS actions FROM part GROUP BY ALL")
def internal_container(spark, sf):
    t = ops.internal_catalogue(_internal(spark, sf), "container")
    return t.select("provider", F.size("actions").alias("n"), F.array_join(F.transform("actions", lambda a: F.concat_ws(":", a["name"], a["description"])), "|").alias("actions"))


@query("p6_internal_function", """SELECT p_brand || '--' || p_name AS name, '{"type":"function","name":"' || p_brand || '--' || p_name || '","description":"' || p_type || '","parameters":{"type":"object","properties":{"size":{"type":"integer"},"' || p_type || '":{"type":"string"}},"required":["size"'
|| CASE WHEN p_size % 2 = 0 THEN '' ELSE ',"' || p_type || '"' END || ']}}' AS spec FROM part""")
def internal_function(spark, sf):
    return ops.internal_catalogue(_internal(spark, sf), "function")


@query("p7_mcp_functions", "SELECT p_brand || '--' || p_name AS name, coalesce(CASE WHEN p_size > 5 THEN p_type END, '') AS description, '{}' AS parameters FROM part")
def mcp_functions(spark, sf):
    p = load(spark, sf, "part")
    return ops.mcp_function(p.select(F.col("p_brand").alias("server_label"), F.col("p_name").alias("tool"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("description"), F.lit("{}").alias("input_schema")))


def _details(spark, sf):
    tree, p = _tree(spark, sf), load(spark, sf, "part")
    agents = tree.groupBy("agent").agg(F.array_sort(F.collect_list("action")).alias("functions")).select(F.lit(0).alias("pos"), "agent", F.lit("a nation").alias("description"), "functions")
    spk = agents.sparkSession
    general = spk.createDataFrame([(0, "GeneralAgent", "general", ["GeneralAgent--getGeneralCapabilities"])], agents.schema)
    kept = F.array_sort(F.collect_list(F.when(F.col("p_size") % 7 != 0, F.concat_ws("--", "p_brand", "p_name"))))
    servers = p.filter("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("agent")).agg(kept.alias("functions"))
    servers = servers.select(F.lit(0).alias("pos"), "agent", F.lit("a server").alias("description"), F.when(F.size("functions") > 0, F.col("functions")).alias("functions"))
    return ops.agent_details(agents, general, servers)


_DETAILS = f"""{_TREE}, d AS (SELECT agent, 'a nation' AS description, list_sort(list(action)) AS functions FROM t GROUP BY ALL UNION ALL SELECT 'GeneralAgent', 'general', ['GeneralAgent--getGeneralCapabilities']
UNION ALL SELECT p_brand, 'a server', list_sort(list(p_brand || '--' || p_name)) FROM part WHERE p_partkey % 3 = 0 AND p_size % 7 <> 0 GROUP BY ALL)"""


@query("p8_agent_details", f"WITH {_DETAILS} SELECT agent, description, len(functions)::INT AS n, array_to_string(functions, '|') AS functions FROM d")
def details(spark, sf):
    return _details(spark, sf).select("agent", "description", F.size("functions").alias("n"), F.array_join("functions", "|").alias("functions"))


@query("p9_agents_as_tools", f"WITH {_DETAILS} SELECT agent AS name, description || chr(10) || chr(10) || 'Functions:' || chr(10) || '[' || array_to_string(list_transform(functions, lambda f: '''' || f || ''''), ', ') || ']' AS description FROM d")
def as_tools(spark, sf):
    return ops.agents_as_tools(_details(spark, sf))


@query("p10_without_id", "SELECT p_name, p_brand FROM part")
def without_id(spark, sf):
    t = load(spark, sf, "part").select(F.struct(F.col("p_partkey").alias("id"), "p_name", "p_brand").alias("tool"))
    return t.select(F.col("tool").dropFields("id").alias("tool")).select("tool.*")


def _containers(spark, sf):
    tree = _tree(spark, sf).filter("length(action) > 0")
    act = F.struct(F.col("action").alias("name"), "description")
    agents = tree.groupBy("container", "agent").agg(F.array_sort(F.collect_list(act)).alias("actions"))
    agents = agents.groupBy("container").agg(F.array_sort(F.collect_list(F.struct(F.col("agent").alias("agent_id"), "actions"))).alias("agents"))
    return agents.select(F.col("container").alias("container_id"), F.ascii("container").alias("pos"), "agents")


@query("s5_agent_actions", f"WITH {_TREE} SELECT agent, string_agg(action, ',' ORDER BY action) AS actions FROM t GROUP BY ALL")
def agent_actions(spark, sf):
    return ops.agent_actions(_containers(spark, sf)).select("agent", F.array_join("actions", ",").alias("actions"))


@query("j6_container_of", f"WITH {_TREE}, c AS (SELECT c_custkey, c_name AS action, (SELECT any_value(n_name) FROM nation WHERE n_nationkey = (c_nationkey + c_custkey % 2) % 25) AS agent FROM customer) SELECT c_custkey, container AS container_id FROM c LEFT JOIN t USING (agent, action)")
def container_of(spark, sf):
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation")
    c = c.withColumn("k", ((F.col("c_nationkey") + F.col("c_custkey") % 2) % 25).cast("int")).join(F.broadcast(n), F.col("k") == n.n_nationkey)  # 25 nations
    return ops.container_of(_containers(spark, sf), c.select("c_custkey", F.col("c_name").alias("action"), F.col("n_name").alias("agent"))).select("c_custkey", "container_id")


@query("j16_internal_lookup", "SELECT p_partkey, (SELECT min(q.p_partkey) FROM part AS q WHERE q.p_name = part.p_name) AS tool_pos FROM part")
def internal_lookup(spark, sf):
    p = load(spark, sf, "part")
    first = p.groupBy("p_name").agg(F.min_by("p_partkey", "p_partkey").alias("tool_pos"))
    return p.join(first, "p_name", "left").select("p_partkey", "tool_pos")


@query("j3_call_validation", """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, CASE WHEN l_quantity > 48 THEN 'none' ELSE 'F' || l_suppkey % 5 END AS name, l_suppkey % 5 AS s,
['a', 'b'] || CASE WHEN l_linenumber > 3 THEN ['c'] ELSE [] END || CASE WHEN l_returnflag = 'R' THEN ['zz'] ELSE [] END AS args FROM lineitem WHERE l_shipdate IS NOT NULL AND l_linestatus <> 'O')
SELECT call_id, name, name = 'none' AS unknown, CASE WHEN name = 'none' OR s < 3 OR list_contains(args, 'c') THEN '' ELSE 'c' END AS missing,
CASE WHEN name = 'none' THEN '' ELSE array_to_string(list_filter(args, lambda a: a = 'zz' OR (a = 'c' AND s < 3)), ',') END AS improper FROM c""")
def call_validation(spark, sf):
    l = load(spark, sf, "lineitem").filter("l_shipdate IS NOT NULL")
    empty = F.array().cast("array<string>")
    args = F.concat(F.array(F.lit("a"), F.lit("b")), F.when(F.col("l_linenumber") > 3, F.array(F.lit("c"))).otherwise(empty), F.when(F.col("l_returnflag") == "R", F.array(F.lit("zz"))).otherwise(empty))
    calls = l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.when(F.col("l_linestatus") == "O", "mcp").otherwise("remote").alias("type"),
        F.when(F.col("l_quantity") > 48, "none").otherwise(F.concat(F.lit("F"), (F.col("l_suppkey") % 5).cast("string"))).alias("name"), args.alias("args"),
    )
    tools = spark.createDataFrame([(i, f"F{i}", ["a"] + ["c"] * (i >= 3), ["a", "b"] + ["c"] * (i >= 3)) for i in range(5)], "pos int, name string, required array<string>, properties array<string>")
    return ops.validated(calls, tools).withColumns({c: F.array_join(c, ",") for c in ("missing", "improper")})


@query("s6_server_registration", """WITH r AS (SELECT page_id AS request_id, url AS server_url, replace(regexp_replace(url, '^.*//([^/]+).*$', '\\1'), '.', '-') AS server_label FROM pages),
u AS (SELECT *, min(request_id) OVER (PARTITION BY server_url) = request_id AS url_ok FROM r), l AS (SELECT server_label, min(request_id) AS f FROM u WHERE url_ok GROUP BY ALL)
SELECT request_id, server_url, server_label, CASE WHEN NOT url_ok THEN 'repeated address' WHEN request_id <> f THEN 'repeated label' ELSE 'ok' END AS status FROM u LEFT JOIN l USING (server_label)""")
def registration(spark, sf):
    r = load(spark, sf, "pages").select(F.col("page_id").alias("request_id"), F.col("url").alias("server_url"), F.lit("").alias("server_label"))
    return ops.registrations(r, r.limit(0))


@query("a8_extra_ports", "SELECT s_nationkey AS container_id, string_agg('http://h:' || s_suppkey || CASE WHEN s_nationkey % 2 = 0 THEN '?token=t' || s_nationkey ELSE '' END, ',' ORDER BY s_suppkey) AS ports FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY ALL")
def ports(spark, sf):
    s = load(spark, sf, "supplier")
    one = F.struct(F.col("s_suppkey").cast("string").alias("key"), F.struct(F.when(F.col("s_suppkey") % 3 > 0, "TCP").otherwise("UDP").alias("protocol")).alias("value"))
    c = s.groupBy(F.col("s_nationkey").alias("container_id")).agg(F.map_from_entries(F.collect_list(one)).alias("ports"))
    tokens = load(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("container_id"), F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("token"))
    out = ops.extra_ports(c, tokens, "http://h")
    return out.select("container_id", F.array_join(F.transform("ports", lambda p: p["address"]), ",").alias("ports"))


@query("a9_models_per_host", "SELECT n_regionkey AS host, string_agg(n_name, ',' ORDER BY n_nationkey) AS models FROM nation GROUP BY ALL")
def models(spark, sf):
    each = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return load(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("host")).agg(F.array_join(F.transform(each, lambda x: x["n_name"]), ",").alias("models"))


@query("f16_server_search", "SELECT DISTINCT p_brand AS server_label FROM part WHERE contains(lower(p_brand), '33') OR contains(lower(p_name), '33')")
def server_search(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_brand").alias("server_label"), F.col("p_name").alias("tool"))
    return ops.servers_found(p, " 33")


@query("x32_setting_name", "SELECT n_nationkey, 'VITE_' || upper(regexp_replace('apiKey' || n_name || 'x' || 'Yz', '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS name FROM nation")
def setting(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", tx.setting_name(F.concat(F.lit("apiKey"), "n_name", F.lit("xYz"))).alias("name"))
