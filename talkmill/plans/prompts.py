"""Queries over prompts, play books, translations and settings; nations and parts stand for their entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import schedule as sc
from talkmill.functions import text as tx
from talkmill.operators import files
from talkmill.operators import prompts as ops
from talkmill.sources.tables import load

from .base import query


@query("f3_enabled_play_books", "SELECT n_name AS name FROM nation WHERE n_regionkey % 2 = 0")
def play_books(spark, sf):
    n = load(spark, sf, "nation")
    return ops.enabled_play_books(n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), (F.col("n_regionkey") % 2 == 0).alias("enabled"))).select("name")


@query("l7_play_book_order", "SELECT n_name AS name, row_number() OVER (ORDER BY lower(n_name), n_nationkey)::INT AS rank FROM nation WHERE n_regionkey % 2 = 0")
def play_book_order(spark, sf):
    """The order of a user's (few) play books, numbered."""
    from pyspark.sql.window import Window

    n = load(spark, sf, "nation").withColumn("user", F.lit(1)).filter("n_regionkey % 2 = 0")
    return n.select(F.col("n_name").alias("name"), F.row_number().over(Window.partitionBy("user").orderBy(F.lower("n_name"), "n_nationkey")).alias("rank"))


def _prompts(spark, sf):
    p = load(spark, sf, "part")
    return p.select(
        F.element_at(F.array(*map(F.lit, ("de", "en", "fr"))), (F.col("p_size") % 3 + 1).cast("int")).alias("lang"), (F.col("p_size") % 5).alias("cat_pos"), F.col("p_brand").alias("id"), F.col("p_type").alias("header"),
        F.col("p_brand").alias("icon"), (F.col("p_size") % 2 == 0).alias("visible"), (F.col("p_size") % 4 < 2).alias("is_default"), F.col("p_partkey").alias("q_pos"), F.col("p_name").alias("question"),
        F.when(F.col("p_size") % 6 == 0, F.lit("own")).alias("q_icon"),
    )


@query("f17_visible_sections", "SELECT p_partkey AS q_pos FROM part WHERE p_size % 2 = 0")
def visible(spark, sf):
    return _prompts(spark, sf).filter("visible").select("q_pos")


@query("j15_question_icons", "SELECT p_partkey AS q_pos, CASE WHEN p_size % 6 = 0 THEN 'own' ELSE p_brand END AS icon FROM part")
def icons(spark, sf):
    return ops.with_icons(_prompts(spark, sf)).select("q_pos", F.col("shown_icon").alias("icon"))


@query("j13_reset_prompts", """SELECT 0 AS source, p_partkey AS q_pos FROM part WHERE p_size % 4 < 2 AND p_size % 3 < 2
UNION ALL SELECT 1, p_partkey FROM part WHERE NOT p_size % 4 < 2 AND p_size % 3 IN (SELECT p_size % 3 FROM part WHERE p_size % 4 < 2 AND p_size % 3 < 2)""")
def reset(spark, sf):
    p = _prompts(spark, sf)
    return ops.reset(p.filter("is_default AND lang <> 'fr'"), p).select("source", "q_pos")


@query("x34_numbered_text", "SELECT n_nationkey, n_name || '-' || n_regionkey || ' %3 ' || n_name || ' %0' AS text FROM nation")
def numbered(spark, sf):
    args = F.array("n_name", F.col("n_regionkey").cast("string"))
    return load(spark, sf, "nation").select("n_nationkey", tx.numbered(F.lit("%1-%2 %3 %1 %0"), args).alias("text"))


@query("x35_translated", """SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'Hallo ' || n_nationkey WHEN n_nationkey % 2 = 0 THEN 'Hello ' || n_nationkey ELSE '[UNKNOWN: ' || n_name || ']' END AS text FROM nation""")
def translated(spark, sf):
    n = load(spark, sf, "nation")
    of = lambda lang, d, t: n.filter(F.col("n_nationkey") % d == 0).select(F.lit(lang).alias("lang"), F.col("n_name").alias("key"), F.lit(t).alias("text"))
    keys = n.select(F.col("n_name").alias("key"), F.array(F.col("n_nationkey").cast("string")).alias("args"))
    return ops.translated(keys, of("de", 3, "Hallo %1").unionByName(of("en", 2, "Hello %1")), "de", "en")


@query("f9_supported_parameters", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_brand LIKE 'Brand#1%' THEN '' ELSE 'temperature=1,' END || 'id=' || p_partkey AS params FROM part")
def supported(spark, sf):
    calls = load(spark, sf, "part").select(F.col("p_brand").alias("model"), F.create_map(F.lit("id"), F.col("p_partkey").cast("string"), F.lit("temperature"), F.lit("1")).alias("params"))
    support = spark.createDataFrame([("Brand", []), ("Brand#1", ["temperature"])], "prefix string, dropped array<string>")
    out = ops.supported_parameters(calls, support)
    return out.select(F.element_at("params", "id").alias("id"), F.concat(F.when(F.map_contains_key("params", "temperature"), "temperature=1,").otherwise(""), F.lit("id="), F.element_at("params", "id")).alias("params"))


@query("f19_config_violations", """SELECT p_partkey::VARCHAR AS method, key, value, problem FROM (SELECT p_partkey, 'rounds' AS key, p_size::VARCHAR AS value, CASE WHEN p_size < 5 THEN 'too small' WHEN p_size > 40 THEN 'too large' END AS problem FROM part
UNION ALL SELECT p_partkey, 'name', p_brand, 'wrong format' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]') UNION ALL SELECT p_partkey, 'x', 'y', 'unknown key' FROM part) WHERE problem IS NOT NULL""")
def violations(spark, sf):
    p = load(spark, sf, "part").withColumn("m", F.col("p_partkey").cast("string"))
    row = lambda k, v: p.select(F.col("m").alias("method"), F.lit(k).alias("key"), v.alias("value"))
    config = row("rounds", F.col("p_size").cast("string")).unionByName(row("name", F.col("p_brand"))).unionByName(row("x", F.lit("y")))
    rule = lambda k, kind, least, most, pattern: p.select(
        F.col("m").alias("method"), F.lit(k).alias("key"), F.lit(kind).alias("kind"), F.lit(least).cast("double").alias("least"), F.lit(most).cast("double").alias("most"), F.lit(1.0).alias("step"),
        F.lit(pattern).cast("string").alias("pattern"), F.array().cast("array<string>").alias("choices"),
    )
    rules = rule("rounds", "integer", 5, 40, None).unionByName(rule("name", "string", None, None, "^Brand#[1-3]"))
    return ops.violations(config, rules)


@query("s13_host_models", "SELECT * FROM (VALUES ('h1', 'k1', 'a,b'), ('h2', 'k2', 'c')) AS t(host, key, models)")
def host_models(spark, sf):
    t = spark.range(1).select(F.explode(ops.host_models("h1;h2;h3", "k1;k2", "a,b;c;d")).alias("h"))
    return t.select("h.host", "h.key", F.array_join("h.models", ",").alias("models"))


@query("x31_layered_setting", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'query' WHEN n_nationkey % 2 = 0 THEN 'cookie' ELSE 'env' END AS value FROM nation")
def layered(spark, sf):
    k = F.col("n_nationkey")
    return load(spark, sf, "nation").select("n_nationkey", ops.layered(F.when(k % 3 == 0, "query"), F.when(k % 2 == 0, "cookie"), F.lit("env")).alias("value"))


@query("x19_innermost_error", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'outer' WHEN 1 THEN 'middle' ELSE event_type END AS message FROM events")
def innermost(spark, sf):
    one = F.col("event_id") % 3
    inner = F.format_string('{"message": "outer", "cause": {"message": "middle", "cause": {"message": "%s"}}}', F.col("event_type"))
    error = F.when(one == 0, '{"message": "outer"}').when(one == 1, '{"message": "outer", "cause": {"message": "middle"}}').otherwise(inner)
    return load(spark, sf, "events").select("event_id", tx.innermost_message(error).alias("message"))


@query("x15_logged_calls", "SELECT event_id, event_id || '. ' || event_type || ': go( x: ' || user_id || ') → r' AS line FROM events")
def logged(spark, sf):
    text = F.format_string("Tool: %d\nAgent: %s\nAction: go\nArguments:\n- x: %d\n\nResult: r", F.col("event_id"), F.col("event_type"), F.col("user_id"))
    return load(spark, sf, "events").select("event_id", tx.logged_call(text).alias("line"))


@query("x29_local_date", "SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%d.%m.%Y %H:%M:%S') AS text FROM events")
def local_date(spark, sf):
    """In winter, so Berlin is an hour ahead of UTC throughout."""
    return load(spark, sf, "events").select("event_id", sc.local_text(F.col("ts").cast("timestamp"), "Europe/Berlin", "dd.MM.yyyy HH:mm:ss").alias("text"))


@query("x27_current_time", "SELECT event_id, 'The current date and time is ' || strftime(ts + INTERVAL 1 HOUR, '%B %d %Y, %H:%M') || CASE WHEN event_id % 2 = 0 THEN '. You are located at Hall ' || event_id % 5 || '.' ELSE '.' END AS text FROM events")
def current_time(spark, sf):
    """Of the clock and the place that each row gives."""
    e = load(spark, sf, "events")
    place = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Hall "), (F.col("event_id") % 5).cast("string")))
    return e.select("event_id", sc.time_and_place(F.col("ts").cast("timestamp"), "Europe/Berlin", place).alias("text"))


@query("x12_last_expression", "SELECT event_id, 'a = ' || event_id || chr(10) || '_result = a + 1' AS code FROM events")
def last_expression(spark, sf):
    code = F.format_string("a = %d\na  +  1  # so", F.col("event_id"))
    return files.returned(load(spark, sf, "events").select("event_id", code.alias("code")), "event_id")


@query("x18_pretty_json", "SELECT event_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS text FROM events")
def pretty(spark, sf):
    return load(spark, sf, "events").select("event_id", tx.pretty_json(F.col("props")).alias("text"))


@query("m5_configured", "SELECT n_name AS method, 'k' AS key, CASE WHEN n_nationkey % 4 = 0 THEN 'new' ELSE n_regionkey::VARCHAR END AS value FROM nation")
def configured(spark, sf):
    n = load(spark, sf, "nation")
    c = n.select(F.col("n_name").alias("method"), F.lit("k").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return ops.configured(c, n.filter("n_nationkey % 4 = 0").select(F.col("n_name").alias("method"), F.lit("k").alias("key"), F.lit("new").alias("value")))
