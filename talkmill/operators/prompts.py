"""Prompt libraries, play books, translations and settings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import text as tx

PROMPTS = "lang string, cat_pos int, id string, header string, icon string, visible boolean, is_default boolean, q_pos int, question string, q_icon string"
LIBRARY = "map<string, array<struct<id: string, header: string, icon: string, visible: boolean, is_default: boolean, questions: array<struct<question: string, icon: string>>>>>"


def read_library(spark: SparkSession, override: str, base: str) -> DataFrame:
    """The prompts of the override file, or where there is none of the base file, one row per question."""
    for path in (override, base):
        try:
            rows = spark.read.text(path, wholetext=True)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) or path == base:
                raise
            continue
        return unnest_library(rows.select(F.from_json("value", LIBRARY).alias("library")))
    raise AssertionError


def unnest_library(rows: DataFrame) -> DataFrame:
    by_lang = rows.select(F.explode("library").alias("lang", "cats"))
    cats = by_lang.select("lang", F.posexplode("cats").alias("cat_pos", "c"))
    asked = cats.select("lang", "cat_pos", "c", F.posexplode("c.questions").alias("q_pos", "q"))
    return asked.select(
        "lang", "cat_pos", "c.id", "c.header", "c.icon", F.coalesce("c.visible", F.lit(True)).alias("visible"),
        F.coalesce("c.is_default", F.lit(False)).alias("is_default"), "q_pos", "q.question", F.col("q.icon").alias("q_icon"),
    )


def nest_library(prompts: DataFrame) -> DataFrame:
    """One JSON document of all languages, as libraries are saved."""
    q = F.array_sort(F.collect_list(F.struct("q_pos", "question", F.col("q_icon").alias("icon"))))
    cats = prompts.groupBy("lang", "cat_pos", "id", "header", "icon", "visible", "is_default").agg(q.alias("q"))
    cat = F.struct("cat_pos", "id", "header", "icon", "visible", "is_default", F.transform("q", lambda x: F.struct(x["question"].alias("question"), x["icon"].alias("icon"))).alias("questions"))
    langs = cats.groupBy("lang").agg(F.array_sort(F.collect_list(cat)).alias("c"))
    langs = langs.select("lang", F.transform("c", lambda c: c.dropFields("cat_pos")).alias("c"))
    return langs.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "c"))))).alias("value"))


def with_icons(prompts: DataFrame) -> DataFrame:
    """A question's own icon, else its category's."""
    return prompts.withColumn("shown_icon", F.coalesce("q_icon", "icon"))


def found(prompts: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """Questions with every word of the query, of all or one category."""
    rows = prompts if category in (None, "none") else prompts.filter(F.col("header") == category)
    return rows.filter(tx.holds_all_words(F.col("question"), query))


def picked(prompts: DataFrame, query: str | None, category: str | None = None, k: int = 3, seed: int = 0) -> DataFrame:
    """The first k questions found, or without a query k at random (seeded)."""
    if query:
        return found(prompts, query, category).orderBy("lang", "cat_pos", "q_pos").limit(k)
    rows = prompts if category in (None, "none") else prompts.filter(F.col("header") == category)
    return rows.orderBy(F.rand(seed)).limit(k)


def reset(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """Defaults, then the user's own categories of the same languages; languages without defaults go."""
    own = user.filter(~F.col("is_default")).join(defaults.select("lang").distinct(), "lang", "left_semi")
    return defaults.withColumn("source", F.lit(0)).unionByName(own.withColumn("source", F.lit(1)))


def translated(keys: DataFrame, texts: DataFrame, language: str, fallback: str) -> DataFrame:
    """The text in the language, else in the fallback, else a note; %n filled from ``args``.

    keys: key, args array<string>; texts: lang, key, text.
    """
    own = texts.filter(F.col("lang") == language).select("key", F.col("text").alias("own"))
    other = texts.filter(F.col("lang") == fallback).select("key", F.col("text").alias("other"))
    both = keys.join(own, "key", "left").join(other, "key", "left")
    raw = F.coalesce(F.nullif("own", F.lit("")), F.nullif("other", F.lit("")))
    return both.select("key", F.coalesce(tx.numbered(raw, F.col("args")), F.concat(F.lit("[UNKNOWN: "), "key", F.lit("]"))).alias("text"))


def enabled_play_books(play_books: DataFrame) -> DataFrame:
    """Enabled ones by name, in any case."""
    return play_books.filter("enabled").orderBy(F.lower("name"), "pos")


def layered(*settings: Column) -> Column:
    """The first setting that is given: query parameter, cookie, environment, default."""
    return F.coalesce(*settings)


def violations(config: DataFrame, rules: DataFrame) -> DataFrame:
    """Settings that break a rule, and keys that no rule knows.

    config: method, key, value (text); rules: method, key, kind (integer, number, string, boolean), least, most,
    step, pattern, choices (array<string>).
    """
    c = config.join(rules, ["method", "key"], "left")
    number, v = F.col("value").try_cast("double"), F.col("value")
    problem = (
        F.when(F.col("kind").isNull(), "unknown key")
        .when(v.isNull(), "no value")
        .when((F.col("kind") == "integer") & v.try_cast("bigint").isNull(), "wrong type")
        .when((F.col("kind") == "number") & number.isNull(), "wrong type")
        .when((F.col("kind") == "boolean") & ~F.lower(v).isin("true", "false"), "wrong type")
        .when(number < F.col("least"), "too small")
        .when(number > F.col("most"), "too large")
        .when(F.abs(number / F.col("step") - F.round(number / F.col("step"))) > 1e-9, "not a multiple")
        .when(F.col("pattern").isNotNull() & ~F.regexp_like(v, F.col("pattern")), "wrong format")
        .when(F.size("choices") > 0, F.when(~F.array_contains("choices", v), "no such choice"))
    )
    return c.select("method", "key", "value", problem.alias("problem")).filter("problem IS NOT NULL")


def supported_parameters(calls: DataFrame, support: DataFrame) -> DataFrame:
    """Model parameters without those that a model (by the longest listed prefix of its name) does not take.

    calls: model, params map; support: prefix, dropped array<string>. The support table is small by nature.
    """
    c = calls.withColumn("_row", F.monotonically_increasing_id())
    fits = c.join(support, F.col("model").startswith(F.col("prefix")), "left")
    best = fits.groupBy("_row").agg(F.first("model").alias("model"), F.first("params").alias("params"), F.max_by("dropped", F.length("prefix")).alias("dropped"))
    return best.select("model", F.map_filter("params", lambda k, _: ~F.coalesce(F.array_contains("dropped", k), F.lit(False))).alias("params"))


def host_models(hosts: str, keys: str, models: str) -> Column:
    """array<struct<host, key, models>> of the three settings, cut to the shortest of them."""
    parts = [F.split(F.lit(s), ";") for s in (hosts, keys, models)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("host", "key", "models"))))
    whole = F.slice(zipped, F.lit(1), F.least(*(F.size(p) for p in parts)))
    return F.transform(whole, lambda z: F.struct(z["host"].alias("host"), z["key"].alias("key"), F.split(z["models"], ",").alias("models")))


def configured(config: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings (method, key, value) with changes set into them."""
    return config.join(changes.select("method", "key"), ["method", "key"], "left_anti").unionByName(changes.select("method", "key", "value"))


def reset_config(config: DataFrame, defaults: DataFrame, method: str) -> DataFrame:
    """The method's settings as by default; other methods' stay."""
    return config.filter(F.col("method") != method).unionByName(defaults.filter(F.col("method") == method).select("method", "key", "value"))


def schema_of(settings: type) -> dict:
    """The JSON schema of a dataclass of settings; fields without a default are required."""
    import dataclasses

    kinds = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}
    fields = dataclasses.fields(settings)
    given = lambda f: f.default is not dataclasses.MISSING or f.default_factory is not dataclasses.MISSING
    hints = {f.name: f.type if isinstance(f.type, type) else {k.__name__: k for k in kinds}.get(str(f.type), str) for f in fields}
    props = {f.name: {"type": kinds.get(hints[f.name], "string")} | ({"default": f.default} if f.default is not dataclasses.MISSING else {}) for f in fields}
    return {"type": "object", "properties": props, "required": [f.name for f in fields if not given(f)]}
