"""Queries over files, addresses and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import text as tx
from talkmill.operators import files as ops
from talkmill.sources.tables import load

from .base import query

_SEARCH = "tion the"


@query("f13_prompt_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the')")
def prompt_search(spark, sf):
    return load(spark, sf, "documents").filter(tx.holds_all_words(F.col("text"), _SEARCH)).select("doc_id")


@query("l4_prompt_pick", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the') ORDER BY doc_id LIMIT 3")
def prompt_pick(spark, sf):
    return load(spark, sf, "documents").filter(tx.holds_all_words(F.col("text"), _SEARCH)).orderBy("doc_id").limit(3).select("doc_id")


@query("x3_first_excerpt", """SELECT doc_id, CASE WHEN p = 0 THEN text ELSE CASE WHEN p > 41 THEN '…' ELSE '' END
|| substr(text, greatest(p - 41, 0)::INT + 1, (least(length(text), p - 1 + 3 + 40) - greatest(p - 41, 0))::INT) || CASE WHEN p - 1 + 43 < length(text) THEN '…' ELSE '' END END AS context
FROM (SELECT doc_id, text, instr(lower(text), 'ion') AS p FROM documents)""")
def first_excerpt(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.first_excerpt(F.col("text"), "ion").alias("context"))


@query("x7_server_label", "SELECT page_id, replace(regexp_replace(url, '^.*//([^/]+).*$', '\\1'), '.', '-') AS label FROM pages")
def label(spark, sf):
    return load(spark, sf, "pages").select("page_id", tx.server_label(F.col("url")).alias("label"))


@query("x8_web_address", "SELECT page_id, regexp_matches(url, '^https?://') AS ok FROM pages")
def web_address(spark, sf):
    return load(spark, sf, "pages").select("page_id", tx.is_web_address(F.col("url")).alias("ok"))


_MIME = "CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'IMAGE/JPEG; q=1' WHEN 2 THEN 'text/csv' END"


@query("x9_file_name", f"""SELECT page_id, CASE WHEN b = '' THEN 'file' ELSE regexp_replace(b, '\\.[^.]*$', '') END ||
CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' ELSE '.bin' END AS file_name
FROM (SELECT page_id, regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$', 1), '([^/;]*)(?:;[^/]*)?$', 1) AS b FROM pages)""")
def file_name(spark, sf):
    return load(spark, sf, "pages").select("page_id", tx.file_name(F.col("url"), F.expr(_MIME)).alias("file_name"))


_NAME = "CASE doc_id % 6 WHEN 0 THEN 'a' || doc_id || '.PDF' WHEN 1 THEN 'b.tar.jpeg' WHEN 2 THEN 'notes.md' WHEN 3 THEN 'run.py' WHEN 4 THEN 'plain' END"


@query("x10_renamed", f"SELECT doc_id, 'new' || regexp_extract({_NAME}, '.(\\.[^.]+)$', 1) AS file_name FROM documents")
def renamed(spark, sf):
    """Files without a name get none."""
    return load(spark, sf, "documents").select("doc_id", tx.renamed(F.lit("new"), F.expr(_NAME)).alias("file_name"))


@query("f6_file_kind", f"SELECT doc_id, regexp_matches(coalesce({_NAME}, ''), '(?i)\\.pdf$') AS pdf, regexp_matches(coalesce({_NAME}, ''), '(?i)\\.(png|jpe?g|gif|webp)$') AS image FROM documents")
def file_kind(spark, sf):
    n = F.expr(_NAME)
    return load(spark, sf, "documents").select("doc_id", tx.is_pdf(n).alias("pdf"), tx.is_image(n).alias("image"))


_BODY = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN text || chr(11) WHEN 2 THEN chr(8) || text ELSE text END"


@query("f8_text_sniff", f"""SELECT doc_id, octet_length(h) = 0 OR (try(decode(h)) IS NOT NULL AND NOT regexp_matches(coalesce(try(decode(h)), ''), '[\\x00-\\x08\\x0B\\x0E-\\x1F]')) AS is_text
FROM (SELECT doc_id, encode({_BODY})[1:4096] AS h FROM documents)""")
def text_sniff(spark, sf):
    """The sample is the feature: the first 4,096 bytes of every body, and a character that they cut in two counts."""
    body = F.expr(_BODY.replace("chr(11)", "char(11)").replace("chr(8)", "char(8)"))
    return load(spark, sf, "documents").select("doc_id", tx.looks_textual(body.cast("binary")).alias("is_text"))


_TICKS = "text || repeat('`', (doc_id % 6)::INT) || chr(13) || chr(10) || 'x``y'"
_MARK = "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all({}, '`+'), lambda r: length(r))), 0) + 1)::INT)"


def _ticks():
    return F.expr(_TICKS.replace("chr(", "char("))


@query("x16_fence", f"SELECT doc_id, {_MARK.format(_TICKS)} AS fence FROM documents")
def fence(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.fence(_ticks()).alias("fence"))


@query("x17_unix_newlines", f"SELECT doc_id, replace({_TICKS}, chr(13) || chr(10), chr(10)) AS text FROM documents")
def newlines(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.unix_newlines(_ticks()).alias("text"))


@query("s14_text_ingestion", f"""SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN f || 'python' || chr(10) || t || chr(10) || f ELSE t END AS content FROM
(SELECT doc_id, t, {_MARK.format("t")} AS f FROM (SELECT doc_id, replace({_TICKS}, chr(13) || chr(10), chr(10)) AS t FROM documents))""")
def ingestion(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.ingested(F.coalesce(F.expr(_NAME), F.lit("")), _ticks()).alias("content"))


@query("x30_preview", """SELECT doc_id, CASE WHEN length(p) > 240 THEN p[:237] || '...' ELSE p END AS preview FROM (SELECT doc_id,
array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 0)[1:3], chr(10)) AS p FROM documents)""")
def preview(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


_BRACKETS = "text || '[name]' || doc_id || ' [a b] [] [name]'"


@query("x33_placeholders", f"SELECT doc_id, array_to_string(regexp_extract_all({_BRACKETS}, '\\[[^\\]]+\\]'), '|') AS found FROM documents")
def placeholders(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.array_join(tx.placeholders(F.expr(_BRACKETS)), "|").alias("found"))


@query("x20_filled_placeholders", f"""SELECT doc_id, list_reduce(list_concat([b], regexp_extract_all(b, '\\[[^\\]]+\\]')), lambda t, k:
CASE WHEN k IN ('[name]', '[a b]') AND instr(t, k) > 0 THEN substr(t, 1, instr(t, k) - 1) || CASE k WHEN '[name]' THEN 'Ann' ELSE 'c' END || substr(t, instr(t, k) + length(k)) ELSE t END) AS text
FROM (SELECT doc_id, {_BRACKETS} AS b FROM documents)""")
def filled(spark, sf):
    values = F.create_map(F.lit("[name]"), F.lit("Ann"), F.lit("[a b]"), F.lit("c"))
    return load(spark, sf, "documents").select("doc_id", tx.filled(F.expr(_BRACKETS), values).alias("text"))


@query("x5_model_host", "SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS host FROM pages")
def model_host(spark, sf):
    return load(spark, sf, "pages").select("page_id", tx.model_host(F.col("url")).alias("host"))


_TOOL = "replace(p_brand, '#', '--') || '--' || p_name"


@query("x6_split_tool_name", f"SELECT p_partkey, split_part({_TOOL}, '--', 1) AS provider, substr({_TOOL}, instr({_TOOL}, '--') + 2) AS tool FROM part")
def split_tool_name(spark, sf):
    n = F.expr(_TOOL)
    return load(spark, sf, "part").select("p_partkey", tx.provider(n).alias("provider"), tx.tool(n).alias("tool"))


_REPLY = "CASE WHEN doc_id % 2 = 0 THEN 'Sure:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'and ```x```' ELSE text END"


@query("x11_code_block", f"""SELECT doc_id, regexp_replace(CASE WHEN regexp_matches(r, '(?s)```(python)?\\s*\\n.*?```') THEN regexp_extract(r, '(?s)```(?:python)?\\s*\\n(.*?)```', 1) ELSE r END, '^\\s+|\\s+$', '', 'g') AS code
FROM (SELECT doc_id, {_REPLY} AS r FROM documents)""")
def code_block(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.code_block(F.expr(_REPLY.replace("chr(", "char("))).alias("code"))


@query("x14_braced_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def braced(spark, sf):
    told = F.concat(F.lit("Here: "), "props", F.lit(" - done."))
    return load(spark, sf, "events").select("event_id", F.get_json_object(tx.braced(told), "$.k").cast("bigint").alias("k"))


@query("x13_reply_action", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS agent, CASE WHEN event_id % 3 > 0 THEN 'go' END AS action FROM events")
def reply_action(spark, sf):
    body = F.to_json(F.struct(F.col("event_type").alias("agentId"), F.when(F.col("event_id") % 3 > 0, F.lit("go")).alias("action"), F.struct("value").alias("params")))
    a = tx.reply_action(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return load(spark, sf, "events").select("event_id", a["agentId"].alias("agent"), a["action"].alias("action"))


@query("x28_cookies", "SELECT event_id, event_type || '=x' AS session, user_id::VARCHAR AS \"user\" FROM events")
def cookies(spark, sf):
    head = F.concat(F.lit("user=0; session="), "event_type", F.lit("=x; bare; user="), F.col("user_id").cast("string"))
    c = tx.cookies(head)
    return load(spark, sf, "events").select("event_id", F.try_element_at(c, F.lit("session")).alias("session"), F.try_element_at(c, F.lit("user")).alias("user"))


@query("s8_first_uploads", "SELECT source AS session_id, lang || n_chars % 7 AS file_name, min(doc_id) AS seq FROM documents GROUP BY ALL")
def first_uploads(spark, sf):
    t = load(spark, sf, "documents").select(
        F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.concat("lang", (F.col("n_chars") % 7).cast("string")).alias("file_name"), "n_chars"
    )
    return ops.first_uploads(t).select("session_id", "file_name", "seq")


_HOSTS = "CASE WHEN doc_id % 3 = 0 THEN 'h1' WHEN doc_id % 3 = 1 THEN 'h2' END"


def _files(spark, sf):
    t = load(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.expr(_NAME).alias("file_name"), F.expr(_HOSTS).alias("host"))
    hosts = F.when(F.col("host").isNotNull(), F.create_map("host", F.col("file_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return t.select("file_id", "file_name", hosts.alias("host_ids"))


@query("f7_unsent_files", f"""SELECT doc_id AS file_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id % 3 <> 0
AND regexp_matches(coalesce({_NAME}, ''), '(?i)\\.(pdf|png|jpe?g|gif|webp)$')""")
def unsent(spark, sf):
    active = load(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("file_id"))
    return ops.unsent(_files(spark, sf), active, "h1").select("file_id")


@query("j1_message_parts", f"""SELECT doc_id AS file_id, CASE WHEN regexp_matches(coalesce({_NAME}, ''), '(?i)\\.(png|jpe?g|gif|webp)$') THEN 'input_image' ELSE 'input_file' END AS type, doc_id::VARCHAR AS host_file_id
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id % 3 = 0""")
def message_parts(spark, sf):
    active = load(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("file_id"))
    return ops.message_parts(_files(spark, sf), active, "h1")
