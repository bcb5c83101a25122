"""Session state as tables: upserts, expiry, summaries, approvals, sets of files, admin actions.

Every change is a function from old tables to new ones; the last write of a key wins by an explicit order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.window import Window

from .ranking import placed

#: Seconds a session lives after it was last seen.
LIFETIME = 30 * 24 * 3600
#: 2100-01-01 00:00 UTC, until when users' own sessions are valid.
FAR = 4102444800


def read_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Stored JSON documents (one a line) by schema, and those that do not fit it, kept apart instead of lost."""
    own = T.StructType([*T._parse_datatype_string(schema), T.StructField("_corrupt", T.StringType())])
    rows = spark.read.text(path).select(F.col("value"), F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    bad = F.col("d").isNull() | F.col("d._corrupt").isNotNull()
    return rows.filter(~bad).select("d.*").drop("_corrupt"), rows.filter(bad).select(F.col("value").alias("document"))


def by_key(docs: DataFrame, key: str, value) -> DataFrame:
    return docs.filter(F.col(key) == F.lit(value))


def upserted(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of old without those whose key new has, and for each key of new its last row (by ``order``)."""
    if order is not None:
        rest = F.struct(order, *[c for c in new.columns if c not in (order, key)])
        new = new.groupBy(key).agg(F.max(rest).alias("r")).select(key, "r.*").select(*new.columns)
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def deleted(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return docs.join(keys.select(key).distinct(), key, "left_anti")


def is_valid(valid_until: Column, now: Column) -> Column:
    return valid_until > now


def split_expired(sessions: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Sessions still valid, and those to purge (null times count as expired)."""
    ok = F.coalesce(is_valid(F.col("valid_until"), F.lit(now)), F.lit(False))
    return sessions.filter(ok), sessions.filter(~ok)


def seen_until(visits: DataFrame, key: str, at: str) -> DataFrame:
    """Until when each session is valid: its last visit and the lifetime, in epoch seconds."""
    return visits.groupBy(key).agg((F.unix_micros(F.max(F.col(at).cast("timestamp"))) / F.lit(1e6) + LIFETIME).alias("valid_until"))


def summaries(sessions: DataFrame, chats: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Admin view: names of chats and files, tasks as (query, interval, repetitions), expiry as ISO text."""
    listed = lambda t, *c: t.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", *c))).alias("l"))
    names = lambda t, name: listed(t, "name").select("session_id", F.transform("l", lambda x: x["name"]).alias(name))
    work = listed(tasks, "query", "interval", "repetitions").select("session_id", F.transform("l", lambda x: x.dropFields("pos")).alias("tasks"))
    until = F.date_format(F.timestamp_seconds("valid_until"), "yyyy-MM-dd'T'HH:mm:ss")
    out = sessions.select("session_id", until.alias("valid_until"))
    return out.join(names(chats, "chats"), "session_id", "left").join(names(files, "files"), "session_id", "left").join(work, "session_id", "left")


def top_id(counter: Column, ids: Column) -> Column:
    return F.greatest(counter, F.coalesce(F.max(ids), F.lit(0)))


def numbered_tasks(tasks: DataFrame, last: DataFrame) -> DataFrame:
    """New tasks of each session numbered on from its counter. tasks: session_id, pos; last: session_id, last_id."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    return tasks.join(last, "session_id", "left").withColumn("task_id", (F.coalesce("last_id", F.lit(0)) + n).cast("bigint")).drop("last_id")


def upsert_at_place(old: DataFrame, new: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """Rows replaced where they stand; new ones go to the end in the order of their keys."""
    kept = old.join(new.select(key), key, "left_anti")
    changed = new.join(old.select(key, pos), key)
    top = old.agg(F.coalesce(F.max(pos), F.lit(-1)).alias("_top"))  # one row
    added = placed(new.join(old.select(key), key, "left_anti"), key, name="_n")
    fresh = added.crossJoin(top).withColumn(pos, (F.col("_top") + 1 + F.col("_n")).cast(old.schema[pos].dataType)).drop("_top", "_n")
    return kept.unionByName(changed.select(old.columns)).unionByName(fresh.select(old.columns))


def get_or_create(chats: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chats, and an empty one for each wanted (session_id, chat_id) that is missing."""
    missing = wanted.select("session_id", "chat_id").distinct().join(chats, ["session_id", "chat_id"], "left_anti")
    return chats.unionByName(missing, allowMissingColumns=True)


def with_approvals(approvals: Column, changes: Column) -> Column:
    """container -> tool -> approval with changes of the same shape set into it."""
    merged = F.map_zip_with(
        F.coalesce(approvals, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<map<string,string>>"))),
        changes,
        lambda k, a, b: F.map_zip_with(
            F.coalesce(a, F.create_map().cast("map<string,string>")), F.coalesce(b, F.create_map().cast("map<string,string>")), lambda t, x, y: F.coalesce(y, x)
        ),
    )
    return merged


#: What an admin may do to a session.
ACTIONS = ("DELETE", "LOGOUT", "STOP_TASKS", "BLOCK", "UNBLOCK")


def administered(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """Sessions after admin actions (session_id, seq, action), in order: the last of BLOCK and UNBLOCK counts.

    sessions: session_id, user_id, n_tasks, blocked.
    """
    did = lambda a: F.bool_or(F.col("action") == a)
    last = F.max_by(F.col("action") == "BLOCK", F.when(F.col("action").isin("BLOCK", "UNBLOCK"), F.col("seq")))
    a = actions.groupBy("session_id").agg(did("DELETE").alias("_d"), did("LOGOUT").alias("_l"), did("STOP_TASKS").alias("_s"), last.alias("_b"))
    s = sessions.join(a, "session_id", "left").filter(~F.coalesce("_d", F.lit(False)))
    return s.select(
        "session_id", F.when(~F.coalesce("_l", F.lit(False)), F.col("user_id")).alias("user_id"),
        F.when(F.coalesce("_s", F.lit(False)), 0).otherwise(F.col("n_tasks")).cast("bigint").alias("n_tasks"), F.coalesce("_b", "blocked").alias("blocked"),
    )


def toggled(active: Column, off: Column, on: Column) -> Column:
    """A set of files without some and with others."""
    return F.array_union(F.array_except(active, off), on)


def user_sessions(logins: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each login's session: the user's first one, else a copy of the anonymous session, valid until FAR.

    logins: user_id, session_id (the anonymous one); sessions: session_id, pos, user_id, valid_until, blocked.
    """
    own = sessions.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min_by("session_id", "pos").alias("own_id"))
    l = logins.join(own, "user_id", "left").join(sessions.select("session_id", "blocked"), "session_id", "left")
    return l.select(
        "user_id", F.coalesce("own_id", F.concat_ws(":", "session_id", "user_id")).alias("user_session_id"), F.col("own_id").isNull().alias("created"),
        F.when(F.col("own_id").isNull(), F.col("session_id")).alias("original_session_id"), F.when(F.col("own_id").isNull(), F.lit(FAR)).cast("bigint").alias("valid_until"),
    )


def appended(responses: DataFrame, pushes: DataFrame) -> DataFrame:
    """Responses with push messages (chat_id, pos, task_id, query, content) behind each chat's last one."""
    last = responses.groupBy("chat_id").agg(F.max("response_idx").alias("_last"))
    n = F.row_number().over(Window.partitionBy("chat_id").orderBy("pos"))
    new = pushes.join(last, "chat_id", "left").withColumn("response_idx", (F.coalesce("_last", F.lit(-1)) + n).cast("bigint"))
    return responses.unionByName(new.select("chat_id", "response_idx", "query", "content", "task_id"), allowMissingColumns=True)
