"""Evaluation of tool-calling runs: matching expected with actual calls, metrics, summaries, comparisons."""

from __future__ import annotations

import gc
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import placed

EXACT, PARTIAL, NONE = "exact", "partial", "none"


#: Parsed texts that are kept in a Python worker, and the longest of them.
KEPT, KEPT_CHARS = 16_384, 256

_kept = lru_cache(KEPT)(json.loads)


def _parsed(text: str):
    """The text's JSON value, which may be shared: it is only read."""
    return _kept(text) if len(text) <= KEPT_CHARS else json.loads(text)


def arguments_match(actual: dict, expected: list[dict]) -> bool:
    """Whether a call's arguments are as expected.

    An argument that is not expected, a required one that is missing, or a value of another type (bool, int
    and float differ) fails. EXACT compares, PARTIAL looks for a text in any case (it fails for other types),
    NONE takes any value of the type. Of parameters expected twice the last counts, but all must be there.
    """
    by_key = {e["key"]: e for e in expected}
    if not actual.keys() <= by_key.keys():
        return False
    for e in expected:
        if not e["optional"] and e["key"] not in actual:
            return False
    for key, value in actual.items():
        e = by_key[key]
        want = _parsed(e["value"])
        if type(value) is not type(want):
            return False
        if e["match"] == EXACT:
            if value != want:
                return False
        elif e["match"] == PARTIAL:
            if not isinstance(want, str) or want.lower() not in value.lower():
                return False
        elif e["match"] != NONE:
            return False
    return True


def match_calls(expected: list[dict], actual: list[dict]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Greedy one-to-one matching of one question: (expected, actual) pairs, missed and extra, as list positions.

    Expected calls are taken by id (ties in order); each gets the first free actual call whose name contains its
    own and whose arguments match (those of a ``requestBody`` unwrapped). If then a call it depends on has not
    been matched, it stays unmatched. Unmatched calls that are optional, or that have an alternative group
    all matched, are not missed.
    """
    order = sorted(range(len(expected)), key=lambda i: expected[i]["id"])
    free = list(range(len(actual)))
    pairs, ids = [], set()
    for i in order:
        e = expected[i]
        for j in free:
            args = actual[j]["args"]
            if e["name"] not in actual[j]["name"]:
                continue
            if isinstance(args, dict) and args.get("requestBody"):
                args = args["requestBody"]
            if not isinstance(args, dict) or not arguments_match(args, e["args"]):
                continue
            if ids.issuperset(e["depends"]):
                pairs.append((i, j))
                ids.add(e["id"])
                free.remove(j)
            break
    taken = {i for i, _ in pairs}
    excused = lambda e: e["optional"] or any(g and all(x in ids for x in g) for g in e["alternatives"])
    missed = [i for i in order if i not in taken and not excused(expected[i])]
    return pairs, missed, free


MATCHES = "question_id long, kind string, expected_pos int, actual_pos int, name string"


def _plain(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _lists(column: pa.ListArray, items: Callable[[pa.Array], list]) -> list[list]:
    """A column of lists; null ones are empty."""
    ends = column.offsets.to_numpy()
    begins, ends = ends[:-1], np.where(column.is_valid().to_numpy(zero_copy_only=False), ends[1:], ends[:-1])
    inner = items(column.values)
    return [inner[i:j] for i, j in zip(begins.tolist(), ends.tolist())]


def _arguments(column: pa.StructArray) -> list[dict]:
    of = dict(zip((f.name for f in column.type), map(_plain, column.flatten())))
    return [{"key": k, "value": v, "match": m, "optional": o} for k, v, m, o in zip(of["key"], of["value"], of["match"], of["optional"])]


def _expected_calls(rows: pa.RecordBatch) -> list[dict]:
    ids = lambda c: _lists(c, _plain)
    cols = [_plain(rows[c]) for c in ("id", "name", "optional")] + [ids(rows["depends"]), _lists(rows["alternatives"], ids), _lists(rows["wanted"], _arguments)]
    return [{"id": i, "name": n, "optional": o, "depends": d, "alternatives": g, "args": a} for i, n, o, d, g, a in zip(*cols)]


def _actual_calls(rows: pa.RecordBatch) -> list[dict]:
    return [{"name": n, "args": _parsed(a) if a else {}} for n, a in zip(_plain(rows["name"]), _plain(rows["given"]))]


def _questions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[dict], list[dict]]]:
    """Each question with its expected and its actual calls. The rows come by question, expected calls first.

    A question may go on in the next batch. Without a question_id both sides stand for themselves.
    """
    last, want, done = (None, None), [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        told = batch["is_expected"]
        side, null = told.to_numpy(zero_copy_only=False), batch["question_id"].is_null().to_numpy(zero_copy_only=False)
        q = batch["question_id"].fill_null(0).to_numpy()
        new = np.flatnonzero((q[1:] != q[:-1]) | (null[1:] != null[:-1]) | (null[1:] & (side[1:] != side[:-1]))) + 1
        begins = np.concatenate(([0], new))
        ends = np.concatenate((new, [batch.num_rows]))
        of_side = np.concatenate(([0], np.cumsum(side)))
        expected, actual = _expected_calls(batch.filter(told)), _actual_calls(batch.filter(pa.array(~side)))
        e = of_side[np.concatenate(([0], ends))]
        a = np.concatenate(([0], ends)) - e
        e, a = e.tolist(), a.tolist()
        kinds = np.where(null[begins], side[begins] + 1, 0).tolist()
        for k, key in enumerate(zip(q[begins].tolist(), kinds)):
            own = expected[e[k] : e[k + 1]], actual[a[k] : a[k + 1]]
            if key == last:
                want += own[0]
                done += own[1]
                continue
            if want or done:
                yield None if last[1] else last[0], want, done
            last, (want, done) = key, own
    if want or done:
        yield None if last[1] else last[0], want, done


#: Rows of one batch of matches.
BATCH = 10_000


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["question_id", "kind", "expected_pos", "actual_pos", "name"])

    rows = []
    gc.disable()  # there are no cycles here, and collecting walks a batch's calls again and again
    try:
        for question, want, done in _questions(batches):
            pairs, missed, extra = match_calls(want, done)
            rows += [(question, "match", i, j, done[j]["name"]) for i, j in pairs]
            rows += [(question, "missed", i, None, want[i]["name"]) for i in missed]
            rows += [(question, "extra", None, j, done[j]["name"]) for j in extra]
            if len(rows) >= BATCH:
                yield told(rows)
                rows = []
        if rows:
            yield told(rows)
    finally:
        gc.enable()


def matched(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The matching of every question (a handful of calls each), one row per match, miss or extra call.

    expected: question_id, pos, id, name, optional, depends, alternatives, args; actual: question_id,
    iteration, pos, name, args (JSON). The calls of both sides go to their question in one shuffle and are sorted there;
    the matching itself, greedy and stateful, reads them question by question from Arrow columns.
    """
    question = F.col("question_id").cast("bigint").alias("question_id")
    e = expected.select(question, F.struct("pos", "id", "name", "optional", "depends", "alternatives", "args").alias("e"))
    a = actual.select(question, F.struct("iteration", "pos", "name", "args").alias("a"))
    # nulls come first, and an expected call has no a
    rows = e.unionByName(a, allowMissingColumns=True).repartition("question_id").sortWithinPartitions("question_id", "a", "e")
    calls = rows.select(
        "question_id", F.col("e").isNotNull().alias("is_expected"), "e.id", F.coalesce("e.name", "a.name").alias("name"), "e.optional", "e.depends", "e.alternatives",
        F.col("e.args").alias("wanted"), F.col("a.args").alias("given"),
    )
    return calls.mapInArrow(_matched, MATCHES)


def parameter_matches(calls: DataFrame) -> DataFrame:
    """Whether each call's arguments are as expected: the calls with ``fits``. calls: call_id, args (JSON) and expected
    (array<struct<key, value, match, optional>>). Calls are dealt out by call_id first, as a small file of many is read by few tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [arguments_match(_parsed(a) if a else {}, e) for a, e in zip(_plain(batch["args"]), _lists(batch["expected"], _arguments))]
            yield pa.RecordBatch.from_arrays([batch["call_id"], pa.array(fits, pa.bool_())], names=["call_id", "fits"])

    return calls.select(F.col("call_id").cast("bigint").alias("call_id"), "args", "expected").repartition("call_id").mapInArrow(run, "call_id long, fits boolean")


def agent_metrics(metrics: DataFrame, *keys: str) -> DataFrame:
    """Messages, tokens in and out and time by agent; counts that are not given are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return metrics.groupBy("agent", *keys).agg(
        F.count(F.lit(1)).alias("count"), F.sum(zero("input_tokens")).alias("tokens_in"), F.sum(zero("total_tokens") - zero("input_tokens")).alias("tokens_out"),
        F.sum("execution_time").alias("execution_time"),
    )


def question_tokens(messages: DataFrame) -> DataFrame:
    """Prompt, completion and total tokens, calls and iterations with calls by question.

    messages: question_id, meta map<string, bigint>, tools array (null counts as empty).
    """
    of = lambda k: F.sum(F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(0))).alias(k)
    n = F.coalesce(F.size("tools"), F.lit(0))
    n = F.when(F.col("tools").isNull(), 0).otherwise(n)
    return messages.groupBy("question_id").agg(
        of("prompt_tokens"), of("completion_tokens"), of("total_tokens"), F.sum(n).alias("calls"), F.count_if(n > 0).alias("iterations_with_calls")
    )


def summary(results: DataFrame, *keys: str, questions: int | None = None) -> DataFrame:
    """Correct (nothing missed) and perfect (nothing extra either) answers, sums and mean score by run (and further keys).

    results: method, model, missed, extra, tokens, time, server_time, score. ``questions`` is the size of the question
    set where that is more than the results.
    """
    n = F.count(F.lit(1))
    return results.groupBy(*keys, "method", "model").agg(
        (n if questions is None else F.lit(questions).cast("bigint")).alias("questions"),
        F.count_if(F.col("missed") == 0).alias("correct"), F.count_if((F.col("missed") == 0) & (F.col("extra") == 0)).alias("perfect"),
        F.sum("tokens").alias("tokens"), F.sum("time").alias("time"), F.sum("server_time").alias("server_time"),
        F.try_divide(F.sum(F.coalesce("score", F.lit(0))), n).alias("average_score"),
    )


def agent_time(results: DataFrame, *keys: str) -> DataFrame:
    """Time by run and agent; agents whose sum is not positive are left out. results: method, model, agent, time."""
    return results.groupBy(*keys, "method", "model", "agent").agg(F.sum("time").alias("time")).filter("time > 0")


def compared(new: DataFrame, old: DataFrame) -> DataFrame:
    """Runs in both summaries, as a report words the differences. The score's is the new one in percent of the old."""
    n, o = new.alias("n"), old.alias("o")
    both = n.join(o, ["method", "model"])
    share = lambda c: F.format_string("%.2f%%", (F.col(f"n.{c}") / F.col("n.questions") - F.col(f"o.{c}") / F.col("o.questions")) * 100)
    ratio = F.col("n.average_score") / F.col("o.average_score") * 100
    return both.select(
        "method", "model", share("correct").alias("correct_difference"), share("perfect").alias("perfect_difference"),
        F.format_string("%.2fs", F.col("n.time") - F.col("o.time")).alias("time_difference"),
        F.format_string("%d tokens", F.col("n.tokens") - F.col("o.tokens")).alias("token_difference"),
        F.when(F.col("o.average_score") != 0, F.round(ratio, 6)).alias("score_percent"),
    )


def only_new(new: DataFrame, old: DataFrame) -> DataFrame:
    """Runs that the old results lack."""
    return new.join(old, ["method", "model"], "left_anti").select("method", "model")


def agent_differences(new: DataFrame, old: DataFrame) -> DataFrame:
    """Time differences of agents in both runs."""
    both = new.withColumnRenamed("time", "new_time").join(old.withColumnRenamed("time", "old_time"), ["method", "model", "agent"])
    return both.select("method", "model", "agent", F.format_string("%.2fs", F.col("new_time") - F.col("old_time")).alias("time_difference"))


def chunked(questions: DataFrame, n: int, group: str) -> DataFrame:
    """Near-equal contiguous chunks (from 0) of each group's questions by ``pos``, a number; the first get one more."""
    sizes = questions.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_size"))
    rows = placed(questions, "pos", group, name="_place").join(sizes, F.col(group).eqNullSafe(F.col("_group")))
    each, more = F.floor(F.col("_size") / n), F.col("_size") % n
    # chunks 0 .. more - 1 hold each + 1 questions
    large = F.floor(F.col("_place") / (each + 1))
    small = more + F.floor((F.col("_place") - more * (each + 1)) / F.greatest(each, F.lit(1)))
    return rows.select(*questions.columns, F.when(F.col("_place") < more * (each + 1), large).otherwise(small).cast("bigint").alias("chunk"))


def portion(questions: DataFrame, percent: float, seed: int, key: str) -> DataFrame:
    """Exactly int(n * percent / 100) questions at random, the same for a seed: those whose key's hash is smallest.

    A histogram of the hashes' first digits (65,536 bins at most reach the driver) tells in which bin the last one lies;
    only that bin is sorted.
    """
    rows = questions.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_bin", F.substring("_hash", 1, 4))
    bins = sorted((r["_bin"], r["count"]) for r in rows.groupBy("_bin").count().collect())
    left = int(sum(n for _, n in bins) * percent / 100)
    border = ""
    for border, n in bins:
        if left <= n:
            break
        left -= n
    own = rows.filter(F.col("_bin") == border).orderBy("_hash").limit(left)
    return rows.filter(F.col("_bin") < border).unionByName(own).select(questions.columns)


def calls_by_iteration(calls: DataFrame) -> DataFrame:
    """question_id and a map of iteration to its calls without ids, in order."""
    each = calls.groupBy("question_id", "iteration").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "args"))).alias("t"))
    own = F.transform("t", lambda x: x.dropFields("pos"))
    pair = F.struct("iteration", own.alias("tools"))
    return each.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("iterations"))


def first_failure(calls: DataFrame) -> DataFrame:
    """By result: its first failed call, or a note where one of several calls has both ``<`` and ``>`` as argument names.

    calls: result_id, pos, name, result (text or null), arg_names.
    """
    failed = F.lower("result").rlike("error|failed|502")
    g = calls.groupBy("result_id").agg(
        F.min_by("name", F.when(failed, F.col("pos"))).alias("failed"),
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.array_contains("arg_names", "<") & F.array_contains("arg_names", ">")).alias("open"),
    )
    return g.select(
        "result_id",
        F.when(F.col("failed").isNotNull(), F.concat(F.lit("Found failed tool call: "), "failed"))
        .when((F.col("n") > 1) & F.col("open"), "Found unresolved placeholder").alias("problem"),
    )


def success_lines(calls: DataFrame) -> DataFrame:
    """By result: one line per tool whose result does not start with ``Failed``, in order."""
    good = F.coalesce(~F.col("result").startswith("Failed"), F.lit(True))
    lines = F.array_sort(F.collect_list(F.when(good, F.struct("pos", F.concat(F.lit("- Worker Agent Executed: "), "name", F.lit(".")).alias("line")))))
    return calls.groupBy("result_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("output"))


def rounds(tasks: DataFrame) -> DataFrame:
    """Tasks of each plan by round, ascending, in order. tasks: plan_id, round, pos, task."""
    return tasks.groupBy("plan_id", "round").agg(F.array_sort(F.collect_list(F.struct("pos", "task"))).alias("t")).select("plan_id", "round", F.transform("t", lambda x: x["task"]).alias("tasks"))
