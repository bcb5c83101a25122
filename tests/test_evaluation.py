import json
import random

from talkmill.operators import evaluation as ev
from talkmill.operators.ranking import placed


def slow_match(expected, actual):
    """The matching, told the long way round: sets of positions instead of lists that shrink."""

    def fits(e, a):
        args = a["args"].get("requestBody") or a["args"]
        want = {}
        for p in e["args"]:
            want[p["key"]] = (json.loads(p["value"]), p["match"])
        need = {p["key"] for p in e["args"] if not p["optional"]}
        if set(args) - set(want) or need - set(args):
            return False
        for k, v in args.items():
            w, how = want[k]
            same_type = type(v) is type(w)
            ok = {"exact": v == w, "partial": isinstance(w, str) and isinstance(v, str) and w.lower() in v.lower(), "none": True}[how]
            if not (same_type and ok):
                return False
        return True

    used, done, pairs = set(), set(), {}
    for _, i in sorted((e["id"], i) for i, e in enumerate(expected)):
        e = expected[i]
        j = next((j for j, a in enumerate(actual) if j not in used and e["name"] in a["name"] and fits(e, a)), None)
        if j is None or not set(e["depends"]) <= done:
            continue
        used.add(j)
        done.add(e["id"])
        pairs[i] = j
    missed = {i for i, e in enumerate(expected) if i not in pairs and not e["optional"] and not any(g and set(g) <= done for g in e["alternatives"])}
    return set(pairs.items()), missed, set(range(len(actual))) - used


def case(rng):
    values = [1, 1.0, True, "Text", "text", ["a"], {"k": 1}]
    arg = lambda: {"key": rng.choice("xyz"), "value": json.dumps(rng.choice(values)), "match": rng.choice(["exact", "partial", "none"]), "optional": rng.random() < 0.3}
    expected = [
        {"id": rng.choice([-1, *range(6)]), "name": rng.choice(["GetRoom", "GetRoomId", "Set"]), "optional": rng.random() < 0.2, "depends": rng.sample(range(6), rng.choice([0, 0, 1])),
         "alternatives": [rng.sample(range(6), rng.randrange(3)) for _ in range(rng.choice([0, 0, 1, 2]))], "args": [arg() for _ in range(rng.randrange(3))]}
        for _ in range(rng.randrange(5))
    ]
    args = lambda: {k: rng.choice(values) for k in rng.sample("xyz", rng.randrange(3))}
    actual = [{"name": "a--" + rng.choice(["GetRoomId", "GetRoomIds", "Set", "getroom"]), "args": rng.choice([args(), {"requestBody": args()}])} for _ in range(rng.randrange(6))]
    return expected, actual


def test_matching_equals_the_slow_one():
    rng = random.Random(17)
    seen = 0
    for _ in range(4000):
        expected, actual = case(rng)
        pairs, missed, extra = ev.match_calls(expected, actual)
        want = slow_match(expected, actual)
        assert (set(pairs), set(missed), set(extra)) == want
        seen += len(pairs)
    assert seen > 300


def test_types_and_partial():
    one = lambda v, m="exact", o=False: [{"key": "x", "value": json.dumps(v), "match": m, "optional": o}]
    assert ev.arguments_match({"x": 1}, one(1)) and not ev.arguments_match({"x": 1.0}, one(1)) and not ev.arguments_match({"x": True}, one(1))
    assert ev.arguments_match({"x": "Big Room"}, one("room", "partial")) and not ev.arguments_match({"x": ["a"]}, one(["a"], "partial"))
    assert ev.arguments_match({"x": "other"}, one("room", "none")) and not ev.arguments_match({}, one(1)) and ev.arguments_match({}, one(1, o=True))
    assert not ev.arguments_match({"x": 1, "y": 2}, one(1))


def test_matching_over_tables(spark):
    e = spark.createDataFrame(
        [(1, 0, 0, "Get", False, [], None, [("x", "1", "exact", False)]), (1, 1, 1, "Set", False, [0], [[5]], []), (2, 0, 0, "Get", False, None, None, None)],
        "question_id long, pos int, id int, name string, optional boolean, depends array<int>, alternatives array<array<int>>, args array<struct<key: string, value: string, match: string, optional: boolean>>",
    )
    a = spark.createDataFrame([(1, 0, 0, "a--GetIt", '{"x": 1}'), (1, 1, 0, "a--Other", "{}"), (3, 0, 0, "z", None)], "question_id long, iteration int, pos int, name string, args string")
    got = {tuple(r) for r in ev.matched(e, a).collect()}
    assert got == {(1, "match", 0, 0, "a--GetIt"), (1, "missed", 1, None, "Set"), (1, "extra", None, 1, "a--Other"), (2, "missed", 0, None, "Get"), (3, "extra", None, 0, "z")}


def told(question, expected, actual):
    """The rows of match_calls of one question."""
    pairs, missed, extra = ev.match_calls(expected, actual)
    name = lambda rows, i: rows[i]["name"]
    rows = [(question, "match", i, j, name(actual, j)) for i, j in pairs] + [(question, "missed", i, None, name(expected, i)) for i in missed]
    return rows + [(question, "extra", None, j, name(actual, j)) for j in extra]


def test_matching_over_tables_equals_that_of_each_question(spark):
    """Whatever way the rows come and wherever the batches end; questions without an id keep their sides apart."""
    rng = random.Random(23)
    cases = {q: case(rng) for q in range(60)} | {1000: (case(rng)[0], []), 1001: ([], case(rng)[1])}
    alone = ({"id": 0, "name": "Set", "optional": False, "depends": [], "alternatives": [], "args": []}, {"name": "Set", "args": {}})
    want = [r for q, (e, a) in cases.items() for r in told(q, e, a)] + told(None, [alone[0]], []) + told(None, [], [alone[1]])
    cases[None] = ([alone[0]], [alone[1]])
    e = [(q, k, x["id"], x["name"], x["optional"], x["depends"] or None, x["alternatives"] or None, [tuple(p[c] for c in ("key", "value", "match", "optional")) for p in x["args"]] or None) for q, (es, _) in cases.items() for k, x in enumerate(es)]
    a = [(q, k // 2, k % 2, x["name"], json.dumps(x["args"]) if x["args"] else None) for q, (_, xs) in cases.items() for k, x in enumerate(xs)]
    rng.shuffle(e)
    rng.shuffle(a)
    e = spark.createDataFrame(e, "question_id long, pos int, id int, name string, optional boolean, depends array<int>, alternatives array<array<int>>, args array<struct<key: string, value: string, match: string, optional: boolean>>")
    a = spark.createDataFrame(a, "question_id long, iteration int, pos int, name string, args string")
    key = lambda r: tuple((v is not None, v) for v in r)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in (before, 3, 1):
            spark.conf.set(size, n)
            assert sorted(map(tuple, ev.matched(e, a).collect()), key=key) == sorted(want, key=key)
    finally:
        spark.conf.set(size, before)
    assert ev.matched(e.limit(0), a.limit(0)).count() == 0 and {r.kind for r in ev.matched(e.limit(0), a).collect()} == {"extra"}


def test_both_sides_of_a_matching_meet_in_one_shuffle(spark):
    """No arrays of calls are built, shuffled and joined before they are matched."""
    e = spark.createDataFrame([], "question_id long, pos int, id int, name string, optional boolean, depends array<int>, alternatives array<array<int>>, args array<struct<key: string, value: string, match: string, optional: boolean>>")
    a = spark.createDataFrame([], "question_id long, iteration int, pos int, name string, args string")
    p = ev.matched(e, a)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange") == 1 and "Join" not in p and "collect_list" not in p


def test_parameters_over_a_table_are_dealt_out(spark):
    rng = random.Random(5)
    calls = [(k, a, p) for k in range(300) for e, xs in [case(rng)] for a, p in [(json.dumps(xs[0]["args"]) if xs and k % 7 else None, e[0]["args"] if e else None)]]
    want = {k: ev.arguments_match(json.loads(a) if a else {}, p or []) for k, a, p in calls}
    rows = [(k, a, p and [tuple(x[c] for c in ("key", "value", "match", "optional")) for x in p]) for k, a, p in calls]
    df = spark.createDataFrame(rows, "call_id long, args string, expected array<struct<key: string, value: string, match: string, optional: boolean>>")
    got = ev.parameter_matches(df)
    assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.call_id: r.fits for r in got.collect()} == want and len(set(want.values())) == 2


def test_comparison_leaves_out_zero_scores(spark):
    s = "method string, model string, questions long, correct long, perfect long, tokens long, time double, server_time double, average_score double"
    new = spark.createDataFrame([("a", "m", 4, 3, 1, 10, 2.5, 1.0, 4.0), ("b", "m", 1, 1, 1, 1, 1.0, 1.0, 1.0)], s)
    old = spark.createDataFrame([("a", "m", 4, 2, 1, 30, 1.0, 1.0, 0.0)], s)
    assert tuple(ev.compared(new, old).first())[2:] == ("25.00%", "0.00%", "1.50s", "-20 tokens", None)
    assert [r.method for r in ev.only_new(new, old).collect()] == ["b"]


def test_portion_is_exact_and_repeats(spark):
    q = spark.range(41)
    for percent, n in ((30, 12), (0, 0), (100, 41), (1, 0)):
        assert ev.portion(q, percent, 1, "id").count() == n
    assert sorted(ev.portion(q, 30, 1, "id").collect()) == sorted(ev.portion(q.repartition(3), 30, 1, "id").collect())
    assert ev.portion(q.limit(0), 30, 1, "id").count() == 0
    sizes = [r["count"] for r in ev.chunked(q.selectExpr("id AS pos", "1 AS g"), 5, "g").groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [9, 8, 8, 8, 8]


def test_places_of_large_and_small_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aaab") if i % 50 else None, x) for i, x in enumerate(rng.sample(range(-5000, 5000), 3000))] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    got = {(r.g, r.x): r.place for r in placed(df, "x", "g", name="place", ranges=16).collect()}
    for g in ("a", "b", "c", None):
        mine = sorted((x for k, x in rows if k == g), key=lambda x: (x is not None, x))
        assert [got[g, x] for x in mine] == list(range(len(mine)))
    assert sorted(r.place for r in placed(df.filter("x is not null"), "x", name="place").collect()) == list(range(3000))
    assert placed(df.limit(0), "x", name="place").count() == 0
    texts = df.filter("x is not null").selectExpr("concat(coalesce(g, 'é'), repeat('~', abs(x) % 4), hex(x)) AS t").distinct()
    assert [r.t for r in placed(texts, "t", name="place", ranges=16).orderBy("place").collect()] == sorted((r.t for r in texts.collect()), key=str.encode)
    for n in (1, 7, 4000):
        sizes = [r["count"] for r in ev.chunked(df.filter("g = 'a'").withColumnRenamed("x", "pos"), n, "g").groupBy("chunk").count().orderBy("chunk").collect()]
        total = sum(sizes)
        assert sizes == [total // n + (i < total % n) for i in range(min(n, total))]
