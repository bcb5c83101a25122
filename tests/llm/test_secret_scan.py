import hashlib
import random
import re

from talkmill.llm import secret_scan as s


def base(text):
    """The three base kinds, as the contract words them."""
    out = []
    for i, (kind, p, ok) in enumerate([
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if ok(m)]
    return [x for _, _, x in sorted(out)]


def random_text(rng):
    parts = ["password", "TOKEN", "api_key", "apikey", "ſecret", "secret", "toKen", ":", "=", " ", '"', "'", "AKIA", "0123456789abcdef", "ABCDEFGHIJKLMN12", "abcdef", "é", "xoxb-12345678901", "-", "\n", "a" * 40]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(400)] + [None, "", "x" * 300_000, "0" * 100_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "token=abcdefghijkl", "y"), (3, texts[3], "z"), (3, texts[3], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    out = s.digest(s.scan(docs, str(tmp_path / "ledger"))).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), hashlib.sha256(",".join(base(t or "")).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in out) == want
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(texts):
        assert [x for x in by[i].spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")] == base(t or "")
        assert by[i].n_assign + by[i].n_access + by[i].n_hex == len(base(t or ""))
    assert any("slack" in r.spans for r in out)


def test_only_unseen_blobs_are_scanned(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", "token=abcdefghijkl"), ("b", "token=abcdefghijkl"), ("c", "plain")], "doc_id string, text string")
    s.update(first, path)
    assert s.read_ledger(spark, path, s.RULE_VERSION).count() == 2
    second = spark.createDataFrame([("d", "token=abcdefghijkl"), ("e", "hex 0123456789abcdef")], "doc_id string, text string")
    got = {r.doc_id: r.spans for r in s.digest(s.scan(second, path)).collect()}
    assert got == {"d": "assign:0:18", "e": "hex:4:20"}
    assert s.read_ledger(spark, path, s.RULE_VERSION).count() == 3
    s.update(second, path, rule_version=99)
    assert s.read_ledger(spark, path, 99).count() == 2


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.digest(s.scan(docs, str(tmp_path / "ledger"))).count() == 0


def test_a_second_run_over_one_ledger_scans_nothing(spark, tmp_path):
    import os

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / "ledger")
    files = lambda: sorted(f for f in os.listdir(f"{path}/rule_version={s.RULE_VERSION}") if f.startswith("part-"))
    first = sorted(map(str, s.digest(s.scan(docs, path)).collect()))
    blobs, before = s.read_ledger(spark, path, s.RULE_VERSION), files()
    n = blobs.count()
    assert n == docs.select(s._versions(docs, "text")).distinct().count()
    # one changed version of a path, all others as they were
    changed = docs.withColumn("text", s.F.when(s.F.col("doc_id") == 3, "token=abcdefghijklmn").otherwise(s.F.col("text")))
    assert sorted(map(str, s.digest(s.scan(docs, path)).collect())) == first
    again = [f for f in files() if f not in before]
    assert spark.read.schema(s.LEDGER).parquet(path).count() == n and sum(spark.read.parquet(f"{path}/rule_version={s.RULE_VERSION}/{f}").count() for f in again) == 0
    s.scan(changed, path)
    assert s.read_ledger(spark, path, s.RULE_VERSION).count() == n + 1
