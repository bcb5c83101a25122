"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items become automata over word ids, each over a block of ``BLOCK_WORDS`` words. Training
texts stream through an automaton word by word, which gives at each word the length of the longest match ending
there. A run of at least ``window`` words (or the whole of a shorter item) marks the words it covers.

One automaton at a time is in the driver and in the workers. With one block the texts are read once and nothing is
shuffled. With more, each block is a pass over the texts whose finds are written by text digest, and the passes
are put together by that digest; what an executor holds doesn't grow with the items.

Defined cases: a null or word-less text has no words and no hits; a null item or an item without
words never occurs; items that repeat an item_id count once,
those without one mark words but are not listed; repeated document rows each get
their own, equal, result; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, forget, shared_dir, stored, text_bytes

WINDOW = 13
#: Share of a text's words (1 in 20) from which the whole text counts as contaminated.
COVER = 20
#: Words of test items in one automaton; that bounds what is broadcast. More items make more passes.
BLOCK_WORDS = 150_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, annotated with items at window and short-item states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for i, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._annotate(coded)

    def _clone(self, p: int, c: int, q: int) -> int:
        k = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier item has this already
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _annotate(self, coded: list[tuple[str, list[int]]]) -> None:
        n, w = len(self.next), self.window
        #: The state that holds the last ``window`` words of a state's strings, or -1.
        self.tail = [-1] * n
        #: The nearest state up the links, itself included, at which a short item ends, or -1.
        self.short_at = [-1] * n
        self.window_items: dict[int, set[str]] = {}
        self.short_items: dict[int, dict[int, set[str]]] = {}
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in order:
            self.tail[v] = -1 if self.length[v] < w else v if self.length[self.link[v]] < w else self.tail[self.link[v]]
        for item, ids in coded:
            v = 0
            for k, c in enumerate(ids, 1):
                v = self.next[v][c]
                if k >= w:
                    self.window_items.setdefault(self.tail[v], set()).add(item)
            if len(ids) < w:
                while self.length[self.link[v]] >= len(ids):
                    v = self.link[v]
                self.short_items.setdefault(v, {}).setdefault(len(ids), set()).add(item)
        for v in order:
            self.short_at[v] = v if v in self.short_items else self.short_at[self.link[v]]

    def scan(self, words: list[bytes]) -> tuple[bytearray, set[str], int]:
        """Which words are hit, the items that occur, and the longest match."""
        hit, items, longest = bytearray(len(words)), set(), 0
        nxt, link, length, tail, short_at, w = self.next, self.link, self.length, self.tail, self.short_at, self.window
        v = n = 0
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                v = n = 0
                continue
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(c)
            if to is None:
                continue
            v, n = to, n + 1
            if n > longest:
                longest = n
            if n >= w:
                hit[i - w + 1 : i + 1] = b"\1" * w
                items |= self.window_items[tail[v]]
            s = short_at[v]
            while s > 0:
                for k, found in self.short_items[s].items():
                    if k <= n:
                        hit[i - k + 1 : i + 1] = b"\1" * k
                        items |= found
                s = short_at[link[s]]
        return hit, items, longest


def automata(items: DataFrame, window: int = WINDOW, block_words: int | None = None) -> Iterator[SuffixAutomaton]:
    """Automata one after another, each over at most ``block_words`` words (and one item at least)."""
    most = BLOCK_WORDS if block_words is None else block_words
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), text_bytes().alias("text")).distinct()
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        words = alnum_words(bytes(text))
        if block and size + len(words) > most:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
        block.append((item_id, words))
        size += len(words)
    if block:
        yield SuffixAutomaton(block, window)


def _spans(hit: bytearray) -> list[tuple[int, int]]:
    """Runs of hit words as (first, end)."""
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out.append((at, end))
        at = hit.find(1, end)
    return out


REPORT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("word_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("longest_match", T.LongType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


_PART = "key binary, spans array<array<long>>, items array<string>, longest long"


def _pass(shared: Broadcast):
    """What one automaton finds in each text that shares a word with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                hit, found, longest = shared.value.scan(alnum_words(text.as_py()))
                if longest:
                    rows.append((key.as_py(), _spans(hit), list(found), longest))
            types = [pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.int64()]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "spans", "items", "longest"])

    return run


def _scanned(docs: DataFrame, text: str, items: DataFrame, window: int, block_words: int | None, use, schema) -> DataFrame:
    """docs.mapInArrow(use(look), schema), where look(batch, i, words) gives hit words, items and the longest match of a row.

    Column names are the caller's to keep apart from ``key``, ``spans``, ``items`` and ``longest``.
    """
    spark = docs.sparkSession
    blocks = automata(items, window, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(first or SuffixAutomaton([], window))
        return docs.mapInArrow(use(lambda batch, i, words: shared.value.scan(words)), schema)

    folder = f"{shared_dir(spark)}/decontamination-{uuid.uuid4().hex}"
    key = F.unhex(F.md5(text_bytes(text)))
    texts = docs.select(key.alias("key"), text_bytes(text).alias("text"))
    for block in itertools.chain([first, second], blocks):
        shared = spark.sparkContext.broadcast(block)
        texts.mapInArrow(_pass(shared), _PART).write.mode("append").parquet(f"{folder}/passes")
        shared.destroy()
    # equal texts have equal rows in a pass, which the sets keep once
    found = spark.read.schema(_PART).parquet(f"{folder}/passes").groupBy("key").agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.max("longest").alias("longest")
    )
    found = stored(spark, found, folder, "found")
    forget(spark, f"{folder}/passes")

    def look(batch: pa.RecordBatch, i: int, words: list[bytes]) -> tuple[bytearray, set, int]:
        hit = bytearray(len(words))
        for a, b in batch["spans"][i].as_py() or []:
            hit[a:b] = b"\1" * (b - a)
        return hit, set(batch["items"][i].as_py() or []), batch["longest"][i].as_py() or 0

    return docs.withColumn("key", key).join(found, "key", "left").drop("key").mapInArrow(use(look), schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, cover: int = COVER, block_words: int | None = None) -> DataFrame:
    """One row per document row: hit words as spans, the items that occur, the longest match."""

    def use(look):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for i, text in enumerate(batch["body"]):
                    words = alnum_words(text.as_py())
                    hit, found, longest = look(batch, i, words)
                    n = hit.count(1)
                    ids = sorted(x for x in found if x is not None)
                    rows.append((len(words), n, len(ids), ids, _spans(hit) if n else [], longest, n > 0 and cover * n >= len(words)))
                cols = list(zip(*rows)) if rows else [()] * 7
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types))], names=REPORT.names)

        return scan

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return _scanned(rows, "body", items, window, block_words, use, REPORT)


def digest(report: DataFrame) -> DataFrame:
    return report.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def without_spans(text: str, hit_spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words; what stands between words of a run goes with it."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, end in hit_spans:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, cover: int = COVER, block_words: int | None = None) -> DataFrame:
    """The documents without contaminated ones (the coverage limit); from the others matching spans go (the length limit).

    All columns stay as they are, whatever they are called, but for the text of a document that loses a span and,
    where there is one, its ``n_chars``. Null, empty and word-less texts stay, repeated rows fare alike, an empty
    benchmark changes nothing, an empty table stays empty.
    """
    names = [n.lower() for n in docs.columns]
    plain = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(p, f.dataType, f.nullable) for p, f in zip(plain, docs.schema)])
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def use(look):
        def scrub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, new = [], {}
                for i, text in enumerate(batch.column(at)):
                    text = text.as_py()
                    words = alnum_words((text or "").encode())
                    hit, _, _ = look(batch, i, words)
                    n = hit.count(1)
                    keep.append(not (n and cover * n >= len(words)))
                    if n and keep[-1]:
                        new[i] = without_spans(text, _spans(hit))
                out = batch.columns[: len(plain)]
                if new:
                    for column, value in ((at, lambda t: t), (size, len)):
                        if column is not None:
                            values = out[column].to_pylist()
                            for i, text in new.items():
                                values[i] = value(text)
                            out[column] = pa.array(values, out[column].type)
                yield pa.RecordBatch.from_arrays(out, names=plain).filter(pa.array(keep, pa.bool_()))

        return scrub

    return _scanned(docs.toDF(*plain), plain[at], items, window, block_words, use, schema).toDF(*docs.columns)


def oracle(window: int = WINDOW, cover: int = COVER) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = lambda k: f"list_transform(range(greatest(len(w) - {k} + 1, 0)), lambda i: struct_pack(pos := i, g := array_to_string(w[(i + 1)::INT:(i + {k})::INT], ' ')))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT item_id, least({window}, len(w)) AS n, w FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[(i + 1)::INT:(i + n)::INT], ' '))) AS g FROM bw),
dg AS (SELECT k, {window} AS n, unnest({grams(window)}) AS x FROM d
    UNION ALL SELECT k, s.n, unnest({grams("s.n")}) FROM d, (SELECT DISTINCT n FROM bw WHERE n < {window}) AS s),
h AS (SELECT k, x.pos AS pos, bg.n AS n, item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.x.g = bg.g),
c AS (SELECT k, count(DISTINCT p) AS hit FROM (SELECT k, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY k),
i AS (SELECT k, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(hit, 0) > 0 AND {cover} * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN i USING (k)"""
