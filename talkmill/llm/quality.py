"""Quality classifier: random-indexing word vectors, pooled per text, under a two-layer network.

Every raw word gives two units: its lower-cased letters and digits, and its shape (runs of capitals, small
letters, digits and each other sign; a word that repeats its predecessor has a shape of its own). A word's index
vector is sparse, ternary and fixed by its hash. The ``WORDS`` most frequent words and ``SHAPES`` most frequent shapes
of the labelled training texts have a context vector each: the sum of the index vectors of what stands beside them
in all texts, which Spark sums row by row with partial sums in each task. Any other word is its index vector,
whose ``NONZERO`` places no other word is likely to share; rarer shapes count as one. A text is the mean of its words'
and of its shapes' unit-length vectors, with two length features. Up to ``MAX_LABELLED`` labelled texts train the
network on the driver; a fifth of them is held back to fit the temperature that calibrates its probabilities.

Defined cases: null and word-less texts pool to zero vectors and are scored like any other; without
labels of both kinds every score is the share of good ones (0.5 without any label); labels that are null
teach nothing, a doc_id labelled twice counts as its larger label, one with several texts teaches its smallest;
repeated rows get equal results; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, fresh, text_bytes

#: Words and shapes with a context vector of their own: the most frequent ones of the labelled training texts.
WORDS, SHAPES = 16_000, 1_000
DIM, NONZERO = 64, 3
HIDDEN = 32
MAX_LABELLED = 20_000
CUT = 0.7
_CACHE = 1_000_000
#: Bytes of a word's letters and digits, lower-cased; the others are dropped.
_DROP = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CLASS = bytes(88 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 120 if 97 <= b <= 122 or b > 127 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_CODE = 6 * NONZERO + NONZERO  # bits of an index vector: its places and signs


def parts(raw: bytes) -> tuple[bytes, bytes]:
    """Letters and digits of a raw word, and its shape."""
    return raw.translate(_LOW, _DROP), _RUN.sub(rb"\1", raw.translate(_CLASS))


class Units(dict):
    """Raw word to a long: row of the word (0 of a rare one), row of its shape, and the word's hash, whose low bits code
    its index vector. Rows from 1 are words, after them shapes, the first of which stands for rare ones and the next
    for words that repeat the one before."""

    def __init__(self, words: list[bytes], shapes: list[bytes]):
        super().__init__()
        self.words = {w: i for i, w in enumerate(words, 1)}
        self.first = len(words) + 1
        self.repeat = self.first + 1
        self.shapes = {s: i for i, s in enumerate(shapes, self.first + 2)}
        self.rows = self.first + 2 + len(shapes)
        #: What codes the index vector of each row that is a shape's.
        self.codes = np.array([xxhash.xxh3_64_intdigest(b"shape %d" % i) & (2**_CODE - 1) for i in range(self.rows)], np.int64)

    def __missing__(self, raw: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        word, shape = parts(raw)
        row = self.words.get(word, 0) << 47 | self.shapes.get(shape, self.first) << 31
        unit = self[raw] = row | xxhash.xxh3_64_intdigest(word) & (2**31 - 1)
        return unit

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and rows of the text's words, and rows of their shapes."""
        raw = text.split()
        unit = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        words, shapes, hashes = unit >> 47, unit >> 31 & 0xFFFF, unit & (2**31 - 1)
        if len(unit) > 1:
            shapes[1:][unit[1:] == unit[:-1]] = self.repeat
        return hashes, words, shapes


def places(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places of index vectors that are not zero, and the signs there."""
    return [(codes >> 6 * j & 63, 1.0 - 2.0 * (codes >> 6 * NONZERO + j & 1)) for j in range(NONZERO)]


def _contexts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(*shared.value)
        total = np.zeros(units.rows * DIM)

        def add(rows: np.ndarray, codes: np.ndarray) -> None:
            for gap in (1, 2):
                for here, other in ((rows[:-gap], codes[gap:]), (rows[gap:], codes[:-gap])):
                    ok = (here > 0) & (other >= 0)
                    at, code = here[ok] * DIM, other[ok]
                    for where, sign in places(code):
                        total[:] += np.bincount(at + where, weights=sign, minlength=len(total))

        def both(run: list[tuple]) -> None:
            # words and shapes in turn, with a gap of two between texts
            size = sum(2 * len(w) + 2 for _, w, _ in run)
            rows, codes, at = np.zeros(size, np.int64), np.full(size, -1, np.int64), 0
            for hashes, words, shapes in run:
                end = at + 2 * len(words)
                rows[at:end:2], rows[at + 1 : end : 2] = words, shapes
                codes[at:end:2], codes[at + 1 : end : 2] = hashes & (2**_CODE - 1), units.codes[shapes]
                at = end + 2
            add(rows, codes)

        run_, size = [], 0
        for batch in batches:
            for t in batch["text"]:
                run_.append(units.of(t.as_py()))
                size += len(run_[-1][0])
                if size > 500_000:
                    both(run_)
                    run_, size = [], 0
        if run_:
            both(run_)
        table = total.reshape(units.rows, DIM)
        at = np.flatnonzero(table.any(1))
        if len(at):
            names = ["unit", *(f"d{i}" for i in range(DIM))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(table[at, i].astype(np.int64)) for i in range(DIM))], names=names)

    return run


def word_vectors(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]], text: str = "text") -> np.ndarray:
    """Unit-length context vectors of all rows, summed over all texts (at most WORDS + SHAPES + 3 reach the driver)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("unit", T.LongType()), *(T.StructField(f"d{i}", T.LongType()) for i in range(DIM))])
    sums = docs.select(text_bytes(text).alias("text")).mapInArrow(_contexts(shared), schema)
    table = sums.groupBy("unit").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIM))).toArrow()
    out = np.zeros((Units(*vocabulary).rows, DIM))
    if table.num_rows:
        out[table["unit"].to_numpy()] = np.stack([table[f"d{i}"].to_numpy() for i in range(DIM)], 1)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(text: bytes, units: Units, vectors: np.ndarray) -> np.ndarray:
    hashes, words, shapes = units.of(text)
    out = np.zeros(2 * DIM + 2, np.float32)
    if len(words):
        n = len(words)
        total = vectors[words[words > 0]].sum(0, dtype=np.float64)
        rare = hashes[words == 0]
        if len(rare):
            for where, sign in places(rare):
                total += np.bincount(where, weights=sign, minlength=DIM) / np.sqrt(NONZERO)
        out[:DIM] = total / n
        out[DIM : 2 * DIM] = vectors[shapes].mean(0)
        out[-2] = np.log1p(n) / 10
        out[-1] = len(np.unique(hashes)) / n
    return out


@dataclass
class Network:
    """Features to one logit: a tanh layer and a linear one, then the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 30) -> Network:
    """Adam on the log loss over four fifths of the rows; the temperature on the rest."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    width = 2 * DIM + 2
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 50 else order
    rest = order[len(y) // 5 :] if len(y) >= 50 else order
    net.mean, net.scale = x[rest].mean(0), x[rest].std(0) + 1e-3
    net.w1 = rng.normal(size=(width, HIDDEN)) / np.sqrt(width)
    net.w2 = rng.normal(size=HIDDEN) / np.sqrt(HIDDEN)
    xs, ys = (x[rest] - net.mean) / net.scale, y[rest]
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        mixed = rng.permutation(len(ys))
        for a in range(0, len(ys), 128):
            i = mixed[a : a + 128]
            h = np.tanh(xs[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - ys[i]) / len(i)
            dh = np.outer(d, p[2]) * (1 - h * h)
            g = [xs[i].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    z = net.logits(x[held])
    net.temperature = float(min(np.exp(np.linspace(np.log(0.25), np.log(8), 80)), key=lambda s: _loss(z / s, y[held])))
    return net


def taught(docs: DataFrame, labels: DataFrame, held_out, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """_id, _y and text of at most ``max_labelled`` labelled ids, chosen by a hash of the id, outside the held-out fold."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("_id", F.lit(17)), "_id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_bytes().alias("text"))
    return texts.join(F.broadcast(known), "_id").groupBy("_id", "_y").agg(F.min("text").alias("text"))


def vocabulary(rows: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The most frequent words and shapes of the (bounded) training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                raw.update(t.as_py().split())
        words, shapes = Counter(), Counter()
        for r, c in raw.items():
            w, s = parts(r)
            words[w] += c
            shapes[s] += c
        for kind, counted in ((0, words), (1, shapes)):
            if counted:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(counted), pa.int32()), pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], names=["kind", "unit", "c"]
                )

    sums = rows.select("text").mapInArrow(count, "kind int, unit binary, c long").groupBy("kind", "unit").agg(F.sum("c").alias("c"))
    top = lambda kind, n: [bytes(r["unit"]) for r in sums.filter(F.col("kind") == kind).orderBy(F.desc("c"), "unit").limit(n).collect()]
    return top(0, WORDS), top(1, SHAPES)


def fit(rows: DataFrame, shared) -> Network:
    """Trains on the rows of ``taught``; shared: vocabulary and vectors."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = shared.value
        units = Units(*words)
        for batch in batches:
            found = [pooled(t.as_py(), units, vectors).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_y"], pa.array(found, pa.binary())], names=["_id", "_y", "x"])

    found = rows.mapInArrow(pool, "_id long, _y int, x binary").collect()  # MAX_LABELLED rows at most
    found.sort(key=lambda r: r["_id"])
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found], dtype=np.float64).reshape(len(found), 2 * DIM + 2)
    return train(x, np.array([float(r["_y"]) for r in found]))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = CUT) -> DataFrame:
    """The documents' rows with quality_score and quality_ok after their own columns."""
    spark = docs.sparkSession
    names = docs.columns
    if {n.lower() for n in names} & {"quality_score", "quality_ok"}:
        raise ValueError("the documents have a column quality_score or quality_ok already")
    rows = taught(docs, labels, fold("doc_id", folds) == held)
    words = vocabulary(rows)
    vectors = word_vectors(docs, words)
    net = fit(rows, spark.sparkContext.broadcast((words, vectors)))
    model = spark.sparkContext.broadcast((net, words, vectors))
    at = [n.lower() for n in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words, own = model.value
        units = Units(*words)
        for batch in batches:
            if not batch.num_rows:
                continue
            # row by row, so that a batch's make-up changes no bit
            p = np.array([net.probability(pooled((t.as_py() or "").encode(), units, own).astype(np.float64)) for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(p >= cut)], names=[*names, "quality_score", "quality_ok"])

    schema = T.StructType([*docs.schema, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_ok", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    found = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, folds, held)
    return found.select(
        "doc_id", (fold("doc_id", folds) == held).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_ok").cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns, whatever they are called.

    Null and empty texts are scored like any other, repeated rows go or stay together, an empty table stays empty.
    """
    own = {"quality_score", "quality_ok"}
    narrow = docs.toDF(*(fresh(f"{c}_", docs.columns) if c.lower() in own else c for c in docs.columns))
    kept = scored(narrow, labels).filter("quality_ok").drop("quality_score", "quality_ok")
    return kept.toDF(*docs.columns)
