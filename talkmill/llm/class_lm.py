"""Language-model scoring with Brown classes.

Training texts are those outside the held-out fold. Units are the ``FREQUENT`` most frequent words, the
end of a text, and ``BUCKETS`` buckets that share out all other words by their last bytes; so every word,
seen or not, has a unit and by it a first class. Exchange clustering moves units between ``CLASSES`` classes as
long as the likelihood of the class bigrams rises; it works on the unit bigrams of all training texts,
which Spark counts. Then every word but the frequent ones gets the class in which the words beside it in all
training texts are likeliest, by counts of its own; a bucket's class is left to words never seen. The class
bigrams are counted again over these classes. A text's probability is the product over its tokens of

    P(class | class before) * P(word | class)

both smoothed: transitions back off to the classes' shares, emissions add ``ADD`` to every count, with one
more place per class for its unseen words, so each distribution sums to one.

Word counts are kept for the whole vocabulary. Tasks hold those of the ``HOT`` most frequent words, which is a
fixed bound, as a word of more than ``LONG`` bytes goes by a digest; the counts of all rarer words are joined to the
texts by a shuffle, with their classes. So no word is left out at any size. What is gathered for a word from all
tasks is added up row by row as it streams past, never collected.

Defined cases: null and empty texts consist of their end alone; without training texts all counts are 0;
repeated rows are scored each (and count each in training); a null doc_id hashes as the empty text; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blank_words, fold, forget, shared_dir, stored, text_bytes

FREQUENT, BUCKETS, CLASSES = 1000, 200, 48
HOT, LONG = 150_000, 64
ADD = 0.5
SWEEPS = 8
#: A token that no word can be, as it is a blank.
END = b"\n"
_FLUSH, _PIECE = 300_000, 300_000
#: What begins the digest of a long word, and the number of a hot one: bytes that no UTF-8 text holds.
_DIGEST, _NUMBER = b"\xff", b"\xfe"


def tokens(text: bytes) -> list[bytes]:
    """The text's words, long ones by their digests."""
    words = blank_words(text)
    if max(map(len, words), default=0) > LONG:
        words = [w if len(w) <= LONG else _DIGEST + hashlib.blake2b(w, digest_size=16).digest() for w in words]
    return words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    counts: Counter = Counter()
    for batch in batches:
        for t in batch["text"]:
            counts.update(tokens(t.as_py()))
            if len(counts) > _FLUSH:
                yield out(counts)
                counts = Counter()
        counts[END] += batch.num_rows
    if counts:
        yield out(counts)


def most_frequent(counts: DataFrame, n: int) -> pa.Table:
    """The n words of the largest counts, ties by the word, in that order.

    Histograms of the counts, first by their logarithms and then of the bin where the n-th lies, tell which counts are in,
    so only the words that tie with the n-th are sorted, and no task gets more than n words of each other one.
    """
    rows = counts.withColumn("_bin", F.floor(F.log2("c") * 16))

    def border(key: str, of: DataFrame, above: int) -> tuple[int | None, int]:
        for r in sorted(of.groupBy(key).count().collect(), reverse=True):
            if above + r["count"] > n:
                return r[key], above
            above += r["count"]
        return None, above

    edge, above = border("_bin", rows, 0)
    top = counts
    if edge is not None:
        least, above = border("c", rows.filter(F.col("_bin") == edge), above)
        ties = counts.filter(F.col("c") == least).orderBy("word").limit(n - above)
        top = counts.filter(F.col("c") > least).unionByName(ties)
    return top.toArrow().sort_by([("c", "descending"), ("word", "ascending")])


class Units(dict):
    """Word to unit: its own where frequent (or the end), else that of its ending."""

    def __init__(self, frequent: list[bytes], buckets: int = BUCKETS):
        super().__init__({w: i for i, w in enumerate(frequent)})
        self.own, self.buckets = len(frequent), buckets

    def __missing__(self, word: bytes) -> int:
        return self.own + xxhash.xxh3_64_intdigest(word[-3:]) % self.buckets

    @property
    def size(self) -> int:
        return self.own + self.buckets


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _encode(shared: Broadcast):
    """Texts as indexes of hot words, -1 for others, which stand beside them in order with their units; the end of the
    text is index 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, units = shared.value
        index = _Index((w, i) for i, w in enumerate(words))
        unit = Units(units)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids, tails, ends = [], [], [0]
                for t in part["text"]:
                    own = tokens(t.as_py())
                    at = np.fromiter(map(index.__getitem__, own), np.int32, len(own))
                    tails += [own[i] for i in np.flatnonzero(at < 0)]
                    ends.append(len(tails))
                    ids += [at, np.zeros(1, np.int32)]
                starts = np.cumsum([0, *(len(x) + 1 for x in ids[::2])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(ids)))
                ends = pa.array(np.array(ends, np.int32))
                tail = pa.ListArray.from_arrays(ends, pa.array(tails, pa.binary()))
                of = pa.ListArray.from_arrays(ends, pa.array(np.fromiter(map(unit.__getitem__, tails), np.int32, len(tails))))
                yield pa.RecordBatch.from_arrays([part["uid"], part["doc_id"], part["held_out"], ids, tail, of], names=["uid", "doc_id", "held_out", "ids", "tail", "unit"])

    return run


_CODED = "uid long, doc_id long, held_out boolean, ids array<int>, tail array<binary>, unit array<int>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded texts in pieces of about ``_PIECE`` tokens, or of one text: what bounds the memory of the arrays made of them."""
    for batch in batches:
        ends, a = batch["ids"].offsets.to_numpy(), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _PIECE, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _sequence(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of a batch one after another, and where each text's begin."""
    sizes = np.diff(batch["ids"].offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return batch["ids"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), starts


def _labelled(flat: np.ndarray, of_hot: np.ndarray, of_tail: np.ndarray) -> np.ndarray:
    out = of_hot[flat]
    out[flat < 0] = of_tail
    return out


def _units(batch: pa.RecordBatch) -> np.ndarray:
    return batch["unit"].flatten().to_numpy(zero_copy_only=False)


def _count_pairs(of_hot: Broadcast, size: int, units: bool):
    """Pairs of units; or of classes, and then only of hot neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        hot = of_hot.value
        for batch in _pieces(batches):
            flat, _ = _sequence(batch)
            seq = _labelled(flat, hot, _units(batch) if units else -1)
            seq = np.concatenate([hot[:1], seq])
            a, b = seq[:-1], seq[1:]
            both = (a >= 0) & (b >= 0)
            total += np.bincount(a[both] * size + b[both], minlength=size * size)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "c"])

    return run


def _square(pairs: DataFrame, size: int) -> np.ndarray:
    cells = pairs.groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # at most the square of the size
    n = np.zeros(size**2)
    n[cells["pair"].to_numpy()] = cells["c"].to_numpy()
    return n.reshape(size, size)


def _neighbours(shared: Broadcast, k: int):
    """Of each word but the frequent: how often each class stands before it (cells under k) and after it. Hot words go by
    their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unit_of, of = shared.value
        first, keys, size, local = len(unit_of), [], 0, {}

        def out() -> pa.RecordBatch:
            key, c = np.unique(np.concatenate(keys), return_counts=True)
            word = key // (2 * k)
            at = np.flatnonzero(np.diff(word, prepend=-1))
            rare = list(local)
            names = [_NUMBER + int(w).to_bytes(4, "big") if w < first else rare[w - first] for w in word[at]]
            ends = pa.array(np.concatenate([at, [len(key)]]).astype(np.int32))
            cells = pa.ListArray.from_arrays(ends, pa.array((key % (2 * k)).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), cells, pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int64)))], names=["word", "cell", "c"])

        for batch in _pieces(batches):
            flat, _ = _sequence(batch)
            units = _labelled(flat, unit_of, _units(batch))
            cls = of[units]
            word = flat.copy()
            word[flat < 0] = [first + local.setdefault(w, len(local)) for w in batch["tail"].flatten().to_pylist()]
            at = np.flatnonzero(units >= own)
            before = np.concatenate([of[unit_of[:1]], cls[:-1]])
            keys += [word[at] * (2 * k) + before[at], word[at] * (2 * k) + k + cls[at + 1]]  # a text's end follows every word
            size += 2 * len(at)
            if size > 3_000_000:
                yield out()
                keys, size, local = [], 0, {}
        if size:
            yield out()

    return run


def _choose(pairs: np.ndarray):
    """The class in which each word's neighbours are likeliest; class 0 is the end's alone. Rows come sorted by word."""
    k = len(pairs)
    step, sums = transitions(pairs), pairs.sum(0)

    def chosen(words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        gain = n[:, :k] @ step + n[:, k:] @ step.T - n[:, :k].sum(1)[:, None] * np.log10(np.maximum(sums, 1))[None, :]
        gain[:, (sums == 0) | (np.arange(k) == 0)] = -np.inf
        return pa.RecordBatch.from_arrays([words, pa.array(np.argmax(np.round(gain, 6), 1).astype(np.int64))], names=["word", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the last word so far and its sums
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                words = part["word"]
                new = np.ones(len(words), bool)
                if len(words) > 1:
                    new[1:] = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
                word = np.cumsum(new) - 1
                sizes = np.diff(part["cell"].offsets.to_numpy())
                at = np.repeat(word, sizes) * (2 * k) + part["cell"].flatten().to_numpy()
                n = np.bincount(at, part["c"].flatten().to_numpy(), (word[-1] + 1) * 2 * k).reshape(-1, 2 * k)
                names = words.filter(pa.array(new))
                if last is not None:
                    if names[0].as_py() == last:
                        n[0] += held
                    else:
                        yield chosen(pa.array([last], pa.binary()), held[None, :])
                last, held = names[-1].as_py(), n[-1].copy()
                if len(names) > 1:
                    yield chosen(names.slice(0, len(names) - 1), n[:-1])
        if last is not None:
            yield chosen(pa.array([last], pa.binary()), held[None, :])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(counts: np.ndarray, fixed: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: the unit ``fixed`` is alone in class 0, the others are exchanged between the rest.

    A sweep takes the units by frequency and moves each to the class of the best log-likelihood,
    sum f(class bigrams) - sum f(class sums as left) - sum f(class sums as right), f(x) = x log x.
    """
    n = counts.astype(np.float64)
    units = len(n)
    freq = n.sum(1) + n.sum(0)
    order = [int(u) for u in np.argsort(-freq, kind="stable") if u != fixed]
    k = max(2, min(classes, units))
    of = np.zeros(units, np.int64)
    for i, u in enumerate(order):
        of[u] = 1 + i % (k - 1)
    onehot = np.zeros((units, k))
    onehot[np.arange(units), of] = 1
    c = onehot.T @ n @ onehot
    right, left = n @ onehot, n.T @ onehot  # unit -> class after it, class before it
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not freq[u]:
                continue
            a, loop = of[u], n[u, u]
            after, before = right[u].copy(), left[u].copy()
            after[a] -= loop
            before[a] -= loop
            # without u
            c[a, :] -= after
            c[:, a] -= before
            c[a, a] -= loop
            rows, cols = c.sum(1), c.sum(0)
            fc = _xlogx(c)
            base_row, base_col, diag = fc.sum(1), fc.sum(0), np.diag(fc)
            own = np.diag(c)
            # with u in class j: row j gains `after`, column j `before`, their crossing both and the loop
            new_row = _xlogx(c + after[None, :]).sum(1) - _xlogx(own + after)
            new_col = _xlogx(c + before[:, None]).sum(0) - _xlogx(own + before)
            gain = new_row + new_col + _xlogx(own + after + before + loop) - (base_row + base_col - diag)
            out, inn = after.sum() + loop, before.sum() + loop
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(cols + inn) - _xlogx(cols)
            gain[0] = -np.inf
            j = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-6 else int(a)
            c[j, :] += after
            c[:, j] += before
            c[j, j] += loop
            if j != a:
                moved += 1
                of[u] = j
                right[:, a] -= n[:, u]
                right[:, j] += n[:, u]
                left[:, a] -= n[u, :]
                left[:, j] += n[u, :]
        if not moved:
            break
    return of


@dataclass
class Model:
    units: Units
    of: np.ndarray  # class of each unit
    step: np.ndarray  # log10 P(class | class before)
    sums: np.ndarray  # training tokens of each class
    places: np.ndarray  # seen words of each class, and one
    tokens: int
    types: int
    hot: dict[bytes, int]  # the most frequent words' counts

    def emission(self, count: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.log10((count + ADD) / (self.sums[c] + ADD * self.places[c]))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def transitions(classes: np.ndarray) -> np.ndarray:
    """log10 of the bigram shares, each row backed off to the classes' own shares."""
    k = len(classes)
    share = (classes.sum(0) + ADD) / (classes.sum() + ADD * k)
    return np.log10((classes + k * share[None, :]) / (classes.sum(1, keepdims=True) + k))


def _tails(shared: Broadcast):
    """One row for each word that is not hot, with the classes beside it (-1 where that isn't hot either)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, of = shared.value
        for batch in _pieces(batches):
            flat, starts = _sequence(batch)
            at = np.flatnonzero(flat < 0)
            if not len(at):
                continue
            row = np.searchsorted(starts, at, side="right") - 1
            seq = _labelled(flat, cls, -1)
            before = np.concatenate([cls[:1], seq[:-1]])  # a text begins after an end
            yield pa.RecordBatch.from_arrays(
                [batch["uid"].take(pa.array(row)), batch["held_out"].take(pa.array(row)), pa.array(at - starts[row]), batch["tail"].flatten(), pa.array(before[at]), pa.array(seq[at + 1]), pa.array(of[_units(batch)])],
                names=["uid", "held_out", "pos", "word", "before", "after", "spare"],
            )

    return run


def _score(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, emit, base, seen, step = shared.value
        for batch in _pieces(batches):
            flat, starts = _sequence(batch)
            hot = flat >= 0
            seq = np.concatenate([cls[:1], np.where(hot, cls[flat], -1)])
            both = (seq[:-1] >= 0) & (seq[1:] >= 0)
            total = lambda x: np.add.reduceat(x, starts[:-1])
            score = total(np.where(hot, emit[flat], 0.0) + np.where(both, step[seq[:-1], seq[1:]], 0.0))
            known = total((hot & seen[flat]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["uid"], batch["doc_id"], batch["held_out"], pa.array(np.diff(starts)), pa.array(known), pa.array(total(np.where(hot, base[flat], 0.0))), pa.array(score)],
                names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
            )

    return run


def scored(docs: DataFrame, held_out: Column, frequent: int = FREQUENT, classes: int = CLASSES, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    folder = f"{shared_dir(spark)}/class-lm-{uuid.uuid4().hex}"
    texts = docs.filter(~held_out).select(text_bytes().alias("text"))
    counts = stored(spark, texts.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), folder, "counts")
    top = most_frequent(counts, hot)
    tokens_, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    known = dict(zip(top["word"].to_pylist(), top["c"].to_pylist()))
    known = {END: known.get(END, 0)} | known
    words = list(known)
    coded = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_bytes().alias("text"))
    units = Units(words[: frequent + 1])
    coded = stored(spark, coded.mapInArrow(_encode(share((words, words[: frequent + 1]))), _CODED), folder, "coded")
    train = coded.filter("not held_out")

    unit_of = np.array([units[w] for w in words], np.int64)
    n = _square(train.mapInArrow(_count_pairs(share(unit_of), units.size, True), "pair long, c long"), units.size)
    of = exchange(n, units[END], classes)
    k = int(of.max()) + 1
    onehot = np.eye(k)[of]

    # every other word by its own neighbours
    cells = train.mapInArrow(_neighbours(share((units.own, unit_of, of)), k), "word binary, cell array<int>, c array<long>")
    chosen = cells.repartition("word").sortWithinPartitions("word").mapInArrow(_choose(onehot.T @ n @ onehot), "word binary, class long")
    chosen = stored(spark, chosen, folder, "chosen")
    own = chosen.filter(F.substring("word", 1, 1) == F.lit(_NUMBER)).toArrow()  # hot ones only
    cls = of[unit_of]
    if own.num_rows:
        cls[[int.from_bytes(w[1:], "big") for w in own["word"].to_pylist()]] = own["class"].to_numpy()
    count = np.array(list(known.values()), np.float64)
    sums = np.bincount(cls, count, minlength=k)
    places = np.bincount(cls[count > 0], minlength=k) + 1.0
    vocabulary = stored(spark, counts.join(chosen, "word"), folder, "vocabulary")  # all but the hot ones
    for r in vocabulary.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        sums[r["class"]] += r["c"]
        places[r["class"]] += r["n"]

    # class pairs of all words: those beside a word that is not hot by a join
    rare = coded.mapInArrow(_tails(share((cls, of))), "uid long, held_out boolean, pos long, word binary, before long, after long, spare long")
    rare = rare.join(vocabulary, "word", "left").withColumn("class", F.coalesce("class", "spare"))
    last = F.lag("class").over(Window.partitionBy("uid").orderBy("pos"))
    left = F.when(F.col("before") < 0, last).otherwise(F.col("before")) * k + F.col("class")
    right = F.when(F.col("after") >= 0, F.col("class") * k + F.col("after"))
    rare = stored(spark, rare.select("uid", "held_out", "class", F.coalesce("c", F.lit(0)).alias("c"), left.alias("left"), right.alias("right")), folder, "rare")
    pairs = rare.filter("not held_out").select(F.explode(F.array("left", "right")).alias("pair"), F.lit(1).cast("long").alias("c")).filter("pair is not null")
    pairs = _square(train.mapInArrow(_count_pairs(share(cls), k, False), "pair long, c long").unionAll(pairs), k)

    model = Model(units, of, transitions(pairs), sums, places, tokens_, types, known)
    step = F.from_json(F.lit(str(model.step.ravel().tolist())), "array<double>")
    size = F.array(*(F.lit(float(s + ADD * p)) for s, p in zip(sums, places)))
    for name in ("counts", "chosen", "vocabulary"):
        forget(spark, f"{folder}/{name}")
    parts = coded.mapInArrow(_score(share((cls, model.emission(count, cls), model.base(count), count > 0, model.step))), _PARTS)
    found = rare.groupBy("uid").agg(
        F.sum(F.log10((F.col("c") + ADD) / F.get(size, F.col("class").cast("int"))) + F.get(step, F.col("left").cast("int")) + F.coalesce(F.get(step, F.col("right").cast("int")), F.lit(0.0))).alias("e"),
        F.sum(F.log10((F.col("c") + 0.5) / F.lit(tokens_ + 0.5 * (types + 1)))).alias("b"),
        F.count_if(F.col("c") > 0).alias("k"),
    )
    total = parts.join(found, "uid", "left")
    score = F.col("score") + F.coalesce("e", F.lit(0.0))
    return total.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens_).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), F.least(-score / F.col("n_tokens"), F.lit(300.0))).alias("perplexity"),
    )


_PARTS = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def digest(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    return scored(docs, fold("doc_id", folds) == held)


def base_score(counts: dict[bytes, int], words: list[bytes]) -> float:
    """The plain unigram score, for tests."""
    n, v = sum(counts.values()), len(counts)
    return sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*words, END])
