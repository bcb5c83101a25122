"""MinHash near-deduplication: one-permutation hashing, optimal densification, star-shaped candidates.

1. One pass turns each text into its set of word shingles (64-bit hashes), a 128-bit fingerprint of the
   set and the keys of ``BANDS`` bands of ``ROWS`` bins. One hash value per shingle gives its bin and its
   rank in the bin; an empty bin borrows from the first non-empty bin of its own random sequence, the
   same for all texts. With 40 bands of 5 a pair at similarity 0.8 is missed with probability 1e-7.
2. Texts of equal fingerprints form a class, on the map side first, so copies never meet in pairs.
3. A first round over ``SEED_BANDS`` bands joins most near copies: the smallest member of a bucket is its
   centre and gets an edge to each other one. After that, a bucket matters only while it holds more than
   one component. Of its members outside the component that has most of it about ``CENTRES`` become centres at first,
   drawn by a hash, and ``GROWTH`` times as many in each further round, all where they are no more, with an edge to each member of another component that
   its size and a sketch allow (the half hashes of sets up to ``SKETCH`` shingles, ``SKETCH`` bits of larger ones);
   then they leave the bucket. Where others are left for later rounds, about ``CENTRES`` members of the main component are centres too,
   so that what is linked to many of it joins it by a few stars. Two members that share many buckets are
   a pair in that of the smallest key alone. So edges are stars, a large
   group of near copies costs a star or two, rounds grow with the logarithm of the largest bucket,
   and no pair of a bucket goes untested unless it is in one component already. The sketch's bound lies
   ``SIGMAS`` standard deviations under what a pair at the threshold shows, so it misses one in 1e9 of these, fewer
   than the bands do. Edges are confirmed on the full sets.
4. Components are found by large-star / small-star steps over the links between components.

All tables stay distributed; what rounds hand on is written to the shared folder, and so is each bucket's or
component's own row before its members are joined to it: then both sides of the join are plain exchanges, of which
Spark splits the large ones, so one hot bucket or component is no single task.

Defined cases: null, empty and word-less texts have empty sets, are linked with nothing and kept; texts of
fewer words than a shingle are one shingle; a null doc_id can link others but never names a component
unless all its members are null; repeated rows are copies and all get the component's id; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blank_words, forget, fresh, shared_dir, size_of, stored, text_bytes

THRESHOLD = 80  # per cent
BANDS, ROWS, SEED_BANDS = 40, 5, 4
CENTRES, GROWTH = 16, 8
#: What a member of a bucket is called as its centre.
CENTRE = {"node": "c", "n": "c_n", "comp": "c_comp", "bits": "c_bits", "small": "c_small", "bands": "c_bands"}
SKETCH, SIGMAS = 512, 6.0
#: Bytes of written edges that one task takes.
EDGE_BYTES = 512 * 1024
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words, or of the whole where there are fewer."""
    words = blank_words(text)
    if not words:
        return np.empty(0, _U)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    k = min(size, len(ids))
    h = np.full(len(ids) - k + 1, _U(k))
    for i in range(k):
        h *= _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
        h += ids[i : len(ids) - k + 1 + i]
    h = mix(h)
    h.sort()
    return h if len(h) < 2 else h[np.concatenate([[True], h[1:] != h[:-1]])]


class Signer:
    """Band keys of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(20_240_601)
        #: For each bin the sequence of bins it borrows from.
        self.order = rng.integers(0, self.bins, size=(self.bins, 1024), dtype=np.int64)
        self.salt = mix(np.arange(1, bands + 1, dtype=_U))
        self.factors = mix(np.arange(1, rows + 1, dtype=_U)) | _U(1)

    def bins_of(self, hashes: np.ndarray) -> np.ndarray:
        at = ((hashes >> _U(32)) * _U(self.bins) >> _U(32)).astype(np.int64)  # sorted, as hashes are
        first = np.flatnonzero(np.diff(at, prepend=-1))
        full, value = np.zeros(self.bins, bool), np.zeros(self.bins, _U)
        full[at[first]], value[at[first]] = True, hashes[first]
        empty = np.flatnonzero(~full)
        source = np.arange(self.bins)
        for a in range(0, self.order.shape[1], 32):
            if not len(empty):
                break
            tried = self.order[empty, a : a + 32]
            ok = full[tried]
            hit = ok.any(1)
            source[empty[hit]] = tried[hit, ok[hit].argmax(1)]
            empty = empty[~hit]
        if len(empty):  # all but impossible: the next full bin
            filled = np.flatnonzero(full)
            source[empty] = filled[np.searchsorted(filled, empty) % len(filled)]
        return value[source]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        parts = self.bins_of(hashes).reshape(self.bands, self.rows)
        return mix((parts * self.factors).sum(1) + self.salt).view(np.int64)


    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """One bit of each bin's value, 64 to a long."""
        return np.packbits((self.bins_of(hashes) & _U(1)).astype(np.uint8)).view(np.int64)


def _fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            n, prints, keys = [], [], []
            for t in batch["text"]:
                h = shingles(t.as_py(), size)
                n.append(len(h))
                prints.append(_fingerprint(h) if len(h) else None)
                keys.append(signer.keys(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["key"], pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n", "fp", "bands"],
            )

    return run


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(SKETCH, 1)
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch["text"]]
            bits = [signer.sketch(h) for h in sets]
            # the low halves of the hashes, whose high halves they are sorted by
            small = [(h & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32) if len(h) <= SKETCH else None for h in sets]
            yield pa.RecordBatch.from_arrays(
                [batch["node"], pa.array(bits, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int32())), batch["bands"], batch["text"]],
                names=["node", "bits", "small", "bands", "text"],
            )

    return run


def agreeing(a, b):
    """How many bits of two sketches (array columns) agree."""
    return F.lit(SKETCH) - sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, SKETCH // 64)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _confirm(size: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            keep = []
            for c, ct, t in zip(batch["a"].to_pylist(), batch["a_text"], batch["b_text"]):
                if c != centre:
                    centre, own = c, shingles(ct.as_py(), size)
                keep.append(similar(own, shingles(t.as_py(), size), threshold))
            yield batch.select(["a_comp", "b_comp"]).filter(pa.array(keep, pa.bool_()))

    return run


def _both(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) from both of its ends."""
    ends = F.array(F.struct("u", "v", F.lit(1).alias("out")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("out")))
    return edges.select(F.explode(ends).alias("e")).select("e.*")


def _is_forest(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: each u has one v, which is no u itself."""
    ends = _both(edges).groupBy("u").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return not ends.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("least") == 0)))).first()[0]


def components(links: DataFrame, folder: str) -> DataFrame:
    """(u, v): every end of a link but the smallest of its component, with that smallest one as v.

    A small table of edges is read into as few tasks as its bytes need, so that the steps on it need not shuffle.
    """
    spark = links.sparkSession

    def kept(edges: DataFrame, step: int) -> tuple[DataFrame, int]:
        edges = stored(spark, edges, folder, str(step))
        tasks = -(-size_of(spark, f"{folder}/{step}") // EDGE_BYTES) or 1
        return edges.coalesce(tasks), tasks

    edges = links.select(F.greatest("a_comp", "b_comp").alias("u"), F.least("a_comp", "b_comp").alias("v")).filter("u <> v").distinct()
    (edges, tasks), step = kept(edges, 0), 0
    while not _is_forest(edges):
        # large star: the larger neighbours of a node go to its smallest one
        both = _both(edges).drop("out")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        every = small.unionByName(low.select("u", F.col("m").alias("v")))
        step += 1
        edges, tasks = kept((every.coalesce(1) if tasks == 1 else every).distinct(), step)
        forget(spark, f"{folder}/{step - 1}")
    return edges


def _fits(threshold: int):
    """Whether two sizes, n and c_n, allow the threshold."""
    return F.lit(100) * F.least("n", "c_n") >= F.lit(threshold) * F.greatest("n", "c_n")


def _near(threshold: int):
    """Whether a pair may reach the threshold: two small sets by their common half hashes (one may be lost to a
    collision), others by the bits that a pair of sizes n and c_n at the threshold all but surely agrees in."""
    both = F.size(F.array_intersect("small", "c_small")) + 1
    p = (1 + threshold / 100) / 2
    spread = F.sqrt(F.lit(p * (1 - p)) / F.least(F.lit(SKETCH), "n", "c_n"))
    bits = agreeing(F.col("bits"), F.col("c_bits")) >= F.lit(SKETCH) * (F.lit(p) - F.lit(SIGMAS) * spread)
    small = F.col("small").isNotNull() & F.col("c_small").isNotNull()
    return F.when(small, 100 * both >= threshold * (F.col("n") + F.col("c_n") - both)).otherwise(bits)


def _pairs(live: DataFrame, centre: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of centres and members of their buckets that may be linked and aren't yet, each but once.

    Of all buckets that two nodes share, that of the smallest key alone has them as a pair; of two centres the smaller one.
    """
    l, r = live.alias("l"), centre.alias("r")
    low = F.col("c") < F.col("node")
    first = F.array_min(F.array_intersect("bands", "c_bands")) == F.col("l.bucket")
    apart = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("comp") != F.col("c_comp"))
    star = l.join(r, apart & (~F.col("drawn") | low) & _fits(threshold) & first & _near(threshold))
    return star.select(
        F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b"),
        F.when(low, F.col("c_comp")).otherwise(F.col("comp")).alias("a_comp"), F.when(low, F.col("comp")).otherwise(F.col("c_comp")).alias("b_comp"),
    )


def _linked(spark, edges: DataFrame, bodies: DataFrame, size: int, threshold: int, folder: str) -> DataFrame:
    """Component -> smaller component (comp, to), by those edges that the full sets confirm."""
    pair = edges.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    pair = pair.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    links = pair.mapInArrow(_confirm(size, threshold), "a_comp long, b_comp long")
    return components(links, f"{folder}/components").select(F.col("u").alias("comp"), F.col("v").alias("to"))


def groups(docs: DataFrame, size: int = 4, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, fp (of the set), component_id, comp and kept, one row per document row.

    ``comp`` is the group's own number, null without words; unlike ``component_id`` it never stands for two groups.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/near-dedup-{uuid.uuid4().hex}"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).withColumn("key", F.unhex(F.md5("text")))
    signed = stored(spark, texts.mapInArrow(_sign(size, bands, rows), "doc_id long, key binary, n long, fp binary, bands array<long>"), folder, "signed")
    rows_ = signed.withColumn("uid", F.monotonically_increasing_id())  # of a written table, so it stays
    classes = stored(
        spark,
        rows_.filter("n > 0").groupBy("fp").agg(F.min("uid").alias("node"), F.min("doc_id").alias("cid"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        folder,
        "classes",
    )
    every = classes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = stored(spark, every.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket"), folder, "buckets")
    found = stored(spark, every.join(shared, "bucket"), folder, "shared")

    # one text of each class that shares a bucket, by the text's own digest
    needed = found.select("node").distinct().join(classes.select("node", "key", "bands"), "node")
    bodies = texts.select("key", "text").dropDuplicates(["key"]).join(needed, "key").select("node", "bands", "text")
    bodies = stored(spark, bodies.mapInArrow(_sketch(size), "node long, bits array<long>, small array<int>, bands array<long>, text binary"), folder, "bodies")

    # seed: one star in each bucket of a few bands
    seed = found.filter(F.col("band") < SEED_BANDS)
    centre = stored(spark, seed.groupBy("bucket").agg(F.min("node").alias("c"), F.min_by("n", "node").alias("c_n")), f"{folder}/seed", "centres")
    star = seed.join(centre, "bucket").filter((F.col("c") < F.col("node")) & _fits(threshold))
    edges = star.select(F.col("c").alias("a"), F.col("node").alias("b"), F.col("c").alias("a_comp"), F.col("node").alias("b_comp")).distinct()
    moves = [_linked(spark, edges, bodies, size, threshold, f"{folder}/seed")]
    members = found.select("node", "n", "bucket").withColumn("comp", F.col("node"))
    step, centres_each = 0, CENTRES
    while True:
        step += 1
        at = f"{folder}/round-{step}"
        moved = members.join(moves[-1], "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")
        members = stored(spark, moved, at, "members")
        most = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket")
        most = most.agg(F.max_by("comp", "k").alias("main"), F.max("k").alias("mains"), (F.sum("k") - F.max("k")).alias("others")).filter("others > 0")
        most = stored(spark, most, at, "most")
        if most.isEmpty():
            break
        draw = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(1 << 30))
        # of the main component only where others are left for later rounds
        drawn = F.when(F.col("comp") != F.col("main"), draw * F.col("others") < F.lit(centres_each << 30)).otherwise(
            (F.col("others") > centres_each) & (draw * F.col("mains") < F.lit(CENTRES << 30))
        )
        live = members.join(most, "bucket").join(bodies.select("node", "bits", "small", "bands"), "node").withColumn("drawn", drawn)
        live = stored(spark, live, at, "live")
        centre = live.filter("drawn").select("bucket", *(F.col(x).alias(y) for x, y in CENTRE.items()))
        edges = _pairs(live, stored(spark, centre, at, "centres"), threshold)
        moves.append(_linked(spark, edges, bodies, size, threshold, at))
        # buckets whose others have all been centres are done
        members = live.filter((F.col("others") > centres_each) & ~F.col("drawn")).select("bucket", "node", "n", "comp")
        centres_each *= GROWTH

    nodes = found.select("node").distinct().withColumn("comp", F.col("node"))
    for move in moves:
        nodes = nodes.join(move, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    nodes = stored(spark, nodes, folder, "nodes")
    named = nodes.join(classes.select("node", "cid"), "node")
    least = stored(spark, named.groupBy("comp").agg(F.min("cid").alias("component_id")), folder, "least")
    named = named.join(least, "comp").select("node", "comp", "component_id", F.lit(True).alias("linked"))
    named = stored(spark, named, folder, "named")
    of = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("cid"))
    found = classes.select("fp", "node", "cid").join(named, "node", "left").select("fp", of.alias("component_id"), F.coalesce("comp", "node").alias("comp"))
    # what the result is not read from
    for name in ("bodies", "buckets", "shared", "seed", "nodes", "least", *(f"round-{k}" for k in range(1, step + 1))):
        forget(spark, f"{folder}/{name}")
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"), "fp")
        .join(found, "fp", "left")
        .select("doc_id", "n_shingles", "fp", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "comp")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, size: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The documents with one row of each group, that of the smallest doc_id; rows without words all stay.

    The columns stay as they are. Rows of one group that also share its smallest doc_id are told apart by
    their sets' fingerprints and then as copies. Groups that share a doc_id, or have none, keep a row each.
    """
    names = docs.columns
    found = groups(docs, size, threshold).filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("m")
    leaders = found.groupBy("comp").agg(first).select(F.col("m.doc_id").alias("_id"), F.col("m.fp").alias("_fp"))
    if found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or doc_id is null").isEmpty():
        ids = leaders.select("_id")
        wordless = docs.filter(_wordless())
        rest = docs.filter(~_wordless())
        return rest.join(ids, rest["doc_id"].cast("long") == ids["_id"], "left_semi").unionByName(wordless)
    own = fresh("_fp", names)
    schema = T.StructType([*docs.schema, T.StructField(own, T.BinaryType())])

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles((t.as_py() or "").encode(), size) for t in batch["text"]]
            yield batch.append_column(own, pa.array([_fingerprint(h) if len(h) else None for h in sets], pa.binary()))

    stamped = docs.mapInArrow(stamp, schema)
    match = stamped[own].eqNullSafe(leaders["_fp"]) & stamped["doc_id"].cast("long").eqNullSafe(leaders["_id"])
    first = stamped.join(leaders, match, "left_semi").dropDuplicates([own])
    return first.select(names).unionByName(stamped.filter(F.col(own).isNull()).select(names))


def _wordless():
    return ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def oracle(size: int = 4, threshold: int = THRESHOLD) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [ws]
    ELSE list_distinct(list_transform(range(len(ws) - {size - 1}), lambda i: ws[i + 1:i + {size}])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
    FROM x AS a JOIN x AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= {threshold} * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, m.b AS component_id, s.doc_id = m.b AS kept
FROM s JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) AS m ON s.doc_id = m.a"""
