"""Exact top-k inner products by vector-approximation files.

1. Vectors become integers, floor(scale * x). Pages of ``PAGE`` of them are quantised once into cells, ``BITS`` bits a
   component over the page's own range, and written to the shared folder: cells, with the exact vectors beside them.
2. One matrix product over a page's cells bounds every score: it is within r = sum |q_j| * (half a cell) of the
   cell centre's score. Rows whose upper bound stays under the k-th best lower bound (or the k-th best exact
   score so far) are out; of the others exact vectors are read in bound order until the k-th result is certain.
3. Queries pass in blocks of at most ``QUERY_BLOCK`` vectors and ``QUERY_BYTES`` bytes. A block is broadcast, run past
   all pages, its results (k a query and task) are written, and it is let go before the next. Only those are
   shuffled by the merge. The query set against all rows is the contract, so the work grows with the product of both.

Defined cases: vectors that are null, empty or hold a null or non-finite component, and rows without a vec_id,
take no part (a component that leaves the doubles when scaled counts as non-finite). Scores are exact integers of any
size and ranked as such; one that no long holds is shown as the nearest long. Only vectors of a query's own length
are its candidates. Rows that repeat a vec_id are all candidates; as a query, a vec_id counts once (its
smallest vector). Fewer candidates than k: all of them. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import forget, shared_dir, stored

K = 20
BITS = 6
PAGE = 4096
QUERY_BLOCK, QUERY_BYTES = 16_384, 32 * 1024 * 1024
#: Sums of products under this are exact in doubles.
_EXACT = float(2**52)
_WHOLE = float(2**53)
_LONG = 2**63
#: Bytes that hold any product sum of doubles, with its sign.
_WIDE = 300

PAGES = "size int, n int, ids binary, low binary, width binary, top binary, cells binary, vectors binary"
FOUND = "query_id long, vec_id long, side int, wide binary, score long"


def integers(df: DataFrame, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the integer vector ``v`` of the rows that take part."""
    scaled = F.transform(F.col(embedding), lambda x: x.cast("double") * F.lit(float(scale)))
    # a large double is whole already, and no long need hold it
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < _WHOLE, F.floor(y).cast("double")).otherwise(y))
    finite = F.forall(scaled, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    rows = df.filter(F.col(vec_id).isNotNull() & (F.size(embedding) > 0) & finite)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


class VAFile:
    """Quantised cells of one page of integer vectors, with the exact vectors beside them."""

    def __init__(self, low: np.ndarray, width: np.ndarray, top: np.ndarray, cells: np.ndarray, vectors: np.ndarray):
        self.width, self.top, self.cells, self.vectors = width, top, cells, vectors
        self.half = (width - 1) / 2
        self.base = low + self.half

    @classmethod
    def of(cls, vectors: np.ndarray, bits: int = BITS) -> VAFile:
        low, high = vectors.min(0), vectors.max(0)
        with np.errstate(all="ignore"):
            width = np.maximum(1.0, np.ceil((high - low + 1) / 2**bits))  # in integers; a width of 1 is exact
            cells = (vectors - low) // width
        if not np.isfinite(width).all():  # a range beyond the doubles: one cell, whose bounds exclude nothing
            low, width, cells = np.zeros_like(low), np.where(np.isfinite(width), width, np.inf), np.zeros_like(vectors)
        return cls(low, width, np.abs(vectors).max(0), cells.astype(np.uint8), vectors)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the cells' centres (queries x rows), and the most by which each query's may be off (infinite where
        doubles can't tell)."""
        with np.errstate(all="ignore"):
            centre = (queries * self.width) @ self.cells.T.astype(np.float64) + (queries @ self.base)[:, None]
            off = np.abs(queries) @ self.half
            off = off + 1e-9 * (1 + np.abs(queries) @ self.top)  # and rounding
        lost = ~(np.isfinite(centre).all(1) & np.isfinite(off))
        centre[lost], off[lost] = 0.0, np.inf
        return centre, off


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        if np.abs(query).sum() * np.abs(rows).max(initial=0) < _EXACT:
            return (rows @ query).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(query, r)) for r in rows]
    return np.array(big, dtype=np.int64 if all(-_LONG < x < _LONG for x in big) else object)


def _ranked(scores: np.ndarray, owners: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:  # beyond a long
        order = np.array(sorted(range(len(scores)), key=lambda i: (-int(scores[i]), owners[i]))[:k], dtype=np.int64)
    else:
        order = np.lexsort((owners, -scores))[:k]
    return scores[order], owners[order]


def _under(score: int) -> float:
    """A double that is no more than the score."""
    try:
        return float(score) if abs(score) < _WHOLE else float(score) * (1 - 1e-15 if score > 0 else 1 + 1e-15)
    except OverflowError:
        return np.finfo(float).max if score > 0 else -np.inf


def search(file: VAFile, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, best: list, step: int = 64) -> None:
    """Updates each query's ``best`` (score, vec_id arrays in rank order) with the rows of one VA-file."""
    centre, off = file.bounds(queries)
    n = centre.shape[1]
    for i in range(len(queries)):
        row, r = centre[i], off[i]
        scores, owners = best[i]
        floor = _under(int(scores[-1])) if len(scores) >= k else -np.inf
        others = ids != query_ids[i]  # its own rows, however many, are no candidates
        m = int(others.sum())
        if m > k:
            floor = max(floor, np.partition(row if m == n else row[others], m - k)[m - k] - r)
        near = np.flatnonzero((row + r >= floor) & others)
        if not len(near):
            continue
        near = near[np.argsort(-row[near], kind="stable")]
        at = 0
        while at < len(near):
            if len(scores) >= k and row[near[at]] + r < _under(int(scores[-1])):
                break  # no later bound reaches the k-th score
            part = near[at : at + step]
            at += step
            s = np.concatenate([scores, exact(queries[i], file.vectors[part])])
            o = np.concatenate([owners, ids[part]])
            scores, owners = _ranked(s, o, k)
        best[i] = (scores, owners)


def _empty() -> tuple[np.ndarray, np.ndarray]:
    return np.empty(0, np.int64), np.empty(0, np.int64)


def _flat(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components, where each vector's begin, and the vectors' lengths."""
    sizes = np.diff(v.offsets.to_numpy())
    return v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]), sizes


def _quantise(bits: int, page: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["vec_id"].to_numpy(zero_copy_only=False)
            flat, starts, sizes = _flat(batch["v"])
            for d in np.unique(sizes):
                every = np.flatnonzero(sizes == d)
                for a in range(0, len(every), page):
                    of = every[a : a + page]
                    file = VAFile.of(flat[starts[of][:, None] + np.arange(d)], bits)
                    low = file.base - file.half
                    blobs = [ids[of].astype(np.int64), low, file.width, file.top, file.cells, file.vectors]
                    columns = [pa.array([int(d)], pa.int32()), pa.array([len(of)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)]
                    yield pa.RecordBatch.from_arrays(columns, names=["size", "n", "ids", "low", "width", "top", "cells", "vectors"])

    return run


def _results(query_ids: np.ndarray, best: list) -> pa.RecordBatch | None:
    counts = [len(s) for s, _ in best]
    if not sum(counts):
        return None
    scores = [int(x) for s, _ in best for x in s]
    side = [0 if -_LONG <= x < _LONG else 1 if x > 0 else -1 for x in scores]
    # what no long holds is ranked by its bytes, shifted so that they rise with the number
    wide = [None if not c else (x + (1 << 8 * _WIDE - 1)).to_bytes(_WIDE, "big") for x, c in zip(scores, side)]
    shown = [min(max(x, -_LONG), _LONG - 1) for x in scores]
    columns = [pa.array(np.repeat(query_ids, counts)), pa.array(np.concatenate([o for _, o in best])), pa.array(side, pa.int32()), pa.array(wide, pa.binary()), pa.array(shown, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "side", "wide", "score"])


def _scan(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = {d: [_empty() for _ in ids] for d, (_, ids) in block.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                d, n = batch["size"][i].as_py(), batch["n"][i].as_py()
                if d not in block:
                    continue
                read = lambda name, kind=np.float64: np.frombuffer(batch[name][i].as_buffer(), kind)  # noqa: E731, B023
                file = VAFile(read("low"), read("width"), read("top"), read("cells", np.uint8).reshape(n, d), read("vectors").reshape(n, d))
                ids = read("ids", np.int64)
                q, q_ids = block[d]
                for a in range(0, len(q), 512):  # bounds the memory of the scores
                    part = best[d][a : a + 512]
                    search(file, ids, q[a : a + 512], q_ids[a : a + 512], k, part)
                    best[d][a : a + 512] = part
        for d, (_, q_ids) in block.items():
            for a in range(0, len(q_ids), 1024):
                out = _results(q_ids[a : a + 1024], best[d][a : a + 1024])
                if out is not None:
                    yield out

    return run


def _blocks(queries: DataFrame, size: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The query set in bounded blocks, by vector length; one block at a time is in the driver."""
    rows: list = []
    held = 0

    def packed(rows: list) -> dict:
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(len(r[1]), []).append(r)
        return {d: (np.array([v for _, v in rs], dtype=np.float64), np.array([i for i, _ in rs], dtype=np.int64)) for d, rs in by.items()}

    for r in queries.toLocalIterator():
        rows.append((r["vec_id"], np.array(r["v"])))
        held += 8 * len(r["v"])
        if len(rows) >= size or held >= QUERY_BYTES:
            yield packed(rows)
            rows, held = [], 0
    if rows:
        yield packed(rows)


def topk(vectors: DataFrame, every: int = 20, k: int = K, scale: int = 64, bits: int = BITS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    if not 1 <= bits <= 8:
        raise ValueError("cells have 1 to 8 bits")
    spark = vectors.sparkSession
    folder = f"{shared_dir(spark)}/vector-topk-{uuid.uuid4().hex}"
    rows = integers(vectors, scale)
    pages = stored(spark, rows.mapInArrow(_quantise(bits, PAGE), PAGES), folder, "pages")
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = stored(spark, queries, folder, "queries")
    found = f"{folder}/found"
    spark.createDataFrame([], FOUND).write.parquet(found)
    for block in _blocks(queries, query_block):
        shared = spark.sparkContext.broadcast(block)
        pages.mapInArrow(_scan(shared, k), FOUND).write.mode("append").parquet(found)
        shared.destroy()
    forget(spark, f"{folder}/pages")
    forget(spark, f"{folder}/queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("wide"), F.desc("score"), F.asc("vec_id"))
    ranked = spark.read.schema(FOUND).parquet(found).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = K, every: int = 20) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
    FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= {k}"""
