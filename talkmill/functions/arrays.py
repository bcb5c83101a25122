"""Array expressions that stay linear in the length of the array, and a name for what is worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays grow by copies, so sums run over chunks of this size, and then over the chunks' own sums.
CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over the value, which is worked out once however often the body uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    zero = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def scan(values: Column, start: Column, op: Callable[[Column, Column], Column], neutral: int, levels: int = 1) -> Column:
    """array<bigint>: for each value what ``op`` makes of ``start`` and all values before it (bigints, op associative)."""
    if not levels:
        return _scan(values, start, op)

    def by_chunk(s: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(s, i, F.lit(CHUNK)))
        total = lambda c: F.aggregate(c, F.lit(neutral).cast("bigint"), op)
        own = lambda c, at: _scan(c, at, op)
        parts = lambda cs: F.zip_with(cs, scan(F.transform(cs, total), start, op, neutral, levels - 1), own)
        return F.when(F.size(s) <= CHUNK, _scan(s, start, op)).otherwise(let(chunks, lambda cs: F.flatten(parts(cs))))

    return let(values, by_chunk)


def before(sizes: Column, start: Column | None = None) -> Column:
    """array<bigint>: for each size ``start`` and the sum of all sizes before it."""
    return scan(F.transform(sizes, lambda n: n.cast("bigint")), F.lit(0) if start is None else start, lambda a, n: a + n, 0)
