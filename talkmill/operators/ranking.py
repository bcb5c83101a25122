"""Places in an order, of groups that no single task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Ranges that an order is cut into, at most.
RANGES = 256


def placed(rows: DataFrame, order: str, *keys: str, name: str, ranges: int = RANGES) -> DataFrame:
    """The rows with their place from 0 in the order of a number or a text, within the keys.

    The driver gets approximate quantiles (of a text's first bytes as a number), ``ranges`` at most. Rows are ranked in
    each range and key, and what the ranges before hold is added, so the work of one key is shared out too. Rows of
    equal order are of one range; ones without it come first.
    """
    number = F.col(order)
    if isinstance(rows.schema[order].dataType, T.StringType):
        number = F.conv(F.rpad(F.hex(F.substring(number.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    rows_, rows = rows, rows.withColumn("_number", number)
    shares = [k / ranges for k in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("_number", shares, 10_000)).first()[0] or []
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    parted = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col("_number"))))
    sizes = parted.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    ranked = parted.withColumn("_own", own).join(starts, same)
    return ranked.select(*rows_.columns, (F.col("_start") + F.col("_own")).cast("bigint").alias(name))
