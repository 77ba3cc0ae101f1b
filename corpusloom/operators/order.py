"""Row numbers over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CELLS = 4096
#: Rows drawn to find where cells end.
SAMPLE = 1 << 15


def numbered(df: DataFrame, cell: Column, order: list, name: str = "n", total: str | None = None) -> DataFrame:
    """Adds the row number (from 0) by (cell, order); `cell` must rise with the order. Cells are counted, a running sum over the few
    cells gives offsets, and each cell is sorted by itself."""
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    every = W.partitionBy()
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(every.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("_n").over(every))
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy("_cell").orderBy(*order)))
    out = rows.join(counts, "_cell").withColumn(name, (F.col("_before") + F.col("_at") - 1).cast("long"))
    return out.drop("_cell", "_n", "_before", "_at")


def id_cell(df: DataFrame, col: str, cells: int = CELLS) -> Column:
    """Cells between quantiles of the column, of any ordered type, so that no outlying value makes an uneven cell; null keys have the last one for
    themselves. The quantiles come from SAMPLE rows drawn at random; they set where cells end, not what numbered() returns."""
    kind = dict(df.dtypes)[col]
    drawn = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("k")).orderBy(F.rand(11)).limit(SAMPLE).agg(F.array_sort(F.collect_set("k")).alias("k"))
    step = f"greatest(1, cast(ceil(size(k) / {cells - 1}) as int))"
    cuts = drawn.select(F.expr(f"to_json(filter(k, (x, i) -> i % {step} = 0))")).first()[0]  # one short list
    cuts = F.from_json(F.lit(cuts or "[]"), f"array<{kind}>")
    steps = F.array(*[F.lit(1 << i) for i in range(cells.bit_length(), -1, -1)])
    # the last cut that is no greater than the key, found by halving
    at = F.aggregate(steps, F.lit(-1), lambda at, s: F.when((at + s < F.size(cuts)) & (F.get(cuts, at + s) <= F.col(col)), at + s).otherwise(at))
    return F.when(F.col(col).isNull(), F.lit(cells)).otherwise(at).cast("long")


def seeded(seed: str, key: Column) -> Column:
    """60 uniform bits of an md5: the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
