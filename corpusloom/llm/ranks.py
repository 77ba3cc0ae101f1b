"""Row numbers within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds `rank` (long, from 0) in each group by (bucket, order), and `total`, the rows of the group.

    `bucket` must rise with the order, so that a group's rows fall into buckets one after another; choose it so
    that every (group, bucket) is small. Only such a small cell is sorted by one task. Cell sizes are counted
    with partial sums; a running sum over cells gives each cell's offset. Null group values form one group.
    An empty table gives an empty table.
    """
    b = "__bucket"
    # Nulls in the join keys: a replaced key and a flag would cost more than the null-safe equality.
    cells = df.withColumn(b, bucket).groupBy(*group, b).agg(F.count(F.lit(1)).alias("__n"))
    by = W.partitionBy(*[F.col(g) for g in group]) if group else W.partitionBy()
    cells = cells.withColumn("__before", F.coalesce(F.sum("__n").over(by.orderBy(b).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    if total:
        cells = cells.withColumn(total, F.sum("__n").over(by))
    own = W.partitionBy(*[F.col(g) for g in group], F.col(b)).orderBy(*order)
    rows = df.withColumn(b, bucket).withColumn("__at", F.row_number().over(own))
    left, right = rows.alias("l"), cells.alias("r")
    on = F.col(f"l.{b}") == F.col(f"r.{b}")
    for g in group:
        on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    keep = [F.col(f"l.`{c}`") for c in df.columns]
    out = left.join(right, on).select(*keep, (F.col("r.__before") + F.col("l.__at") - 1).cast("long").alias(rank), *([F.col(f"r.{total}").cast("long").alias(total)] if total else []))
    return out
