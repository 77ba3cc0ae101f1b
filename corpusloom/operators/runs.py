"""Analytics of training runs: schedules, losses, records, checkpoints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .order import CELLS


def lr_schedule(spark: SparkSession, base: float, warmup: int, steps: int) -> DataFrame:
    """step, lr for 0 to steps: linear warm-up, then half a cosine."""
    if base <= 0 or warmup < 0 or steps <= warmup:
        raise ValueError("base > 0 and 0 <= warmup < steps")
    step = F.col("step")
    cosine = F.lit(base) * 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warmup) / (steps - warmup)))
    return spark.range(steps + 1).select(F.col("id").alias("step")).select("step", F.when(step < warmup, F.lit(base) * step / max(1, warmup)).otherwise(cosine).alias("lr"))


def speedup_grid(spark: SparkSession, gammas: int, rates: int, target: float, draft: float) -> DataFrame:
    """gamma, rate, speedup of speculative decoding, never below 1."""
    g = spark.range(gammas + 1).select(F.col("id").alias("gamma"), F.explode(F.sequence(F.lit(0), F.lit(rates))).alias("r")).withColumn("rate", F.col("r") / rates)
    s = (F.col("rate") * F.col("gamma") + 1) / ((F.col("gamma") * draft + target) / target)
    return g.select("gamma", "rate", F.when(F.col("gamma") <= 0, 1.0).otherwise(F.greatest(F.lit(1.0), s)).alias("speedup"))


def accumulated_loss(steps: DataFrame, step: str, loss: str, every: int) -> DataFrame:
    """cycle, loss, n: the mean over each accumulation cycle."""
    return steps.groupBy(F.floor(F.col(step) / every).alias("cycle")).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


def running_best(steps: DataFrame, step: str, loss: str) -> DataFrame:
    """Adds best: the least loss so far. `step` counts from 0 without gaps; runs of steps are cut into cells and these into blocks of cells. The best
    before a block comes from the blocks' minima, that before a cell from the cells' minima within its block, so each window but the first
    runs over at most CELLS rows, and the first over a row for each CELLS * CELLS steps."""
    before = lambda by: F.min("_low").over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = steps.withColumn("_cell", F.floor(F.col(step) / CELLS))
    cells = rows.groupBy("_cell").agg(F.min(loss).alias("_low")).withColumn("_block", F.floor(F.col("_cell") / CELLS))
    blocks = cells.groupBy("_block").agg(F.min("_low").alias("_low")).select("_block", before(W.orderBy("_block")).alias("_far"))
    cells = cells.withColumn("_near", before(W.partitionBy("_block").orderBy("_cell"))).join(blocks, "_block").select("_cell", F.least("_near", "_far").alias("_before"))
    own = F.min(loss).over(W.partitionBy("_cell").orderBy(step).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(cells, "_cell").withColumn("best", F.least("_own", "_before")).drop("_cell", "_own", "_before")


def latest(paths: DataFrame, path: str = "path") -> DataFrame:
    """The checkpoint of the largest step number, by number rather than by name."""
    step = F.regexp_extract(path, r"step_(\d+)", 1).cast("long")
    return paths.agg(F.max_by(path, step).alias("path"), F.max(step).alias("step"))


def throughput(steps: Column, batch: int, seq: int, seconds: Column) -> Column:
    return F.round(steps * batch * seq / F.greatest(seconds, F.lit(1e-9)), 1)
