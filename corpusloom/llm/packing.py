"""Packing into length buckets whose bounds minimise padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASH_SPACE, bucket_count, read, seeded, text_of, word_count, written
from .ranks import ranked

SEED = "pack-3"
N_BUCKETS, TOKEN_BUDGET = 16, 32_768


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """The at most k bounds, out of `lengths` (rising), that minimise the padding of the histogram.

    best[j] after m rounds is the least padded total with lengths[:j + 1] in m buckets; a bucket over (i, j] costs
    lengths[j] * its rows. For rising j the best i rises too, so a lower hull of lines (slope: rows up to i, taken at
    lengths[j]) gives each round in linear time. Ties go to the smaller i.
    """
    n = len(lengths)
    if n <= k:
        return [int(x) for x in lengths]
    x, c = [int(v) for v in lengths], np.concatenate([[0], np.cumsum(counts)]).tolist()
    best = [x[j] * c[j + 1] for j in range(n)]
    back = [[0] * n]
    for m in range(1, k):
        new, at = [0] * n, [0] * n
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i): a bucket that starts after entry i - 1
        head = 0
        for j in range(n):
            if j >= m:  # the bucket (j - 1, ...] may start here
                s, b = -c[j], best[j - 1]
                while len(hull) - head >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - s) >= (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((s, b, j))
            if j < m:
                new[j], at[j] = best[j], back[-1][j] if m > 1 else 0
                continue
            while len(hull) - head >= 2 and hull[head][0] * x[j] + hull[head][1] > hull[head + 1][0] * x[j] + hull[head + 1][1]:
                head += 1
            s, b, i = hull[head]
            new[j], at[j] = s * x[j] + b + x[j] * c[j + 1], i
        best = new
        back.append(at)
    bounds, j = [], n - 1
    for m in range(k - 1, -1, -1):
        bounds.append(x[j])
        j = back[m][j] - 1
        if j < 0:
            break
    return bounds[::-1]


def length_buckets(sizes: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, seed: str = SEED) -> DataFrame:
    """From doc_id, n_tokens (long): the bucket, batch and slot of every row.

    The global histogram counts the exact lengths from 1 to `budget`, so `budget` rows at most reach the driver, however large the table,
    and dynamic programming over it gives the bounds of at most n_buckets buckets that minimise the padding of all these rows. In a bucket of
    bound b, rows in the order of a seeded hash form batches of floor(budget / b) rows, so that a padded batch holds the budget or fewer
    tokens. A row that is longer than the budget fits into no batch with another: it goes whole into bucket n_buckets, as a batch of its own
    without padding, which is the one kind of batch that holds more than the budget. Rows without tokens go into bucket -1, in batches of
    `budget` rows that hold no tokens.

    Returns doc_id, n_tokens, bucket, bucket_len, batch, slot, batch_rows, padding. Null doc_ids are hashed by length. Null lengths count as
    0. Repeated rows each take a slot. An empty table gives no rows.
    """
    if budget < 1 or n_buckets < 1:
        raise ValueError("a batch must hold a token and there must be a bucket")
    sizes = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    hist = sizes.filter((F.col("n_tokens") > 0) & (F.col("n_tokens") <= budget)).groupBy(F.col("n_tokens").alias("len")).agg(F.count(F.lit(1)).alias("n")).orderBy("len").collect()
    bounds = optimal_bounds(np.array([r["len"] for r in hist], dtype=np.int64), np.array([r["n"] for r in hist], dtype=np.int64), n_buckets) if hist else []
    n = sizes.count()
    at, width = F.lit(n_buckets), F.col("n_tokens")
    for i in range(len(bounds) - 1, -1, -1):
        at, width = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(at), F.when(F.col("n_tokens") <= bounds[i], bounds[i]).otherwise(width)
    none = F.col("n_tokens") == 0
    rows = sizes.select("doc_id", "n_tokens", F.when(none, -1).otherwise(at).cast("int").alias("bucket"), F.when(none, 0).otherwise(width).cast("long").alias("bucket_len"), seeded(seed, F.col("doc_id"), F.col("n_tokens")).alias("h"))
    cells = bucket_count(n)
    rows = ranked(rows, ["bucket"], F.floor(F.col("h") / F.lit(HASH_SPACE // cells)).cast("long"), [F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("n_tokens")], "r", "n")
    fit = F.when(none, budget).when(F.col("bucket") == n_buckets, 1).otherwise(F.expr(f"{budget} div greatest(bucket_len, 1)")).cast("long")
    rows = rows.withColumn("fit", fit).withColumn("batch", F.expr("r div fit"))
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", "batch", F.expr("r % fit").alias("slot"),
        F.least(F.col("fit"), F.col("n") - F.col("batch") * F.col("fit")).cast("long").alias("batch_rows"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """length_buckets over whole documents; tokens are words. Null text: no tokens. Columns besides doc_id and text are not read."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(text_of()).alias("n_tokens"))
    return length_buckets(written(sizes, "pack"), **how)


def op6_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op6_buckets": op6_buckets}
ORACLES: dict[str, str] = {}
