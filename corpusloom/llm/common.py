"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import alone, fresh_path, shared_dir, written  # noqa: F401

#: The characters that separate words, and the regular expressions made of them (Java, RE2 and Python read them alike).
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the input folder, by Spark's reader alone: the folder may be on any store."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col(col), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text that is not null."""
    bare = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WORD_GAP))).cast("long")


def seeded(seed: str, key: Column, instead: Column) -> Column:
    """60 uniform bits as a long from md5(seed:key), or md5(seed:null:instead) where the key is null: the same on every engine, whatever
    the layout. `instead` keeps rows without a key apart, so that they don't share one place of an order."""
    key = F.coalesce(key.cast("string"), F.concat(F.lit("null:"), instead.cast("string")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 15), 16, 10).cast("long")


def own_names(docs: DataFrame, *names: str) -> list[str]:
    """Names for inner columns that no column of docs has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


#: A key is a hot one if it holds over a HOT-th of all rows, so there are fewer than HOT of them.
HOT = 256


def joined(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, count: str) -> DataFrame:
    """rows with the columns of table, by key; counts, a written table, says how many rows have a key. Hot keys, fewer than HOT, are sent to all
    executors, so that no task has to take all rows of one; the others meet by key."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    hot = counts.filter(F.col(count) * HOT > total).select(key)
    if not hot.take(1):
        return rows.join(table, key)
    hot = F.broadcast(hot)
    return rows.join(F.broadcast(table.join(hot, key, "left_semi")), key).unionByName(rows.join(hot, key, "left_anti").join(table, key))


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in portions of about so many rows that split no value of it. Only a portion's end is
    searched, so a value that very many rows share is copied once."""
    kept: list[pa.RecordBatch] = []
    held, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held + len(key) >= rows:
            change = np.flatnonzero(key != key[-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut or (kept and last != key[0]):
                kept.append(batch.slice(0, cut))
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, held, batch = [], 0, batch.slice(cut)
        kept.append(batch)
        held, last = held + batch.num_rows, key[-1]
    if held:
        yield pa.Table.from_batches(kept).combine_chunks()


HASH_SPACE = 1 << 60


def bucket_count(n: int, rows: int = 256, most: int = 1 << 16) -> int:
    """How many hash buckets split n rows for a distributed rank: about `rows` rows each, at most `most` buckets
    (the table of bucket sizes must stay small; beyond that, buckets grow by the row)."""
    return max(16, min(most, 1 << max(0, (n // rows).bit_length())))
