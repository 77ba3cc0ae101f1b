"""From documents to training examples: lines, splits, chunks, targets, batches, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .order import id_cell, numbered, seeded

TRAIN, VAL = 0.9, 0.05
#: Lines of a part of a split's text.
PART_LINES = 1 << 16


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1) > 0.01 or min(train, val, test) < 0:
        raise ValueError("ratios must sum to 1")


def line_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.lines(T.nothing_null("text"))).alias("line_no", "line"))


def unique_lines(docs: DataFrame) -> DataFrame:
    """Each different line (an empty one is a line too) at its first place by (doc_id, line_no), null doc_ids last. Counted with partial minima: a line that is everywhere
    meets in no single task."""
    rows = line_rows(docs)
    return rows.groupBy("line").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")).alias("first")).select("first.doc_id", "first.line_no", "line")


def split_lines(docs: DataFrame, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """unique_lines in order with row_no and split: a first run for training (one line at least), the next for validation, the rest for test."""
    check_ratios(train, val, 1 - train - val)
    lines = unique_lines(docs)
    rows = numbered(lines, id_cell(docs, "doc_id"), ["doc_id", "line_no"], "row_no", "n")
    n = F.col("n").cast("double")
    end = F.least(F.col("n"), F.greatest(F.lit(1), F.floor(n * train)))
    val_end = F.least(F.col("n"), end + F.floor(n * val))
    return rows.withColumn("split", F.when(F.col("row_no") < end, "train").when(F.col("row_no") < val_end, "val").otherwise("test")).drop("n")


SPLITS = ("train", "val", "test")


def split_texts(split: DataFrame) -> DataFrame:
    """split, part_no, text of split_lines(): each split's lines in order, a line end between them, in parts of PART_LINES lines, so that no split has to
    fit into a row; a split of up to so many lines is one text."""
    low = split.groupBy("split").agg(F.min("row_no").alias("_first"))
    rows = split.join(low, "split").withColumn("part_no", F.floor((F.col("row_no") - F.col("_first")) / PART_LINES))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda s: s["line"]), "\n")
    return rows.groupBy("split", "part_no").agg(text.alias("text"))


def one_split(split: DataFrame, name: str) -> DataFrame:
    if name not in SPLITS:
        raise ValueError(f"no split {name!r}: one of {', '.join(SPLITS)}")
    return split.filter(F.col("split") == name).drop("split")


def split_leakage(split: DataFrame) -> DataFrame:
    """Lines in more than one split, counted (0: the splits are disjoint)."""
    return split.groupBy("line").agg(F.count_distinct("split").alias("k")).agg(F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0).cast("long")).alias("n_leaked"))


def manifest(docs: DataFrame, name: str, version: str) -> DataFrame:
    """One row: the corpus's digest, its raw lines and words, and words by split. The raw counts include repeated lines."""
    text = T.nothing_null("text")
    size = F.size(T.words(F.col("line")))
    # sum of digests: the corpus is a table of rows in no order, so no single stream of bytes is there to hash; as text, as it passes 64 bits
    raw = docs.agg(F.count(F.lit(1)).alias("num_documents"), F.sum(F.octet_length(text)).alias("num_bytes"), F.sum(F.size(T.lines(text))).alias("num_lines"),
                   F.coalesce(F.sum(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content_sum"),
                   F.sum(F.size(T.words(text))).cast("long").alias("total_tokens"))
    part = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, size)), F.lit(0)).cast("long").alias(f"{s}_tokens")
    by_split = split_lines(docs).agg(part("train"), part("val"), part("test"))
    return raw.crossJoin(by_split).select(F.lit(name).alias("name"), F.lit(version).alias("version"), "*")  # one row by one row


#: What a saved manifest must hold.
MANIFEST_FIELDS = ("name", "version", "num_documents", "num_bytes", "num_lines", "content_sum", "total_tokens", "train_tokens", "val_tokens", "test_tokens")


def save_manifest(manifest: DataFrame, path: str) -> None:
    """As one JSON document."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.json(path)
    if missing := sorted(set(MANIFEST_FIELDS) - set(found.columns)):
        raise ValueError(f"missing fields: {missing}")
    return found.select(*MANIFEST_FIELDS)


def legacy_manifest(manifest: DataFrame) -> DataFrame:
    """The older form: totals beside a map of tokens by split and the ratios they were asked for."""
    by_split = F.create_map(*[x for s in SPLITS for x in (F.lit(s), F.col(f"{s}_tokens"))])
    ratios = F.create_map(*[x for s, r in zip(SPLITS, (TRAIN, VAL, round(1 - TRAIN - VAL, 6)), strict=True) for x in (F.lit(s), F.lit(r))])
    return manifest.select(F.col("name").alias("dataset"), "num_lines", F.col("total_tokens").alias("num_tokens"), by_split.alias("tokens_by_split"), ratios.alias("split_ratios"))


def windows(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows of `size` with `overlap`; a last one may lie within the one before it."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the size")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def token_chunks(seqs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """From doc_id, ids: doc_id, chunk_no, tokens."""
    cut = F.transform(windows(F.size("ids"), size, overlap), lambda s: F.slice("ids", s + 1, size))
    return seqs.select("doc_id", F.posexplode(cut).alias("chunk_no", "tokens"))


def next_targets(chunks: DataFrame, size: int, pad: int = 0, ignore: int = -100) -> DataFrame:
    """Adds input (filled up with pad) and target: the next token, pad after the last, ignore wherever the input is pad."""
    fill = lambda a: F.concat(a, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), size - F.size(a))))
    out = chunks.withColumn("input", fill(F.slice("tokens", 1, size)))
    return out.withColumn("target", F.transform("input", lambda v, i: F.when(v == pad, ignore).otherwise(F.coalesce(F.get("input", i + 1), F.lit(pad)))))


def collated(examples: DataFrame, batch: str, inputs: str, targets: str) -> DataFrame:
    """Arrays filled up to the longest of their batch: inputs with 0, targets with -100."""
    longest = F.max(F.size(inputs)).over(W.partitionBy(batch))
    out = examples.withColumn("_w", longest)
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_w") - F.size(c)))
    return out.withColumn(inputs, fill(inputs, 0)).withColumn(targets, fill(targets, -100)).drop("_w")


def rank_shards(rows: DataFrame, world: int, row_no: str = "row_no", n: str = "n") -> DataFrame:
    """The rank that sees each row: every world-th row in turn; the odd rows at the end are dropped."""
    return rows.filter(F.col(row_no) < F.floor(F.col(n) / world) * world).withColumn("rank", (F.col(row_no) % world).cast("int"))


def shuffled_batches(docs: DataFrame, key: str, size: int, seed: str) -> DataFrame:
    """key, batch_no, slot in the order of a seeded hash; a short last batch is dropped unless it is the only one."""
    h = seeded(seed, F.col(key))
    rows = docs.select(key, h.alias("h"))
    rows = numbered(rows, F.floor(F.col("h") / (1 << 48)).cast("long"), ["h", key], "at", "n")
    rows = rows.withColumn("batch_no", F.floor(F.col("at") / size)).withColumn("slot", (F.col("at") % size).cast("int"))
    return rows.filter((F.col("batch_no") < F.floor(F.col("n") / size)) | (F.col("n") < size)).select(key, "batch_no", "slot")


def checked_ids(seqs: DataFrame, ids: str, vocab: int) -> DataFrame:
    """The rows; a job over one with an id outside 0 .. vocab - 1 fails and names it."""
    bad = F.filter(ids, lambda i: (i < 0) | (i >= vocab))
    return seqs.withColumn(ids, F.when(F.size(bad) == 0, F.col(ids)).when(F.col(ids).isNull(), F.col(ids)).otherwise(F.raise_error(F.concat(F.lit("id out of range: "), F.get(bad, 0).cast("string")))))


def first_batches(batches: DataFrame, n: int, batch_no: str = "batch_no") -> DataFrame:
    """The rows of the first n batches."""
    if n < 1:
        raise ValueError("n must be positive")
    return batches.filter(F.col(batch_no) < n)


def strided_windows(seqs: DataFrame, key: str, n: str, stride: int, size: int, exact: bool = False) -> DataFrame:
    """From key, n: evaluation windows (window_no, start, stop, overlap, scored). A window's first new label is the token after the
    overlap; the plain count leaves out one token at each overlapped border, the exact one doesn't."""
    if not 0 < stride <= size:
        raise ValueError("0 < stride <= size")
    starts = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    rows = seqs.select(key, n, F.posexplode(starts).alias("window_no", "start")).withColumn("stop", F.least(F.col("start") + size, F.col(n)))
    before = F.when(F.col("window_no") > 0, F.least(F.col("start") - stride + size, F.col(n))).otherwise(0)
    rows = rows.withColumn("overlap", F.greatest(F.lit(0), before - F.col("start")))
    lost = F.when(F.lit(exact) & (F.col("overlap") > 0), F.col("overlap") - 1).otherwise(F.col("overlap"))
    return rows.withColumn("scored", F.greatest(F.lit(0), F.col("stop") - F.col("start") - 1 - lost)).drop(n)
