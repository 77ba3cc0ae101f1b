"""SimHash near-duplicates through a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, partitions, read, text_of, whole_groups, written
from .components import Forest, components

SHINGLE, RADIUS, XX_SEED = 3, 3, 42
#: Children of an index node; (query, node) pairs held at once; rows of a bucket from which it is split further.
FAN, FRONTIER, LARGE = 16, 1 << 18, 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if set in over half of the XXH64 of all word shingles, repeats included; no words: 0."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII gaps only, as the contract has it
    n = len(words)
    if not n:
        return 0
    h64, join = xxhash.xxh64_intdigest, b" ".join
    if n <= shingle:
        return h64(join(words), XX_SEED)
    h = np.array([h64(join(words[i : i + shingle]), XX_SEED) for i in range(n - shingle + 1)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):  # bounded, however long the text
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long, a row for each row of docs. Null text: as empty."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("t"))
    return d.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of 64 bits in the reflected Gray order (as signed long)."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


class GrayIndex:
    """A forest of index trees over fingerprints, sorted by (bucket, Gray rank); the leaves are the fingerprints.

    FAN neighbours make a node, as long as they are of one bucket, up to one root for each bucket. A node holds the bits in which
    all its leaves agree (mask) and their values there (pattern); what the parent holds already is left out.
    A search adds up the differences on the way down and drops a whole node once they pass the radius.
    """

    def __init__(self, bucket: np.ndarray, x: np.ndarray):
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(x) else np.zeros(0, int)
        one, zero = x, ~x  # bits that are one (zero) in all leaves below
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
        self.of = group
        self.levels = [(one, one | zero, np.arange(len(x)), np.arange(len(x)) + 1, np.arange(len(x)) + 1)]  # pattern, mask, first child, end, last leaf + 1
        last = self.levels[0][4]
        while True:
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
            if len(self.levels) > 1 and len(first) == len(group):
                break
            within = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            cut = np.flatnonzero(within % FAN == 0)
            end = np.append(cut[1:], len(group))
            if not len(group):
                break
            one, zero = np.bitwise_and.reduceat(one, cut), np.bitwise_and.reduceat(zero, cut)
            last = last[end - 1]
            group = group[cut]
            self.levels.append((one, one | zero, cut, end, last))
        self.x = x

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (i, j), i < j, of a bucket that differ in `radius` bits or fewer, in portions."""
        x, top = self.x, len(self.levels) - 1
        for at in range(0, len(x), FRONTIER // FAN):
            q = np.arange(at, min(len(x), at + FRONTIER // FAN))
            yield from self._down(q, self.of[q], np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64), top, radius)

    def _down(self, q, node, sum_, known, level, radius):
        """known: the mask of the parent, whose differences sum_ has already."""
        pattern, mask, first, end, last = self.levels[level]
        new = mask[node] & ~known
        sum_ = sum_ + np.bitwise_count((self.x[q] ^ pattern[node]) & new).astype(np.int64)
        live = (sum_ <= radius) & (last[node] > q + 1 if level else node > q)
        q, node, sum_ = q[live], node[live], sum_[live]
        if level == 0:
            if len(q):
                yield q, node
            return
        n = end[node] - first[node]
        for lo, hi in _portions(n, FRONTIER):
            k = n[lo:hi]
            child = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[node[lo:hi]], k)
            yield from self._down(np.repeat(q[lo:hi], k), child, np.repeat(sum_[lo:hi], k), np.repeat(mask[node[lo:hi]], k), level - 1, radius)


def _portions(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of n whose sums stay near `most`."""
    if not len(n):
        return
    part = np.cumsum(n) // most
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    yield from zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _spanning(radius: int):
    """Of each bucket, edges that connect what lies within the radius: a forest, so never more edges than rows."""

    def edges(bucket: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        index, forest = GrayIndex(bucket, x), Forest(len(x))
        label = np.arange(len(x))
        for i, j in index.pairs(radius):
            i, j = label[i], label[j]
            for a, b in set(zip(i[i != j].tolist(), j[i != j].tolist(), strict=True)):
                forest.join(a, b)
            for k in np.unique(np.concatenate([i, j])).tolist():
                label[k] = forest.root(k)
            label = label[label]
        root = np.array([forest.root(k) for k in label.tolist()], dtype=np.int64)
        own = np.flatnonzero(root != np.arange(len(x)))
        return pa.RecordBatch.from_arrays([pa.array(x[own].view(np.int64)), pa.array(x[root[own]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, FRONTIER):
            yield edges(table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64))

    return run


def _blocks(bits: list[int], k: int) -> list[list[int]]:
    return [part.tolist() for part in np.array_split(np.array(bits), k)]


def _value(fp: Column, lo: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, lo).bitwiseAND((1 << width) - 1)


def links(fps: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """From distinct fingerprints fp, edges (a, b) that connect all fingerprints `radius` bits or fewer apart.

    Of radius + 1 blocks of the 64 bits, two such fingerprints agree in one at least: rows with equal values of a
    block form a bucket. A bucket of more than `large` rows is split the same way by blocks of the bits left,
    again and again while there are bits for it, so that no value that many fingerprints share makes a large task; the
    split loses no pair. Each bucket is searched with a GrayIndex.
    """
    spark = fps.sparkSession
    n = partitions(spark)
    found = None
    # rows: fp, lo and width of the bits left; bucket: what has been agreed on so far
    rows = fps.select("fp", F.lit(0).cast("long").alias("path"), F.lit("").alias("used"))
    free = {"": [(0, 64)]}
    for depth in range(3):
        ways = {}
        for used, ranges in free.items():
            bits = [b for lo, width in ranges for b in range(lo, lo + width)]
            ways[used] = _blocks(bits, radius + 1)
        each = [
            F.struct(F.lit(f"{used}/{k}").alias("used"), _gather(F.col("fp"), block).alias("v"), F.lit(used).alias("was"))
            for used, blocks in ways.items() for k, block in enumerate(blocks)
        ]
        rows = rows.withColumn("k", F.explode(F.filter(F.array(*each), lambda s: s["was"] == F.col("used"))))
        rows = rows.select("fp", F.xxhash64("path", "k.used", "k.v").alias("path"), F.col("k.used").alias("used"))
        free = {f"{used}/{k}": _ranges(sorted(set(b for o, other in enumerate(blocks) if o != k for b in other))) for used, blocks in ways.items() for k, _ in enumerate(blocks)}
        if depth < 2:
            rows = written(rows, "gray")
            heavy = rows.groupBy("path").count().filter(F.col("count") > large).select("path")
            heavy = written(heavy, "gray-large")
            any_heavy = bool(heavy.take(1))
        else:
            any_heavy = False
        light = rows.join(heavy, "path", "left_anti") if any_heavy else rows
        part = light.select("path", "fp", gray_rank(F.col("fp")).alias("g")).repartition(n, "path").sortWithinPartitions("path", "g").select("path", "fp")
        part = part.mapInArrow(_spanning(radius), "a long, b long")
        found = part if found is None else found.union(part)
        if not any_heavy:
            break
        rows = rows.join(heavy, "path", "left_semi")
    return found


def _gather(fp: Column, bits: list[int]) -> Column:
    out = None
    at = 0
    for lo, width in _ranges(bits):
        piece = F.shiftleft(_value(fp, lo, width), at) if at else _value(fp, lo, width)
        out = piece if out is None else out.bitwiseOR(piece)
        at += width
    return out


def _ranges(bits: list[int]) -> list[tuple[int, int]]:
    """Runs of rising bits as (first, width)."""
    out: list[tuple[int, int]] = []
    for b in bits:
        if out and out[-1][0] + out[-1][1] == b:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((b, 1))
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of at most `radius` bits reach.

    Documents of equal fingerprint are one node; edges run between different fingerprints. Null texts count as
    empty; texts without words have fingerprint 0 and link to each other and to whatever is near 0. Null doc_ids take
    no part in the minimum (a component of none but null ids has a null component_id). Repeated rows give repeated
    rows. Empty table: no rows. Columns besides doc_id and text are not read.
    """
    fps = written(fingerprints(docs, shingle), "fp")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fp-nodes")
    found = written(links(written(nodes.select("fp"), "fp-distinct"), radius), "fp-edges")
    comp = components(found, "fp-cc").select(F.col("node").alias("fp"), "root")
    # Only fingerprints with an edge have a root to look up; the others are their own component.
    least = nodes.join(comp, "fp").groupBy("root").agg(F.min("first").alias("component"))
    linked = written(comp.join(least, "root").select("fp", "component"), "fp-comp")
    ids = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    out = joined(fps, ids, "fp", nodes, "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op10_gray": op10_gray}
ORACLES: dict[str, str] = {}
