"""Line deduplication by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_CHARS, WORD_GAP, alone, joined, own_names, partitions, read, text_of, whole_groups, written
from .components import Forest, components

#: Edits are counted in words: two lines may differ by one for each PER words of the shorter one, TAU at most.
TAU, PER = 2, 10
#: Lines of a portion of a large key, at least and at most; lines remembered by a task that drops repeats early.
LEAST, CELL, REMEMBERED = 128, 2048, 1 << 18
KEYS = "key long, line long, role int"
MASK = (1 << 64) - 1


def allowed(n: int, tau: int = TAU, per: int = PER) -> int:
    """Edits by which a line of n units may differ from one that is no shorter."""
    return max(0, min(tau, n // per, n - 1))


def segments(n: int, tau: int) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 segments of a line of n units; the last ones are longer by one."""
    k = tau + 1
    short, longer = n // k, n % k
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


def probes(n: int, l: int, tau: int) -> list[tuple[int, int, int]]:  # noqa: E741
    """(segment, start, length) of the parts of a line of n units that may equal a segment of a line of l <= n:
    the multi-match-aware choice, which takes the start from the left and from the right."""
    d = n - l
    out = []
    for i, (p, size) in enumerate(segments(l, tau)):
        lo = max(0, p - i, p + d - (tau - i))
        hi = min(n - size, p + i, p + d + (tau - i))
        out += [(i, at, size) for at in range(lo, hi + 1)]
    return out


_SEGMENTS: dict = {}


def _plan(n: int, tau: int, per: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(start, length, salt) of a line's keys, its own segments and the stretches that may equal those of lines no longer, and the keys' roles. The salt tells
    segments and indexed lengths apart."""
    if (n, tau, per) not in _SEGMENTS:
        if len(_SEGMENTS) > 50_000:
            _SEGMENTS.clear()
        t = allowed(n, tau, per)
        own = [(p, size, n * (tau + 1) + i) for i, (p, size) in enumerate(segments(n, t))] if t else []
        others = [(p, size, l * (tau + 1) + i) for l in range(max(1, n - tau), n + 1) if n - l <= (t := allowed(l, tau, per)) and t for i, p, size in probes(n, l, t)]  # noqa: E741
        both = set(own) & set(others)
        others = [x for x in others if x not in both]
        _SEGMENTS[n, tau, per] = own + others, [3 if x in both else 1 for x in own] + [2] * len(others)
    return _SEGMENTS[n, tau, per]


def units(line: str, words: bool) -> str | list[str]:
    return line.split(" ") if words else line


def _key(x: str | list[str], at: int, size: int, salt: int) -> int:
    part = x[at : at + size]
    return xxhash.xxh64_intdigest((part if isinstance(part, str) else " ".join(part)).encode(), salt)


def edit_within(a: str | list[str], b: str | list[str], tau: int) -> bool:
    """Whether the edit distance of a and b is tau or less: a common start and end are left out, and the rest goes through a
    bit-parallel band of 2 * tau + 1 diagonals, given up once every diagonal has passed tau."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > tau:
        return False
    if a == b:
        return True
    lo, hi = 0, len(a)
    while lo < hi:  # the longest common start, by halving
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if not a:
        return len(b) <= tau
    # Sets of reachable diagonals, one bit each, for 0, 1, ... tau edits (a[:i] against b[:i + d], bit d + tau).
    width = 2 * tau + 1
    full = (1 << width) - 1
    reach = [0] * (tau + 1)
    for e in range(tau + 1):  # before a[0]: e letters of b are put in
        reach[e] = sum(1 << (tau + d) for d in range(e + 1))
    m = len(b)
    for i, ch in enumerate(a):
        same = 0
        for k in range(width):
            j = i + k - tau
            if 0 <= j < m and b[j] == ch:
                same |= 1 << k
        new, below, below_new = [], 0, 0
        for e in range(tau + 1):
            r = reach[e] & same  # equal letters
            if e:
                r |= below | (below >> 1) | (below_new << 1)  # another letter, a letter of a less, a letter of b more
            r &= full
            new.append(r)
            below, below_new = reach[e], r
        reach = new
        if not reach[tau]:
            return False
    return bool(reach[tau] >> (tau + m - len(a)) & 1)


def _signatures(tau: int, per: int, words: bool):
    """Keys under which a line is an index entry (role 1), is looked up (2), or both (3). Repeats that a task has just
    seen are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        h64 = xxhash.xxh64_intdigest
        for batch in batches:
            keys, lines, roles = [], [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist() if words else batch.column(1).to_pylist()
            for line, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if line in seen:
                    continue
                parts = text.split(b" ") if words else text
                if len(parts) < per:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(line)
                plan, own_roles = _plan(len(parts), tau, per)
                if words:  # stretches of words are cut out of the line by where these end
                    end = [0, *accumulate(map(len, parts))]
                    keys += [h64(text[end[p] + p : end[p + size] + p + size - 1], salt) for p, size, salt in plan]
                else:
                    keys += [h64(text[p : p + size].encode(), salt) for p, size, salt in plan]
                lines += [line] * len(plan)
                roles += own_roles
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(lines, pa.int64()), pa.array(roles, pa.int32())], names=["key", "line", "role"])

    return run


def _candidates(most: int):
    """From rows sorted by (key, line): of the keys that pair different lines, the members, dealt into cells. A key's lines are cut into portions of an
    eighth of them, though no less than LEAST and no more than `most` lines; a cell holds one or two portions, so no cell grows with the key."""
    names = ["cell", "key", "line", "role", "portion"]

    def out(key, line, role) -> pa.RecordBatch:
        # a line that stands twice under a key (met in two tasks, or at two places) is one member with both roles
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])])) if len(key) else np.zeros(0, int)
        role = np.bitwise_or.reduceat(role, first) if len(first) else role
        key, line = key[first], line[first]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        size = np.diff(np.append(start, len(key)))
        index = np.add.reduceat((role & 1).astype(int), start) if len(start) else size
        live = np.repeat((size > 1) & (index > 0), size)
        portion = np.repeat(np.clip(size // 8, min(LEAST, most), most), size)[live]
        at = (np.arange(len(key)) - np.repeat(start, size))[live] // portion
        parts = -(-np.repeat(size, size)[live] // portion)
        key, line, role = key[live], line[live], role[live]
        # member of portion p goes to the cells (0, p) ... (p, p) ... (p, last)
        rep = np.repeat(np.arange(len(key)), parts)
        other = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
        a, b = np.minimum(at[rep], other), np.maximum(at[rep], other)
        with np.errstate(over="ignore"):
            cell = key[rep] + (a * 1_000_003 + b).astype(np.int64) * np.int64(-7046029254386353131)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(key[rep]), pa.array(line[rep]), pa.array(role[rep].astype(np.int32)), pa.array(np.where(a == b, -1, at[rep]).astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1 << 18):
            yield out(*(table.column(i).to_numpy() for i in range(3)))

    return run


def _verify(tau: int, per: int, words: bool):
    """Of each cell, the links: for every line with one, the number of its links that this cell is the first to show, and the
    root of a spanning forest."""

    def links(key: int, rows: list[tuple]) -> tuple[list, list, list]:
        count, forest = [0] * len(rows), Forest(len(rows))
        # of each indexed line: its segments, and which of them the key is
        index: list[tuple[int, list, int]] = []
        for i, x in enumerate(rows):
            if x[1] & 1:
                own = segments(len(x[3]), allowed(len(x[3]), tau, per))
                at = next(k for k, (p, size) in enumerate(own) if _key(x[3], p, size, len(x[3]) * (tau + 1) + k) == key & MASK)
                index.append((i, [x[3][p : p + size] for p, size in own[:at]], at))
        n = len(rows[index[0][0]][3]) if index else 0  # a key is of one length
        t = allowed(n, tau, per)
        before: dict[int, list[tuple[int, int, int]]] = {}
        for j, (id_s, role, part_s, s) in enumerate(rows):
            if not role & 2 or not index:
                continue
            if len(s) not in before:
                before[len(s)] = probes(len(s), n, t)
            for i, own, at in index:
                id_r, _, part_r, r = rows[i]
                if i == j or (n == len(s) and id_r >= id_s) or (part_r >= 0 and part_r == part_s) or n > len(s):
                    continue
                # a pair that shares an earlier segment of r is counted under that one's key
                if at and any(k < at and s[p : p + size] == own[k] for k, p, size in before[len(s)]):
                    continue
                if edit_within(r, s, t):
                    count[i] += 1
                    count[j] += 1
                    forest.join(i, j)
        hit = [i for i, c in enumerate(count) if c]
        return [rows[i][0] for i in hit], [rows[forest.root(i)][0] for i in hit], [count[i] for i in hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, rows = None, None, []

        def out():
            if len(rows) > 1:
                a, b, n = links(key, rows)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for cell, key_, line, role, part, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if cell != now:
                    yield from out()
                    now, key, rows = cell, key_, []
                rows.append((line, role, part, units(text, words)))
        yield from out()

    return run


def line_table(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, line_no (from 0), the column row if named, norm, line of every line with a word: norm has single spaces and bare
    ends, line is its 64-bit hash."""
    own = [row] if row else []
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own, F.posexplode(F.split(text_of(), "\n")).alias("line_no", "raw"))
    bare = F.btrim("raw", F.lit(GAP_CHARS))
    d = d.filter(bare != "").select("doc_id", "line_no", *own, _spaced(bare).alias("norm"))
    return d.withColumn("line", F.xxhash64("norm"))


def _spaced(bare: Column) -> Column:
    """Single spaces between words; most lines have them, and a search costs less than a new text."""
    return F.when(bare.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(bare, WORD_GAP, " ")).otherwise(bare)


def line_classes(docs: DataFrame, tau: int = TAU, per: int = PER, row: str | None = None, cell: int = CELL, words: bool = True) -> DataFrame:
    """doc_id, line_no, class_doc_id, class_line_no, n_copies, n_links, kept of every line that holds a word.

    Lines with equal words are one line. Two different lines link if they differ by at most one edit (a word put in, left out or replaced) for each `per` words
    of the shorter one, and at most tau edits; unless `words`, code points take the place of words. n_links counts a line's links, n_copies its occurrences. Classes are what links connect. The first
    occurrence in a class, by doc_id (null first), then line_no, names it and is the one that is kept.

    The join cuts a line into one segment more than it may differ by edits, of which two linked lines share one; hashes of segments and of the stretches of lines
    no shorter that may equal them meet by key. Only lines that meet another have their text looked up, and each cell of at most two
    portions of a key is verified by one task, which returns link counts and a spanning forest instead of pairs.

    Null and empty texts have no lines. Rows that repeat a doc_id are one document: the same line at the same place is
    kept in all or none of them. Where row names a column that is different in all rows, each row is a document of its own: the
    column is in the result, breaks ties of doc_id and line_no, and one line of a class is kept. An empty table gives no rows. Lines are told apart by 64-bit hashes, links by texts.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    at = ["doc_id", "line_no", *([row] if row else [])]
    occ = written(line_table(docs, row).select(*at, "line", "norm"), "lines")
    first = occ.groupBy("line").agg(F.min(F.struct(*at)).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    long = occ.select("line", "norm")  # lines too short to differ are left out there
    keys = long.mapInArrow(_signatures(tau, per, words), KEYS).repartition(n, "key").sortWithinPartitions("key", "line")
    cand = written(keys.mapInArrow(_candidates(cell), "cell long, key long, line long, role int, portion int"), "line-cand")
    first = written(first, "line-first")
    # One text of each candidate line, from one of its places.
    place = cand.select("line").distinct().join(first, "line").select(F.col("line").alias("want"), "first")
    same = (F.col("line") == F.col("want")) & (F.struct(*at).eqNullSafe(F.col("first")))
    texts = occ.join(place, same).select("line", "norm").dropDuplicates(["line"])
    cells = cand.join(texts, "line").select("cell", "key", "line", "role", "portion", "norm").repartition(n, "cell").sortWithinPartitions("cell", "line")
    found = written(cells.mapInArrow(_verify(tau, per, words), "a long, b long, n long"), "line-links")
    roots = components(found.select("a", "b"), "line-cc")
    n_links = found.groupBy("a").agg(F.sum("n").alias("n_links"))
    linked = roots.join(n_links, F.col("node") == F.col("a"), "left").select(F.col("node").alias("line"), "root", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    linked = first.join(linked, "line").select("line", "root", "n_links", "first")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    linked = written(linked.join(heads, "root").select("line", "n_links", "head"), "line-classes")
    each = first.join(linked, "line", "left").select("line", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("head", "first").alias("head"))
    out = joined(occ.drop("norm"), each, "line", first, "n_copies")
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("line_no") == F.col("head.line_no"))
    if row:
        kept = kept & (F.col(row) == F.col(f"head.{row}"))
    return out.select(*at, F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"), "n_copies", "n_links", kept.alias("kept"))


def without_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """The documents without the lines that are not kept, in the columns of docs; n_chars, if there, counts the new text.
    Lines without words stay. A document that loses all its lines with words goes; one that had none stays.

    Each row is judged by itself, whatever its doc_id: rows with a null or repeated doc_id lose their own repeated lines only.
    Where such rows hold a line at the same place, one of them (any) keeps it. Null and empty texts stay. Inner columns take names that docs
    doesn't have. An empty table gives no rows."""
    row, drop, left_ = own_names(docs, "line_row", "line_drop", "line_text")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "line-rows")  # the ids must not change between uses
    drops = alone(docs.sparkSession, "line-drops", lambda: line_classes(rows, row=row, **how).filter("not kept").groupBy(row).agg(F.collect_set("line_no").alias(drop)))
    d = rows.join(drops.hint("merge"), row, "left")  # the drops grow with the documents, so they are sent nowhere whole
    left = F.filter(F.split(text_of(), "\n"), lambda x, i: ~F.array_contains(drop, i))
    d = d.withColumn(left_, F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    d = d.filter(F.col(drop).isNull() | (F.btrim(left_, F.lit(GAP_CHARS)) != ""))
    new = {"text": F.col(left_), "n_chars": F.char_length(left_).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return d.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(read(spark, sf_dir, "documents"))


QUERIES = {"op7_segments": op7_segments}
ORACLES: dict[str, str] = {}
