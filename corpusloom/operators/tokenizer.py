"""Byte-pair encoding: word table in Spark, merges over words that stay in tasks, encoding in Arrow batches."""

from __future__ import annotations

import heapq
import itertools
import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from multiprocessing.connection import Client, Connection, Listener
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import BarrierTaskContext, InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written

BYTES, TARGET = 256, 2048
#: The names of special tokens, and the least code points of a text to train on.
SPECIALS = ("<|pad|>", "<|bos|>", "<|eos|>", "<|unk|>")
LEAST_CHARS = 100
#: Words for which a task of the training is worth its while.
PART_WORDS = 1 << 16
#: Rows of a batch that a task counts, or encodes and decodes, at once.
ROWS = 2048


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...
    def decode(self, ids: list[int], strict: bool = False) -> str: ...
    def vocab_size(self) -> int: ...


#: T.PIECE in Python's syntax.
_GAP = "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
PIECE = re.compile(f"[{_GAP}]*[^{_GAP}]+|[{_GAP}]+")


def word_table(docs: DataFrame) -> DataFrame:
    """word, freq, first_doc, first_pos of the pieces of all texts; the order of first sight is (doc_id, place). Each batch counts its own pieces first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            rows = pa.compute.sort_indices(batch.column(0), null_placement="at_start")
            freq: Counter[str] = Counter()
            first: dict[str, tuple[int, int]] = {}
            for row, text in zip(rows.to_pylist(), batch.column(1).take(rows).to_pylist(), strict=True):
                found = PIECE.findall(text)
                freq.update(found)
                for pos, word in enumerate(found):
                    if word not in first:
                        first[word] = row, pos
            at = pa.array([x[0] for x in first.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array([freq[w] for w in first], pa.int64()), batch.column(0).take(at), pa.array([x[1] for x in first.values()], pa.int32())], names=["word", "freq", "doc", "pos"])

    texts = docs.select("doc_id", T.nothing_null("text").alias("text"))
    rows = texts.mapInArrow(run, f"word string, freq long, doc {docs.schema['doc_id'].dataType.simpleString()}, pos int")
    return rows.groupBy("word").agg(F.sum("freq").alias("freq"), F.min(F.struct("doc", "pos")).alias("first")).select("word", "freq", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def pair_counts(words: DataFrame) -> DataFrame:
    """left, right (bytes as numbers), n: neighbouring bytes over the word table, weighed by frequency."""
    hexed = F.hex(F.encode("word", "UTF-8"))
    byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.octet_length("word") - 2), lambda i: F.struct(byte(i).alias("left"), byte(i + 1).alias("right")))
    rows = words.filter(F.octet_length("word") > 1).select("freq", F.explode(pairs).alias("p"))
    return rows.groupBy("p.left", "p.right").agg(F.sum("freq").alias("n"))


class Part:
    """Some of the words as arrays over their bytes: the symbol that begins at a byte (HOLE within one) and the symbol that ends there, with GAP around each
    word. A merge writes three places for each pair, so nothing moves, and a pair's place is its byte."""

    def __init__(self, batches: Iterator[pa.RecordBatch], vocab: int):
        """Batches of word, freq, first_doc, first_pos."""
        kind = np.uint16 if vocab < 0xFFFE else np.uint32
        self.gap, self.hole = np.iinfo(kind).max, np.iinfo(kind).max - 1
        self.size = np.ones(vocab, np.int64)
        bytes_, sizes, freqs, docs, places = [np.full(1, self.gap, kind)], [], [], [], []
        self.pairs = np.zeros(BYTES * BYTES, np.int64)
        for batch in batches:
            word = batch.column(0).cast(pa.large_string())
            if not len(word):
                continue
            ends = np.frombuffer(word.buffers()[1], np.int64)[word.offset : word.offset + len(word) + 1]
            size, freq = np.diff(ends), batch.column(1).to_numpy().astype(np.int64)
            row = np.full(int(ends[-1] - ends[0]) + len(word), self.gap, kind)
            row[np.arange(ends[-1] - ends[0]) + np.repeat(np.arange(len(word)), size)] = np.frombuffer(word.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            inside = (row[:-1] != self.gap) & (row[1:] != self.gap)
            key = row[:-1][inside].astype(np.int64) * BYTES + row[1:][inside]
            self.pairs += np.bincount(key, np.repeat(freq, size + 1)[:-1][inside], BYTES * BYTES).astype(np.int64)
            for to, x in zip((bytes_, sizes, freqs, docs, places), (row, size, freq, batch.column(2), batch.column(3)), strict=True):
                to.append(x)
        self.head = np.concatenate(bytes_)
        self.tail = self.head.copy()
        self.freq = np.concatenate(freqs) if freqs else np.zeros(0, np.int64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.start = np.cumsum(size + 1) - size
        self.doc, self.place = (pa.chunked_array(x) if x else pa.chunked_array([pa.array([], pa.int64())]) for x in (docs, places))
        order = pa.compute.sort_indices(pa.table({"d": self.doc, "p": self.place}), [("d", "ascending"), ("p", "ascending")], null_placement="at_start")
        self.turn = np.empty(len(order), np.int64)
        self.turn[order.to_numpy()] = np.arange(len(order))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of neighbouring bytes (left and right, 32 bits each), and how often they are there."""
        at = np.flatnonzero(self.pairs)
        return (at // BYTES << 32) | at % BYTES, self.pairs[at]

    def _at(self, a: int, b: int) -> np.ndarray:
        at = np.flatnonzero(self.head == a)
        return at[self.head[at + self.size[a]] == b]

    def first(self, pairs: list[tuple[int, int]]) -> list[tuple | None]:
        """Where each pair is first seen: the first_doc and first_pos of its word, and the byte in it."""
        out: list[tuple | None] = []
        for a, b in pairs:
            at = self._at(a, b)
            word = np.searchsorted(self.start, at, "right") - 1
            if len(at):
                k = word[np.argmin(self.turn[word])]
                out.append((self.doc[k].as_py(), self.place[k].as_py(), int(at[word == k][0] - self.start[k])))
            else:
                out.append(None)
        return out

    def merge(self, a: int, b: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Every a b from the left becomes c. Keys of all pairs that go or come thereby, and by how much their counts change."""
        at = self._at(a, b)
        if a == b and len(at):  # every second one of a run
            opens = np.diff(at, prepend=-1 - self.size[a]) != self.size[a]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
        self.size[c] = self.size[a] + self.size[b]
        right, end = at + self.size[a], at + self.size[c]
        before, after = self.tail[at - 1].astype(np.int64), self.head[end].astype(np.int64)
        joined = end[:-1] == at[1:]  # to the next one
        has, goes_on = before != self.gap, after != self.gap
        goes_on[:-1] &= ~joined
        left_now = before.copy()
        left_now[1:][joined] = c
        f = self.freq[np.searchsorted(self.start, at, "right") - 1]
        self.head[at], self.head[right], self.tail[end - 1] = c, self.hole, c
        keys = [np.full(len(at), a << 32 | b), before[has] << 32 | a, b << 32 | after[goes_on], left_now[has] << 32 | c, c << 32 | after[goes_on]]
        by = [-f, -f[has], -f[goes_on], f[has], f[goes_on]]
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(which, np.concatenate(by), len(key)).astype(np.int64)


def _learned(ask: Callable[..., list], vocab: int) -> list[tuple[bytes, bytes]]:
    """learn_merges over parts; ask(method, ...) has the replies of all. Here are a number for each different pair and the vocabulary."""
    names = [bytes([b]) for b in range(BYTES)]
    ids = {x: i for i, x in enumerate(names)}
    slot: dict[int, int] = {}
    pairs, counts = [], np.zeros(1 << 16, np.int64)
    seen: dict[int, tuple] = {}
    out: list[tuple[bytes, bytes]] = []

    def change(replies: list[tuple[np.ndarray, np.ndarray]]) -> None:
        nonlocal counts
        for keys, by in replies:
            for k, n in zip(keys.tolist(), by.tolist(), strict=True):
                if k not in slot:
                    slot[k] = len(pairs)
                    pairs.append(k)
                    if len(pairs) > len(counts):
                        counts = np.concatenate([counts, np.zeros_like(counts)])
                counts[slot[k]] += n
                seen.pop(k, None)

    change(ask("counts"))
    while len(names) < vocab:
        now = counts[: len(pairs)]
        most = now.max(initial=0)
        if most < 2:
            break
        best = [pairs[i] for i in np.flatnonzero(now == most)]
        if len(best) > 1 and (new := [k for k in best if k not in seen]):
            for k, *places in zip(new, *ask("first", [(k >> 32, k & 0xFFFFFFFF) for k in new]), strict=True):
                seen[k] = min((d is not None, 0 if d is None else d, p, i) for d, p, i in filter(None, places))  # null first
        k = min(best, key=lambda k: seen[k]) if len(best) > 1 else best[0]
        a, b = k >> 32, k & 0xFFFFFFFF
        name = names[a] + names[b]
        if name not in ids:
            ids[name] = len(names)
            names.append(name)
        out.append((names[a], names[b]))
        change(ask("merge", a, b, ids[name]))
    return out


def learn_merges(words: list[tuple[str, int]], vocab: int) -> list[tuple[bytes, bytes]]:
    """Merges by falling pair count, as long as it is 2 or more and the vocabulary, all bytes at first, is smaller than `vocab`; of equal counts the pair
    that is seen first, in the order of words, then of places. A merge that makes a string which is there already counts as a merge and adds nothing to
    the vocabulary. Counts are kept up to date for the pairs that a merge touches alone."""
    n = pa.array(range(len(words)), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([f for _, f in words], pa.int64()), n, n], names=["word", "freq", "first_doc", "first_pos"])
    part = Part(iter([batch]), max(vocab, BYTES))
    return _learned(lambda method, *args: [getattr(part, method)(*args)], vocab)


def learn_merges_of(words: DataFrame, vocab: int) -> list[tuple[bytes, bytes]]:
    """learn_merges of a word table. Its words stay in the tasks of one barrier stage, as many as run at once, each of which holds 4 bytes for a byte of
    its words. The driver names a merge over a socket, and gets back how the counts of pairs change."""
    spark, vocab = words.sparkSession, max(vocab, BYTES)
    sc = spark.sparkContext
    scala = sc._jsc.sc()
    tasks = max(1, min(scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile()), -(-words.count() // PART_WORDS)))
    host, secret = spark.conf.get("spark.driver.host"), uuid.uuid4().bytes
    failed: list[BaseException] = []
    with Listener((spark.conf.get("spark.driver.bindAddress", host), 0), backlog=tasks + 1, authkey=secret) as door:
        at = (host, door.address[1])

        def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = Part(batches, vocab)
            with Client(at, authkey=secret) as driver:
                driver.send(BarrierTaskContext.get().attemptNumber())
                while order := driver.recv():
                    driver.send(getattr(part, order[0])(*order[1:]))
            yield pa.RecordBatch.from_arrays([pa.array([True])], names=["done"])

        def run() -> None:
            try:
                words.select("word", "freq", "first_doc", "first_pos").repartition(tasks).mapInArrow(serve, "done boolean", barrier=True).collect()  # a row for each task
            except BaseException as e:  # noqa: BLE001
                failed.append(e)
            finally:
                with Client(at, authkey=secret) as over:  # wakes the loop below
                    over.send(None)

        job = InheritableThread(target=run)
        job.start()
        by_attempt: dict[int, list[Connection]] = defaultdict(list)
        out = None
        while True:  # a stage that failed is tried again as a whole, and so is the learning
            found = door.accept()
            if (attempt := found.recv()) is None:
                found.close()
                break
            parts = by_attempt[attempt]
            parts.append(found)
            if len(parts) < tasks:
                continue

            def ask(*order) -> list:
                for p in parts:  # noqa: B023
                    p.send(order)
                return [p.recv() for p in parts]  # noqa: B023

            try:
                out = _learned(ask, vocab)
                for p in parts:
                    p.send(None)
            except (EOFError, OSError):
                out = None
            finally:
                for p in parts:
                    p.close()
        job.join()
    if failed or out is None:
        raise failed[0] if failed else RuntimeError("no merges were learned")
    return out


class BytePairs:
    """A trained tokenizer. Ids: 256 bytes, then merges in their order, which skip the ids of special tokens; these are given by name, or are names alone, which
    take the ids at the end of the target size."""

    def __init__(self, merges: list[tuple[bytes, bytes]], target: int, specials: tuple[str, ...] | dict[str, int] = SPECIALS):
        self.merges, self.target = merges, target
        self.specials = dict(specials) if isinstance(specials, dict) else {s: target - len(specials) + i for i, s in enumerate(specials)}
        if min(self.specials.values(), default=BYTES) < BYTES or len(set(self.specials.values())) < len(self.specials):
            raise ValueError("special tokens need ids of their own past those of bytes")
        self.ids: dict[bytes, int] = {bytes([b]): b for b in range(BYTES)}
        reserved = set(self.specials.values())
        free = (i for i in itertools.count(BYTES) if i not in reserved)
        for a, b in merges:
            if a + b not in self.ids:
                self.ids[a + b] = next(free)
        self.ranks = {p: i for i, p in enumerate(merges)}  # a pair that was merged twice has its last rank
        self.bytes = {i: b for b, i in self.ids.items()}

    @classmethod
    def train(cls, docs: DataFrame, target: int = TARGET, specials: tuple[str, ...] | dict[str, int] = SPECIALS) -> BytePairs:
        """Learns on all texts of docs. The counts of pairs are what reaches the driver; the word table is written, and is split over tasks."""
        if target < BYTES + len(specials):
            raise ValueError("the target must hold all bytes and special tokens")
        chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
        if chars < LEAST_CHARS:
            raise ValueError(f"{chars} characters to train on: {LEAST_CHARS} are needed")
        return cls(learn_merges_of(written(word_table(docs), "words"), target - len(specials)), target, specials)

    def piece(self, word: str) -> list[int]:
        """Ids of one piece: the pair of least rank merges, the leftmost of equal ones, until none has a rank. Parts are linked to their neighbours and
        pairs wait in a heap, so a long piece costs its length times the logarithm of it."""
        part: list[bytes | None] = [bytes([b]) for b in word.encode()]
        n = len(part)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the two has gone into another pair since
            part[i], part[j] = a + b, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := left[i]) >= 0 and (r := rank((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [self.ids[x] for x in part if x is not None]

    def encode(self, text: str) -> list[int]:
        return [i for w in PIECE.findall(text) for i in self.piece(w)]

    def decode(self, ids: list[int], strict: bool = False) -> str:
        names = {i: s for s, i in self.specials.items()}
        out = []
        for i in ids:
            if (b := self.bytes.get(i)) is not None:
                out.append(b)
            elif i in names:
                out.append(names[i].encode())
            elif strict:
                raise ValueError(f"unknown id {i}")
            else:
                out.append(f"<{i}>".encode())
        return b"".join(out).decode("utf-8", "replace")

    def vocab_size(self) -> int:
        return max([*self.ids.values(), *self.specials.values()]) + 1

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.merges)], "rank int, a binary, b binary").write.mode("overwrite").parquet(f"{path}/merges")
        spark.createDataFrame([(self.target, self.specials)], "target int, specials map<string,int>").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BytePairs:
        meta = spark.read.parquet(f"{path}/meta")
        if missing := {"target", "specials"} - set(meta.columns):
            raise ValueError(f"missing fields: {sorted(missing)}")
        row = meta.first()
        merges = [(bytes(r["a"]), bytes(r["b"])) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
        return cls(merges, row["target"], dict(row["specials"]))


def _encode_rows(tokenizer: BytePairs) -> Callable[[pd.Series], list[np.ndarray]]:
    """Ids of each text; different pieces are encoded once and kept from call to call."""
    known: dict[str, array] = {}

    def run(texts: pd.Series) -> list[np.ndarray]:
        if len(known) > 1 << 20:
            known.clear()
        rows = []
        for text in texts:
            ids = array("i")
            for w in PIECE.findall(text):
                if (part := known.get(w)) is None:
                    part = known[w] = array("i", tokenizer.piece(w))
                ids += part
            rows.append(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32))
        return rows

    return run


def encoded(docs: DataFrame, tokenizer: BytePairs) -> DataFrame:
    """doc_id, ids. Each batch encodes its different pieces once; nothing is shuffled."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = _encode_rows(tokenizer)
        for batch in batches:
            yield pd.Series(rows(batch))

    f = F.pandas_udf(run, "array<int>")
    return docs.select("doc_id", f(T.nothing_null("text")).alias("ids"))


def roundtrip(docs: DataFrame, tokenizer: BytePairs) -> DataFrame:
    """doc_id, ids, text: the ids of each text and what they alone decode to, as encoded() and decoded() have them, by one Python worker a task instead of two."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = _encode_rows(tokenizer)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                ids = rows(batch.iloc[i : i + ROWS])
                yield pd.DataFrame({"ids": ids, "text": [tokenizer.decode(x.tolist()) for x in ids]})

    f = F.pandas_udf(run, "ids array<int>, text string")
    return docs.select("doc_id", f(T.nothing_null("text")).alias("r")).select("doc_id", "r.ids", "r.text")


def decoded(ids: Column, tokenizer: BytePairs) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: tokenizer.decode(v.tolist()))

    return run(ids)


def stripped_specials(ids: Column, specials: list[int]) -> Column:
    """Without special ids; repeats of others stay."""
    return F.filter(ids, lambda i: ~F.array_contains(F.array(*[F.lit(s) for s in specials]), i))
