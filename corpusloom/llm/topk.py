"""Exact top-k inner products by MaxScore over sharded postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import partitions, read, written

K, SCALE, QUERY_STEP = 5, 256, 50
#: Rows of a block of postings and of a shard, and queries that go through a block together: these bound what a task holds.
BLOCK_ROWS, SHARD_ROWS, TOGETHER = 4096, 65_536, 256
#: Rows of largest impact that a list keeps, lists whose heads give a first bar, non-essential lists probed at a time.
HEADS, FIRST, PROBED = 16, 4, 8


class Block:
    """Postings of some rows. A term is a dimension and a sign: its list holds the rows whose component has that sign, with the component's size as
    impact. As vectors are dense, the lists stand side by side as columns, with 0 where a row is in a list no place of its own; with each go the
    largest impact and the rows of largest impact (heads)."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray):
        self.rows, self.ids, self.v = rows, ids, v
        self.lists = np.concatenate([np.maximum(v, 0), np.maximum(-v, 0)], axis=1)
        self.most = self.lists.max(axis=0)
        n = min(HEADS, len(v))
        self.heads = np.argpartition(-self.lists, n - 1, axis=0)[:n]
        self.floats = self.lists.astype(np.float64), self.v.astype(np.float64)

    def best(self, own: np.ndarray, w: np.ndarray, k: int, bars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (a row of w), of this block's rows but its own: places and scores of the k of largest inner product that reach its bar, ties to the
        smaller id.

        Terms of the query's own sign add to a score, others only take away: these have the bound 0 and are never
        essential. The bar is the k-th best score that the query has met in blocks before this one (-inf: none); then the heads of its strongest terms
        give one. Terms by rising bound are non-essential as long as their bounds sum to less than the bar: a row in none of the other lists
        can't reach it. The essential lists are traversed, for all queries together; rows that can still reach the bar are probed in the non-essential lists,
        largest bounds first, and dropped as soon as they can't; what is left is scored in full.
        """
        weight = np.concatenate([np.maximum(w, 0), np.maximum(-w, 0)], axis=1)
        # sums of whole numbers are exact in floats up to 2^53, where a matrix product is many times as fast
        small = float(self.most.max(initial=0)) * float(weight.max(initial=0)) * self.v.shape[1] < 2.0**52
        lists, v = self.floats if small else (self.lists, self.v)
        weight, w_ = (weight.astype(np.float64), w.astype(np.float64)) if small else (weight, w)
        bound = weight * self.most
        order = np.argsort(bound, axis=1)
        sums = np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1)
        bars = bars.copy()
        for q in np.flatnonzero(np.isneginf(bars)):
            heads = np.unique(self.heads[:, order[q, -FIRST:]])
            heads = heads[self.rows[heads] != own[q]]
            if len(heads) >= k:
                bars[q] = np.partition(self.v[heads] @ w[q], len(heads) - k)[len(heads) - k]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(w)
        every = np.flatnonzero(bars <= 0)  # rows in no list at all may be among the best
        if len(every):
            score = v @ w_[every].T
            for c, q in enumerate(every):
                out[q] = self._top(np.flatnonzero((score[:, c] >= bars[q]) & (self.rows != own[q])), w[q], k)
        less = sums < bars[:, None]
        some = np.flatnonzero((bars > 0) & ~less.all(axis=1))
        if len(some):
            essential = np.zeros_like(less)
            np.put_along_axis(essential, order, ~less, axis=1)
            rest = np.where(less, sums, 0).max(axis=1)
            met = lists @ (weight[some] * essential[some]).T
            hit = (met > 0) & (met + rest[some] >= bars[some])
            for c, q in enumerate(some):
                cand = np.flatnonzero(hit[:, c])
                cand = cand[self.rows[cand] != own[q]]
                left = order[q, : int(less[q].sum())]
                left = left[bound[q, left] > 0]
                got, more = met[cand, c], rest[q]
                for at in range(len(left), 0, -PROBED):
                    if len(cand) <= 4 * k:
                        break
                    terms = left[max(0, at - PROBED) : at]
                    got = got + lists[np.ix_(cand, terms)] @ weight[q, terms]
                    more = more - bound[q, terms].sum()
                    stay = got + more >= bars[q]
                    cand, got = cand[stay], got[stay]
                out[q] = self._top(cand, w[q], k, bars[q])
        return out

    def _top(self, cand: np.ndarray, w: np.ndarray, k: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        score = self.v[cand] @ w
        cand, score = cand[score >= bar], score[score >= bar]
        top = np.lexsort((self.ids[cand], -score))[:k]
        return cand[top], score[top]


def _matrix(vecs: pa.Array, width: int) -> np.ndarray:
    """From lists of components a matrix, short vectors filled up with zeros to the width of the longest, or `width`."""
    n = np.diff(vecs.offsets.to_numpy()).astype(int)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))), np.int64)
    flat = vecs.flatten().to_numpy()
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _search(k: int):
    """From rows (shard, kind, row, id, v) sorted by shard and kind: a shard's own rows (kind 0) come first and are made into blocks, then each query (kind 1)
    goes through them block by block, its bar rising with what it has found. Ids are without nulls: a null id is the largest long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, parts, width = None, [], [], 0

        def close() -> None:
            if parts:
                rows, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                v = np.concatenate([np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in parts])
                blocks.append(Block(rows, ids, v))
                parts.clear()

        def answered(rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            best: list[list[tuple[int, int]]] = [[] for _ in rows]  # (-score, id), the best first
            for block in blocks:
                n = block.v.shape[1]
                w = v[:, :n] if v.shape[1] >= n else np.pad(v, ((0, 0), (0, n - v.shape[1])))
                bars = np.array([-b[-1][0] if len(b) == k else -np.inf for b in best])
                for q, (at, score) in enumerate(block.best(rows, w, k, bars)):
                    if len(at):
                        best[q] = sorted([*best[q], *zip((-score).tolist(), block.ids[at].tolist(), strict=True)])[:k]
            n = [len(b) for b in best]
            hits = np.array([x for b in best for x in b], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, n)), pa.array(np.repeat(ids, n)), pa.array(hits[:, 1]), pa.array(-hits[:, 0])], names=["row", "query_id", "vec_id", "score"])

        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])) if len(shard) else np.zeros(0, int)
            for lo, hi in zip(edge, [*edge[1:], len(shard)], strict=True):
                if shard[lo] != now:
                    now, width = shard[lo], 0
                    blocks.clear()
                    parts.clear()
                part = batch.slice(lo, hi - lo)
                rows, ids, v = part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4), 0)
                if kind[lo] == 0:
                    for at in range(0, len(rows), BLOCK_ROWS):
                        parts.append((rows[at : at + BLOCK_ROWS], ids[at : at + BLOCK_ROWS], v[at : at + BLOCK_ROWS]))
                        width = max(width, v.shape[1])
                        if sum(len(p[0]) for p in parts) >= BLOCK_ROWS:
                            close()
                    continue
                close()
                for lo_ in range(0, len(rows), TOGETHER):
                    yield answered(rows[lo_ : lo_ + TOGETHER], ids[lo_ : lo_ + TOGETHER], v[lo_ : lo_ + TOGETHER])

    return run


NO_ID = (1 << 63) - 1


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, row: str = "id") -> DataFrame:
    """From id, v (array<long>) of both sides: query_id, rank, vec_id, score of the k best rows of each query, ties to the smaller id, null ids last.

    Vectors are dealt into shards of at most about shard_rows by a hash; queries go to every shard as rows of their own, after the shard's rows, so a
    shard is built once however many queries there are, and a task holds one shard and one batch of queries. A shard returns k rows a
    query, and the shards' lists are merged by score. `row` names the column that tells rows apart (a long): the query's own row is no candidate, other
    rows that share its id are. Where it is the id itself (the default), all rows of the query's id are left out, queries equal in id and vector are one query, and
    those equal in id alone have their lists merged into one of k rows. Components must be such that inner products stay within 64 bits. A null vector must not be among them; empty
    vectors score 0. An empty table, or one without other rows, gives no rows. Columns besides id, v and `row` are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.count()
    n = max(1, -(-rows // shard_rows), min(partitions(spark), -(-rows // BLOCK_ROWS)))
    side = lambda df, kind, shard: df.select(shard.alias("shard"), F.lit(kind).alias("kind"), F.col(row).cast("long").alias("row"), F.coalesce("id", F.lit(NO_ID)).cast("long").alias("id"), "v")
    own = side(vectors, 0, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    asked = side(queries.select(*{row, "id", "v"}).distinct(), 1, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = own.union(asked).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "kind")
    hits = written(dealt.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long"), "hits")
    by = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    found = hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return found.select(*[F.nullif(F.col(c), F.lit(NO_ID)).alias(c) if c.endswith("_id") else F.col(c) for c in ("query_id", "rank", "vec_id", "score")])


def quantised(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding -> id, v with floor(scale * component). Null vectors and vectors with a null or non-finite
    component are left out; an empty vector scores 0 with every other; null ids stay."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.filter(x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(quantised(read(spark, sf_dir, "embeddings")).withColumn("row", F.monotonically_increasing_id()), "vectors")  # the numbers must not change between uses
    return top_k(v, v.filter(F.col("id") % QUERY_STEP == 0), row="row")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

QUERIES = {"op1_maxscore": op1_maxscore}
ORACLES = {"op1_maxscore": OP1_SQL}
