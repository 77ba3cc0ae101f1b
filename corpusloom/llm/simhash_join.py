"""Near-duplicates by the similarity of their word shingles, found through SimHash bands searched with the Gray-order index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, joined, own_names, partitions, text_of, whole_groups, written
from .components import Forest, components
from .simhash import XX_SEED, GrayIndex, gray_rank

#: Words of a shingle; similarity (shared over all different shingles) from which two texts link.
SHINGLE, ALIKE = 5, 0.8
#: A signature has BANDS bands of 16 bits. Texts of similarity 0.8 agree in a band with a chance of about 0.07, so
#: they share none of 64 bands once in a hundred times; more alike ones far less often.
BANDS = 64
WORDS = BANDS // 4
#: Bits that candidates may differ by: in the first 64 bits (expected 10 at similarity 0.8, 12 for the shortest texts), and in all.
NEAR, FAR = 22, 16 * BANDS // 4
#: Rows of a portion of a large band value.
CELL = 2048
#: Sets of up to so many shingles are also joined by prefixes, which miss nothing; so pairs are whole whose smaller set has four fifths of it or fewer.
SHORT = 50


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different XXH64 of the word shingles; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()
    h64, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.array([h64(join(words[i : i + shingle]), XX_SEED) for i in range(n)], dtype="<u8"))


def signature(h: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits, each bit set if set in over half of the hashes (in their mixes, from the second word on)."""
    k = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(h), 255):  # counts of a portion fit into a byte
        x = h[at : at + 255, None] + k
        y = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        y ^= y >> np.uint64(31)
        y[:, 0] = x[:, 0]
        bits = np.unpackbits(y.view(np.uint8).reshape(len(y), -1), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")


def _node(h: np.ndarray) -> int:
    """What names a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), XX_SEED)).astype(np.int64))


def _signed(shingle: int):
    """Of each text: its node, signature, and if it is a short one its shingles (32 bits of each hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sig, few = [], [], []
            for x in batch.column(1):
                h = shingle_hashes(x.as_py(), shingle)
                node.append(_node(h))
                sig.append(signature(h).tobytes())
                few.append(np.unique(h.astype(np.uint32)).tobytes() if len(h) <= SHORT else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(few, pa.binary())], names=["doc_id", "node", "sig", "few"])

    return run


def _prefixes(alike: float):
    """A row for each of a short set's first shingles, by their hashes: as many as it takes for two sets that are alike enough to share one."""
    part = round(alike * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, at = [], []
            for i, few in enumerate(batch.column(2).to_pylist()):
                h = np.frombuffer(few, np.uint32)
                n = len(h) - -(-part * len(h) // 1000) + 1
                key.append(h[:n].astype(np.int64))
                at.append(np.full(len(h[:n]), i))
            at = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
            fp = np.array([int.from_bytes(x[:8], "little") for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*key, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(fp[at]), rows.column(0), rows.column(1), rows.column(2)], names=["key", "fp", "node", "sig", "shingles"])

    return run


def _sets(shingle: int):
    """Of texts whose node is wanted: signature and shingles (32 bits of each hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sig, shingles = [], [], []
            for want, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingle_hashes(x.as_py(), shingle)
                if _node(h) == want:
                    node.append(want)
                    sig.append(signature(h).tobytes())
                    shingles.append(np.unique(h.astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(shingles, pa.binary())], names=["node", "sig", "shingles"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and band: the band's value, the first 64 bits, the node."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
            key = sig.view("<u2").reshape(-1, BANDS).astype(np.int64) | (np.arange(BANDS, dtype=np.int64) << 16)
            fp, node = np.repeat(sig[:, 0].view(np.int64), BANDS), np.repeat(part.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(fp), pa.array(node)], names=["key", "fp", "node"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, fp, node), those that have another within NEAR bits in their cell."""
    for table in whole_groups(batches, 1 << 16):
        cell, fp, node = (table.column(i).to_numpy() for i in range(3))
        hit = np.zeros(len(cell), bool)
        for i, j in GrayIndex(cell, fp.view(np.uint64)).pairs(NEAR):
            hit[i] = hit[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(cell[hit]), pa.array(fp[hit]), pa.array(node[hit])], names=["cell", "fp", "node"])


def _close(cell, fp, sig, near: int = NEAR, far: int = FAR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a cell that are within `near` in their first bits and `far` in all, and how many bits differ, in portions."""
    for i, j in GrayIndex(cell, fp.view(np.uint64)).pairs(near):
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            d = np.bitwise_count(sig[a] ^ sig[b]).sum(axis=1, dtype=np.int32)
            yield a[d <= far], b[d <= far], d[d <= far]


def _signatures_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(3).to_pylist()), "<u8").reshape(-1, WORDS)


def _closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, fp, node, sig), those that have another within FAR bits in their cell."""
    for table in whole_groups(batches, 1 << 14):
        cell, fp, node = (table.column(i).to_numpy() for i in range(3))
        hit = np.zeros(len(cell), bool)
        for i, j, _ in _close(cell, fp, _signatures_of(table)):
            hit[i] = hit[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(cell[hit]), pa.array(fp[hit]), pa.array(node[hit])], names=["cell", "fp", "node"])


def _verified(alike: float, near: int = NEAR, far: int = FAR):
    """Of each cell, a spanning forest of the links: candidates come nearest first, what is connected already is left out, and
    each one left is held against the shingles."""
    part = round(alike * 1000)

    def forest_of(cell, fp, node, sig, sets) -> pa.RecordBatch:
        size = np.array([len(s) for s in sets], dtype=np.int64)
        found = [np.zeros((3, 0), np.int32)]
        for i, j, d in _close(cell, fp, sig, near, far):
            ok = np.minimum(size[i], size[j]) * 1000 >= np.maximum(size[i], size[j]) * part
            found.append(np.stack([i[ok], j[ok], d[ok]]).astype(np.int32))
        i, j, d = np.concatenate(found, axis=1)
        order = np.argsort(d, kind="stable")
        i, j = i[order], j[order]
        forest, label, links = Forest(len(node)), np.arange(len(node)), []
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            differ = label[a] != label[b]
            for p, q in zip(a[differ].tolist(), b[differ].tolist(), strict=True):
                if forest.root(p) == forest.root(q):
                    continue
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if both * 1000 >= part * (size[p] + size[q] - both):
                    forest.join(p, q)
                    links.append((p, q))
            if differ.any():
                label = np.array([forest.root(k) for k in range(len(node))])
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, CELL):
            cell, fp, node = (table.column(k).to_numpy() for k in range(3))
            sets = [np.frombuffer(x, np.uint32) for x in table.column(4).to_pylist()]
            yield forest_of(cell, fp, node, _signatures_of(table), sets)

    return run


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, alike: float = ALIKE, cell: int = CELL) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links reach. Two texts link if, of all different word shingles of the
    two, they share a part of `alike` or more.

    Texts of equal shingle sets are one node. A node's signature is a SimHash of 16 bits for each band; nodes that agree
    in a band form a bucket, the Gray-order index finds those that are near within it, first by 64 bits, then by the
    whole signature, and only these have their shingles looked up for the exact similarity. A bucket of more than `cell` nodes is dealt into portions, and a task has two of
    them at a time: no pair is lost by that. What the bands (see BANDS) and the bounds NEAR and FAR miss, the latter about once in a thousand
    times at most, is the only loss; every link is exact but for equal 32-bit (nodes: 64-bit) hashes. Short texts, whose signatures say less, lose nothing: sets of
    up to SHORT shingles also meet by shingle, under as many of their least hashes as two sets alike enough can't avoid to share, and are compared whole.

    Letters A-Z count as a-z. Null texts count as empty; texts without words are one node, those of fewer words than a shingle
    one shingle. Null doc_ids have no row here. Repeated rows give repeated rows; of rows that share a doc_id but not the text
    each belongs to its own text. Empty table: no rows. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("t")).filter("doc_id is not null")
    signed = written(d.mapInArrow(_signed(shingle), "doc_id long, node long, sig binary, few binary"), "sim-docs")
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("sig").alias("sig"), F.any_value("few").alias("few"), F.count(F.lit(1)).alias("n")), "sim-nodes")
    rows = _in_cells(nodes.select("node", "sig").mapInArrow(_bands, "key long, fp long, node long"), cell)
    rows = _by_cell(rows, n).select("cell", "fp", "node")
    near = written(rows.mapInArrow(_paired, "cell long, fp long, node long"), "sim-near")
    near = _by_cell(near.join(nodes.select("node", "sig"), "node"), n).select("cell", "fp", "node", "sig")
    cand = written(near.mapInArrow(_closer, "cell long, fp long, node long"), "sim-cand")
    want = cand.select("node").distinct().join(nodes.select("node", "first"), "node")
    texts = want.join(d, F.col("first") == F.col("doc_id")).select("node", "t")
    sets = written(texts.mapInArrow(_sets(shingle), "node long, sig binary, shingles binary").dropDuplicates(["node"]), "sim-sets")
    cells = _by_cell(cand.join(sets, "node"), n).select("cell", "fp", "node", "sig", "shingles")
    edges = cells.mapInArrow(_verified(alike), "a long, b long")
    short = nodes.filter("few is not null").select("node", "sig", "few").mapInArrow(_prefixes(alike), "key long, fp long, node long, sig binary, shingles binary")
    short = _by_cell(_in_cells(short, cell), n).select("cell", "fp", "node", "sig", "shingles")
    edges = written(edges.union(short.mapInArrow(_verified(alike, 64, 64 * WORDS), "a long, b long")), "sim-edges")
    comp = components(edges, "sim-cc").select(F.col("node"), "root")
    firsts = nodes.select("node", "first")
    least = firsts.join(comp, "node").groupBy("root").agg(F.min("first").alias("component"))
    linked = written(comp.join(least, "root").select("node", "component"), "sim-comp")
    ids = firsts.join(linked, "node", "left").select("node", F.coalesce("component", "first").alias("component_id"))
    return joined(signed.select("doc_id", "node"), ids, "node", nodes, "n").select("doc_id", "component_id")


def _in_cells(rows: DataFrame, most: int) -> DataFrame:
    """rows with cell in the place of key. A key of more than `most` rows is dealt into portions, and each two of them, and each alone, are a cell."""
    heavy = written(rows.groupBy("key").count().filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts")), "sim-large")
    if not heavy.take(1):
        return rows.withColumnRenamed("key", "cell")
    rest = [c for c in rows.columns if c != "key"]
    rows = rows.join(heavy, "key", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return rows.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"), *rest)


def _by_cell(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("g", gray_rank(F.col("fp"))).repartition(n, "cell").sortWithinPartitions("cell", "g")


def one_of_each(docs: DataFrame, null_ids: bool = False, **how) -> DataFrame:
    """The rows of docs without those that have a near-duplicate of smaller doc_id (see similar_documents): one document
    of each component stays, the one of smallest doc_id, in all columns of docs. Rows that repeat each other in all
    columns keep one; rows that share a kept doc_id only stay. Null doc_ids stay all (they can't be told apart), unless
    null_ids is set: then each such row is a document of its own after all others, and goes if it has a near-duplicate before it. Null texts
    count as empty: of texts without words one stays. Inner columns take names that docs doesn't have. An empty table gives no rows."""
    id_, keep, rows = own_names(docs, "sim_id", "sim_keep", "sim_rows")
    if null_ids and docs.filter(F.col("doc_id").isNull()).take(1):
        top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
        own = F.monotonically_increasing_id() + F.lit(max(0 if top is None else top + 1, 0)).cast("long")
        numbered = written(docs.withColumn(id_, F.col("doc_id")).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), own)), "sim-rows")
        return one_of_each(numbered, **how).withColumn("doc_id", F.col(id_)).select(*[F.col(f"`{c}`") for c in docs.columns])
    heads = lambda: similar_documents(docs, **how).filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(keep)).agg(F.count(F.lit(1)).alias(rows))
    keys = alone(docs.sparkSession, "sim-keep", heads)
    once, repeated = keys.filter(F.col(rows) == 1).hint("merge"), keys.filter(F.col(rows) > 1)  # ids to keep grow with the documents, so they are sent nowhere whole
    kept = docs.join(once, docs["doc_id"].cast("long") == once[keep], "left_semi").union(docs.filter(F.col("doc_id").isNull()))
    return kept.union(docs.join(repeated, docs["doc_id"].cast("long") == repeated[keep], "left_semi").distinct()) if repeated.take(1) else kept
