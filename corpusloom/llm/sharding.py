"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASH_SPACE, bucket_count, read, seeded, text_of, written
from .ranks import ranked

SEED = "shard-7"


def interleaved_shards(docs: DataFrame, n_shards: int = 8, seed: str = SEED) -> DataFrame:
    """Puts every row into one of n_shards shards so that each shard has the mixture of sources of the whole.

    Rows of a source are shuffled by a seeded hash of doc_id and ranked; the rank over the source's row count,
    (rank + 1/2) / rows, is the row's place in [0, 1). All rows sorted by place (ties: source by code point, null
    last, then hash, doc_id, size, CRC) are cut into runs whose lengths differ by one at most (law `rows`). Both
    sorts run in small cells (ranks.ranked), so no source and no shard meets in one task, and no text is shuffled.

    Returns doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32 (null text: 0), law, shard, slot,
    grown_shard (null: the law isn't `key`), source. Null doc_ids are hashed by the text's CRC instead; a null
    source is a source of its own; repeated rows each take a slot; an empty table gives no rows. Columns besides
    doc_id, source and text are not read, and texts are read once.
    """
    text = text_of().cast("binary")
    crc = F.crc32(text).cast("long")
    base = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        seeded(seed, F.col("doc_id"), crc).alias("h"),
    ), "shard")
    n = base.count()
    cells = bucket_count(n)
    order = [F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")]
    cell = F.floor(F.col("h") / F.lit(HASH_SPACE // cells)).cast("long")
    placed = ranked(base, ["source"], cell, order, "r", "n_source")
    placed = placed.withColumn("place", (F.col("r") + F.lit(0.5)) / F.col("n_source"))
    final = [F.col("place"), F.col("source").asc_nulls_last(), *order]
    placed = ranked(placed, [], F.floor(F.col("place") * cells).cast("long"), final, "at")
    out = placed.withColumn("shard", F.expr(f"at * {n_shards} div {max(1, n)}").cast("int"))
    start = F.expr(f"(shard * cast({n} as bigint) + {n_shards - 1}) div {n_shards}")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("at") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(read(spark, sf_dir, "documents"))


#: CRC-32 (polynomial 0xEDB88320) byte by byte, with its table made in the query.
OP3_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS tab FROM steps WHERE k = 8
), d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size FROM documents
), c AS (
  SELECT d.*, CASE WHEN size = 1 THEN 0 ELSE xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(t)), '(..)', '\\1 ', 'g'), ' ')[:size - 1], lambda x: ('0x' || x)::BIGINT)),
    lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8))) END AS text_crc32
  FROM d, crc
), k AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || text_crc32)), 1, 15))::BIGINT AS h FROM c
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n_source FROM k
), p AS (
  SELECT *, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n_source, source NULLS LAST, h, doc_id NULLS LAST, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM r
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, ((pos * 8) // n)::INT AS shard,
  (pos - ((((pos * 8) // n) * n + 7) // 8))::BIGINT AS slot, NULL::INT AS grown_shard, source
FROM p
"""

QUERIES = {"op3_interleave": op3_interleave}
ORACLES = {"op3_interleave": OP3_SQL}
