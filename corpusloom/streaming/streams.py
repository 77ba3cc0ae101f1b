"""Structured Streaming: metrics logs as streams, and an index that grows by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import B, K1, OVERLAP, SIZE, Index, chunks
from ..functions import text as T
from ..sources.readers import METRICS, ingestible


def metrics_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(METRICS).json(path).filter(F.col("event") == "step")


def windowed_loss(events: DataFrame, ts: str, value: str, width: str, late: str) -> DataFrame:
    """Means by event-time window with a watermark (an extension: logs of the batch engine carry no event time)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.avg(value).alias("loss"), F.count(F.lit(1)).alias("n"))


def ingest(docs: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Appends the documents of a stream to an index under root. Each batch writes its own folder, overwriting it if the batch is run again."""
    def one(batch: DataFrame, number: int) -> None:
        cut = chunks(ingestible(batch, "doc_id", "text"), SIZE, OVERLAP).select("doc_id", "chunk_no", T.tokens(F.col("text")).alias("tokens"))
        cut.write.mode("overwrite").parquet(f"{root}/chunks/batch={number}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown_index(spark: SparkSession, root: str, k1: float = K1, b: float = B) -> Index:
    """The index of all batches; of a document that came again, the chunks of its last batch count."""
    rows = spark.read.parquet(f"{root}/chunks")
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    rows = rows.join(last, ["doc_id", "batch"], "left_semi").withColumn("dl", F.size("tokens"))
    postings = rows.select("doc_id", "chunk_no", "dl", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "chunk_no", "dl").agg(F.count(F.lit(1)).alias("f"))
    return Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_dl")), k1, b)
