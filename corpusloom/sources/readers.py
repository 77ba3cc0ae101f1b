"""Sources and sinks: corpora as files, metrics logs, run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "event string, step double, loss double, learning_rate double, step_performed double, val_loss double, val_ppl double"
MIN_BYTES = 10


def text_files(spark: SparkSession, path: str, lossy: bool = False) -> DataFrame:
    """path, text of whole files in UTF-8; wrong bytes are replaced if lossy, else an error."""
    files = spark.read.format("binaryFile").load(path)
    content = F.col("content").cast("string")
    text = F.make_valid_utf8(content) if lossy else F.validate_utf8(content)
    return files.select("path", text.alias("text"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def long_enough(text: Column, least: int = MIN_BYTES) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)) >= least


def append_metrics(rows: DataFrame, path: str) -> None:
    """JSON lines, every number as a double, step too."""
    numbers = [F.col(c).cast("double").alias(c) if t in ("int", "bigint", "float", "double", "boolean") else F.col(c) for c, t in rows.dtypes]
    rows.select(*numbers).write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Step rows of a metrics log; its header row has other fields."""
    return spark.read.schema(METRICS).json(path).filter(F.col("event") == "step")


def ingestible(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with a key and a text that aren't empty."""
    return docs.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & F.col(text).isNotNull() & (F.col(text) != ""))


def missing_fields(present: list[str], required: list[str]) -> list[str]:
    return sorted(set(required) - set(present))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a store holds a file or folder, by whatever scheme Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
