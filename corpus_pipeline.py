"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each over whole documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import read
from corpusloom.llm.linededup import without_repeated_lines
from corpusloom.llm.mixing import mixed
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality import good_documents
from corpusloom.llm.simhash_join import one_of_each
from corpusloom.sources.scratch import delete, fresh_path, swept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines and unfinished ends of lines go, and documents that fail the base or lose too much text go whole."""
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are equal or within the edit threshold, the first stays."""
    return without_repeated_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of their five-word shingles), the document of smallest doc_id stays; rows without one come last."""
    return one_of_each(docs, null_ids=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their sources, by Pareto order sampling; a document that is taken twice is there twice."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets, batches and slots of what the mix holds."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL expresses neither the edit join nor SimHash bands; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written as Parquet to the shared folder and read again as the next one's input. A stage's own tables, and
    the result that it has read, are deleted once its result is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        with swept(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
