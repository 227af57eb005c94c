"""Continuous vocabularies and audits over a folder that documents arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclens.functions import text as T


def arriving(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of parquet documents with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def spacing_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, stop): missing spaces after full stops, record by record, without state."""
    return docs.select("doc_id", F.explode(T.stops_without_space(F.col("text"))).alias("stop"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): running counts; state grows with the vocabulary and is kept by the state store."""
    return docs.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def run_once(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, written once and only once; the next call takes what is new."""
    return findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
