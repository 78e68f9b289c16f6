"""Tokens from a stream of persons. Tokenizing is a projection, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hushjoin.operators.rules import DEFAULT, RuleSet
from hushjoin.operators.tokens import Pipeline, tokenize


def person_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(persons: DataFrame, pipeline: Pipeline, path: str, checkpoint: str, rules: RuleSet = DEFAULT, registry=None, once: bool = False) -> StreamingQuery:
    """Append tokens to Parquet files; the file sink and its checkpoint give each token once."""
    out = tokenize(persons, pipeline, rules, registry).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start() if once else out.start()
