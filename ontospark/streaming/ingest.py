"""Streams of N-Triples files: the same parser, duplicates dropped within a watermark, running counts by predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ntriples


def triples(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """New files of a folder as triples with their time of arrival; repeated triples within ``late`` come once."""
    rows = ntriples.parse(spark.readStream.text(folder)).where("error IS NULL").drop("error").withColumn("seen", F.current_timestamp())
    return rows.withWatermark("seen", late).dropDuplicatesWithinWatermark(["s", "p", "o", "o_kind", "o_dt", "o_lang"])


def counts(stream: DataFrame) -> DataFrame:
    """Triples by predicate so far."""
    return stream.groupBy("p").agg(F.count("*").alias("n"))
