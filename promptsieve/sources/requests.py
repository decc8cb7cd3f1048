"""Request log source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve.functions.variant import parse_body
from promptsieve.operators.identity import normalize_headers

REQUEST = (
    "request_id string, ts timestamp, method string, path string, "
    "headers map<string,string>, remote_addr string, body string"
)


def with_body(df: DataFrame, body: str = "body") -> DataFrame:
    """Append ``body_json`` (VARIANT); NULL where the body is no JSON object. The text stays
    and is still scanned."""
    return df.withColumn("body_json", parse_body(F.col(body)))


def read_requests(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Request log with lower-case header keys and the parsed body."""
    reader = spark.read.format(format)
    df = (reader.schema(REQUEST) if format == "json" else reader).load(path)
    return with_body(df.withColumn("headers", normalize_headers(F.col("headers"))))
