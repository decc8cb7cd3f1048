"""Session settings this package is written for."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the session up: settings, and the package on the Python workers of all executors."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    _ship_package(spark)
    return spark


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package's modules and the files that they read to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="promptsieve-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for kind in ("*.py", "*.yaml"):
            for file in sorted(package.rglob(kind)):
                out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def local_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Small driver-side rows as a local relation.

    Built from Arrow, so Spark knows its size and broadcasts it by that; a frame built from
    Python objects counts as unknown and large, and would shuffle the big side of a join.
    """
    struct = StructType.fromDDL(schema)
    names = struct.fieldNames()
    table = pa.Table.from_pylist(
        [dict(zip(names, row)) for row in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, struct)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors see, below the cluster's ``spark.checkpoint.dir``.

    Only on one machine (a ``local`` master) it may be unset, and is then a temporary folder.
    """
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {key} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="promptsieve-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table into a new shared folder and read it back: it cuts lineage and gives later
    steps a fixed input, whatever executor is lost."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
