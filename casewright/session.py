"""Session construction and table access shared by every query."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[4]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the session that is given."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", shuffle_partitions)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where the setting is absent and Spark runs on one machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if found is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = found or tempfile.mkdtemp(prefix="casewright-checkpoint-")
        context.setCheckpointDir(found)
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def bounded_batches(spark: SparkSession, size: str = "4m", rows: int = 2000) -> None:
    """Arrow batches of a few megabytes, so that what Python workers and their JVM side hold doesn't depend on text lengths.

    These are settings of the session, and plans are lazy, so they stay set after the call.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over as many tasks as shuffles have, whatever their bytes.

    A table in one small file is read by one task, and costly work on its rows would stay in it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors don't force a replay."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a compressed columnar table in the shared checkpoint folder and read it back.

    Later readers prune columns, which a checkpoint of whole rows doesn't allow.
    """
    import uuid

    path = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
