"""Session settings, table access and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "routeloom", **conf: str) -> SparkSession:
    """A session with the engine's settings: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the shared checkpoint folder, so that lost executors cost no more than a reread."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/routeloom-checkpoints")
    return df.checkpoint(eager=True)
