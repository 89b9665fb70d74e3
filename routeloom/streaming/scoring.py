"""Scoring targets as they arrive, resumable; and rates over event time (beyond what batches need)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(targets: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "target") -> StreamingQuery:
    """Append a report per new target to a Parquet table. Targets already there are not scored again, so a restart goes on where it stopped."""

    def each(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        new = rows.select(key).distinct()
        done = _existing(spark, out)
        if done is not None:
            new = new.join(done.select(key).distinct(), key, "left_anti")
        # one folder per epoch: a repeated epoch replaces its own rows only
        score(new).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return targets.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _existing(spark, out: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.listStatus(path):
        return None
    return spark.read.parquet(out)


def windowed_rate(events: DataFrame, ts: str, solved: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Solve rate per window of event time; rows later than ``late`` are left out."""
    d = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    g = d.withWatermark("_ts", late).groupBy(F.window("_ts", window)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(solved).cast("double")).alias("rate"))
    return g.select(F.col("window.start").alias("start"), "n", "rate")
