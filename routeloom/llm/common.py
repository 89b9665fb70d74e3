"""Shared pieces: the word rule, digests and the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of what separates words: space and \x09-\x0D.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> None:
    """Let checkpoint() work: the folder named in spark.checkpoint.dir, or a local one where none is named (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/routeloom-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, kept in the shared folder so that they outlive any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def collect_garbage(spark: SparkSession) -> None:
    """Give back the shuffle files and checkpoints that nothing refers to any more; Spark learns of them from its driver's garbage collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def stage(make: Callable[[], DataFrame]) -> DataFrame:
    """cut() of what ``make`` returns. Nothing else holds that frame, so the shuffle files that led to it are given back at once."""
    out = cut(make())
    collect_garbage(out.sparkSession)
    return out


def give_back() -> None:
    """Return to the system what this Python worker has freed; it is used again for later tasks, and would hold that memory beside its executor meanwhile."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run`` of a table, after which the worker gives back what it has freed."""

    def both(rows):
        try:
            return run(rows)
        finally:
            give_back()

    return both


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """While it lasts, generated methods too long for Java's compiler are not used: Spark then evaluates their expressions in parts, which is several times faster."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Order of a null id: after every other.
LAST = 9223372036854775807


def ordered_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST))
