"""Files of molecules, templates, results and routes: readers and writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udf import mol_key


def read_column(spark: SparkSession, path: str, column: int = 0, delimiter: str | None = None, skip_header: bool = False) -> DataFrame:
    """(value): one column of a text file, plain or gzipped; blank and # lines and short rows are dropped."""
    d = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"), F.input_file_name().alias("_f"))
    if skip_header:  # the first line of each file
        first = d.where("_at = 0").groupBy("_f").agg(F.min("_n").alias("_n"))
        d = d.join(F.broadcast(first), ["_f", "_n"], "left_anti")
    parts = F.split("line", r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E")
    return d.where((F.col("line") != "") & ~F.col("line").startswith("#")).select(F.trim(F.get(parts, column)).alias("value")).where("value IS NOT NULL AND value <> ''")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return read_column(spark, path).withColumnRenamed("value", "target")


def stock_from_smiles(smiles: DataFrame, column: str = "value", on_error: str = "skip") -> DataFrame:
    """(k): distinct keys. Unreadable rows are skipped, or raise an error once they are met."""
    if on_error not in ("skip", "raise"):
        raise ValueError("on_error must be skip or raise")
    d = smiles.select(F.col(column).alias("s")).distinct().withColumn("k", mol_key("s"))
    if on_error == "raise":
        d = d.withColumn("k", F.when(F.col("k").isNull(), F.raise_error(F.concat(F.lit("unreadable molecule: "), F.coalesce("s", F.lit("null"))))).otherwise(F.col("k")))
    return d.where("k IS NOT NULL").select("k").distinct()


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("k")).where("k <> ''").distinct()


def save_keys(stock: DataFrame, path: str, gzip: bool = False) -> None:
    """Sorted keys, one per line; part files are in order."""
    stock.select("k").orderBy("k").write.mode("overwrite").text(path, **({"compression": "gzip"} if gzip else {}))


def save_stock_table(stock: DataFrame, name: str, buckets: int = 64) -> None:
    """A table bucketed by key, so that membership joins need no shuffle of it, with statistics."""
    stock.write.mode("overwrite").bucketBy(buckets, "k").sortBy("k").saveAsTable(name)
    stock.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")


def read_templates_json(spark: SparkSession, path: str) -> DataFrame:
    """(label, smarts) from an object {label: smarts}."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "smarts"))
    return d.select(F.col("label").cast("int").alias("label"), "smarts")


def read_templates_tsv(spark: SparkSession, path: str, label: str = "label", smarts: str = "smarts") -> DataFrame:
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    return d.select(F.col(label).cast("int").alias("label"), F.col(smarts).alias("smarts"))


def find(candidates: list[str]) -> str:
    """The first path that exists; the error lists all that were tried. Paths with a scheme are left to Spark."""
    for c in candidates:
        if "://" in c or os.path.exists(c):
            return c
    raise FileNotFoundError("none of these exists: " + ", ".join(candidates))


def asset(name: str, folder: str | None = None) -> str:
    """Path of a local asset: an environment variable ROUTELOOM_<NAME>, a given folder, or the cache folder."""
    own = os.environ.get(f"ROUTELOOM_{name.upper()}")
    cache = os.environ.get("ROUTELOOM_CACHE", os.path.expanduser("~/.cache/routeloom"))
    return find([p for p in (own, folder and os.path.join(folder, name), os.path.join(cache, name)) if p])


def read_results(spark: SparkSession, path: str, schema: str, key: str = "smiles") -> DataFrame:
    """CSV results; of equal keys the last row counts."""
    d = spark.read.csv(path, schema=schema, header=True).withColumn("_n", F.monotonically_increasing_id())
    columns = [c for c in d.columns if c not in (key, "_n")]
    return d.groupBy(key).agg(F.max_by(F.struct(*columns), "_n").alias("x")).select(key, "x.*")


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records under ``data`` of a JSON document, plain or gzipped."""
    return spark.read.schema(f"data array<struct<{schema}>>").json(path, multiLine=True).select(F.inline("data"))


def read_routes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def structures_with_names(structures: DataFrame, dictionary: DataFrame, kind: str = "Small molecule") -> DataFrame:
    """Structures of one kind with text, by id."""
    return structures.join(dictionary.where(F.col("molecule_type") == kind).select("molregno"), "molregno").where("canonical_smiles IS NOT NULL").orderBy("molregno")


def save_reports(reports: DataFrame, path: str) -> None:
    """One JSON row per target."""
    reports.write.mode("overwrite").json(path)


def reaction_seeds(text: DataFrame, column: str = "value") -> DataFrame:
    """(m): single molecules between dots."""
    return text.select(F.explode(F.split(column, r"\.")).alias("m")).where("m <> ''")
