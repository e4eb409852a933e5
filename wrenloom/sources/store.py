"""Where tables and states are kept: Parquet by default, JDBC and JSON on request."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark", "labels", "embeddings")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder. Its schema is in the files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, where: str, schema: str, *, driver: str = "parquet", **options: str) -> DataFrame:
    """A table by its driver: parquet, json (where is a path) or jdbc (where is a URL; dbtable, user .. are options)."""
    if driver == "jdbc":
        return spark.read.format("jdbc").options(url=where, **options).load()
    if driver not in ("parquet", "json"):
        raise ValueError(f"unsupported driver: {driver}")
    return spark.read.schema(schema).options(**options).format(driver).load(where)


def write(df: DataFrame, where: str, *, driver: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None, **options: str) -> None:
    """A snapshot, committed as a whole. by: columns to partition the files by."""
    if driver == "jdbc":
        df.write.format("jdbc").mode("append" if mode == "append" else "overwrite").options(url=where, **options).save()
        return
    if driver not in ("parquet", "json"):
        raise ValueError(f"unsupported driver: {driver}")
    w = df.write.mode(mode).options(**options).format(driver)
    (w.partitionBy(*by) if by else w).save(where)


def create(spark: SparkSession, name: str, schema: str) -> None:
    """The table in the catalogue, empty, unless it is there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved transfer states as JSON; none if nothing was saved."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def save_state(states: DataFrame, path: str) -> None:
    """States as JSON with their lists sorted, so that equal states are equal text."""
    lists = {c: F.sort_array(c) for c, kind in states.dtypes if kind.startswith("array")}
    states.withColumns(lists).write.mode("overwrite").json(path)


def drop_state(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, modified) of the files of a folder; their contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def expired(listing: DataFrame, as_of, log_days: int = 7, state_days: int = 1) -> DataFrame:
    """Files that may go: logs after some days, states (.json) after others."""
    age = lambda days: F.col("modified") < as_of - F.expr(f"interval {days} days")
    return listing.where((F.col("name").endswith(".log") & age(log_days)) | (F.col("name").endswith(".json") & age(state_days)))


def write_parts(parts: DataFrame, folder: str) -> None:
    """The bytes of parts (asset_id, start, data), each asset's into files in order, as <folder>/<asset_id>. For assets too large for a row.

    An asset goes to one task, which appends its sorted parts to a file of its own and renames it when complete; a task that is run again starts afresh.
    """

    def save(rows) -> None:
        import os
        import uuid

        current, out, temporary = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(temporary, Path(folder, str(current)))

        for r in rows:
            if out is None or r["asset_id"] != current:
                close()
                current, temporary = r["asset_id"], str(Path(folder, f".{r['asset_id']}.{uuid.uuid4().hex}"))
                out = open(temporary, "wb")
            if r["data"] is not None:
                out.write(r["data"])
        close()

    Path(folder).mkdir(parents=True, exist_ok=True)
    parts.select("asset_id", "start", "data").repartition("asset_id").sortWithinPartitions("asset_id", "start").foreachPartition(save)
