"""Sensor CSV files: reading, cleaning, writing; and the shapes of results."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; below /tmp where none is set, on one machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/tidestate-shared"
    return f"{folder.rstrip('/')}/{what}-{uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header. Types are inferred (a pass of its own) only without a schema."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def clean_sensor(raw: DataFrame, time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """The second and third columns as DateTime and Temperature; rows with a missing value go; times are parsed without a zone."""
    two = raw.select(*(F.col(f"`{c}`") for c in raw.columns[1:3])).toDF("DateTime", "Temperature").na.drop()
    parsed = F.to_timestamp_ntz(F.col("DateTime").cast("string"), F.lit(time_format)) if dict(two.dtypes)["DateTime"] == "string" else F.col("DateTime").cast("timestamp_ntz")
    return two.select(parsed.alias("DateTime"), F.col("Temperature").cast("double").alias("Temperature"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def tidy(filtered: DataFrame, state: int = 0, width: float = 1.96) -> DataFrame:
    """series_id, t, value, lo and hi of one state of (series_id, t, mean, cov): what a plot with a ribbon needs."""
    v, s = F.col("mean")[state], F.sqrt(F.col("cov")[state][state])
    return filtered.select("series_id", "t", v.alias("value"), (v - width * s).alias("lo"), (v + width * s).alias("hi"))


def metrics(**values: DataFrame) -> DataFrame:
    """One row a metric and series: metric, series_id, value, from frames (series_id, value)."""
    out = None
    for name, df in values.items():
        one = df.select(F.lit(name).alias("metric"), "series_id", F.col(df.columns[-1]).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
