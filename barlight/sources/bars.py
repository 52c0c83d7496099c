"""Bar tables: readers and writers, cleaning, and adapters that derive bars from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.functions.stats import KEY, month

BARS = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
PRICES = ("open", "high", "low", "close")


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored bar table with the declared schema; no global order is imposed."""
    reader = spark.read.schema(BARS)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def typed_bars(rows: DataFrame, epoch_ms: str = "ts_ms") -> DataFrame:
    """Raw rows with epoch milliseconds to typed bars."""
    values = [F.col(c).cast("double").alias(c) for c in (*PRICES, "volume")]
    return rows.select(KEY, F.timestamp_millis(F.col(epoch_ms)).alias("ts"), *values)


def clean_bars(bars: DataFrame, tie: Column | None = None) -> DataFrame:
    """One row per series and time: the first by `tie`, else by the values themselves."""
    order = [tie] if tie is not None else []
    window = Window.partitionBy(KEY, "ts").orderBy(*order, *PRICES, "volume")
    return bars.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def write_stage(df: DataFrame, path: str, by: list[str] | None = None, fmt: str = "parquet", replace: str = "all") -> None:
    """Write a stage's table, partitioned for pruning; CSV for small metric tables.

    replace="parts" replaces only the partitions that df has rows of: a run writes its months and
    leaves the others as they are.
    """
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if replace == "parts":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_monthly(df: DataFrame, path: str) -> None:
    """Write a stage's rows by month (a text like 2001-01, the column `month`) in place of those of the same months."""
    rows = df.withColumn("month", month(F.col("ts")))
    write_stage(rows.repartition("month"), path, ["month"], replace="parts")


def read_monthly(spark: SparkSession, path: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """A stage's rows from the time `begin` to before `end`; only the months between are listed and read."""
    rows = spark.read.option("recursiveFileLookup", False).parquet(path).withColumn("month", F.col("month").cast("string"))
    if begin:
        rows = rows.filter((F.col("month") >= begin[:7]) & (F.col("ts") >= F.lit(begin).cast("timestamp")))
    if end:
        rows = rows.filter((F.col("month") <= end[:7]) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return rows.drop("month")


def prediction_history(predictions: DataFrame, cutoff: str) -> DataFrame:
    """Predictions before the cutoff, one a series and time; the filter reaches the scan."""
    rows = predictions.filter(F.col("ts") < F.lit(cutoff).cast("timestamp")).select(KEY, "ts", "prediction")
    window = Window.partitionBy(KEY, "ts").orderBy("prediction")
    return rows.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def daily_bars(spark: SparkSession, sf_dir: str, series: str = "l_returnflag") -> DataFrame:
    """Daily bars of order lines: price a unit, by ship date; a series per value of `series`.

    Times are read in the session's zone; the queries set it to UTC.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.expr(series).cast("string").alias(KEY),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.try_divide("l_extendedprice", "l_quantity").alias("p"),
        "l_quantity",
        "l_orderkey",
        "l_linenumber",
    )
    order = F.struct("l_orderkey", "l_linenumber", "p")
    return lines.groupBy(KEY, "ts").agg(
        F.min_by("p", order).alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", order).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def event_bars(spark: SparkSession, sf_dir: str, width: str = "30 minutes", series: str = "event_type") -> DataFrame:
    """Intraday bars of event values, a series per value of `series`; volume counts the events.

    Of events at one time the one with the least id is first. Times are read in the session's zone.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.expr(series).cast("string").alias(KEY), F.col("ts").cast("timestamp").alias("at"), "value", "event_id"
    )
    order = F.struct("at", "event_id", "value")
    return (
        events.groupBy(KEY, F.window("at", width).alias("w"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select(KEY, F.col("w.start").alias("ts"), *PRICES, "volume")
    )
