"""Data-quality checks of bar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.functions.stats import KEY
from barlight.operators.ordered import CHUNK, with_previous
from barlight.sources.bars import PRICES


def profile(bars: DataFrame) -> DataFrame:
    """Rows, first and last time of each series."""
    return bars.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def counts(bars: DataFrame) -> DataFrame:
    """All counting checks of a series in one pass: missing values, repeats, impossible prices."""

    def n(condition) -> object:
        return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))

    top = F.greatest("open", "close", "low")
    bottom = F.least("open", "close", "high")
    return bars.groupBy(KEY).agg(
        *[n(F.col(c).isNull()).alias(f"missing_{c}") for c in ("ts", *PRICES, "volume")],
        # a missing time that repeats is a duplicate, too
        (F.count(F.lit(1)) - F.count_distinct("ts") - F.max(F.col("ts").isNull().cast("long"))).alias("duplicate_ts"),
        *[n(F.col(c) <= 0).alias(f"nonpositive_{c}") for c in PRICES],
        n(F.col("high") < top).alias("high_too_low"),
        n(F.col("low") > bottom).alias("low_too_high"),
        n(F.col("volume") < 0).alias("negative_volume"),
    )


def gaps(bars: DataFrame, bar_seconds: int, chunk: int = CHUNK) -> DataFrame:
    """Gaps of more than one bar: the times around it, its length and the bars that are missing."""
    seconds = F.unix_seconds("ts") - F.unix_seconds("previous_ts")
    found = with_previous(bars.select(KEY, "ts"), {"previous_ts": "ts"}, chunk)
    return found.withColumn("gap_seconds", seconds).filter(F.col("gap_seconds") > bar_seconds).select(
        KEY, "previous_ts", "ts", "gap_seconds", (F.floor(F.col("gap_seconds") / bar_seconds) - 1).alias("missing_bars")
    )
