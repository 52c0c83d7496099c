"""Time splits, normalised and clipped targets, walk-forward folds, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions.stats import KEY, month
from barlight.operators.features import LABEL
from barlight.operators.ordered import Expanding, quantiles


def split_of(ts: Column, validation: str, test: str) -> Column:
    day = [F.lit(d).cast("timestamp") for d in (validation, test)]
    return F.when(ts < day[0], "train").when(ts < day[1], "validation").otherwise("test")


def split_summary(rows: DataFrame, validation: str, test: str) -> DataFrame:
    """Rows and period of each part of a fixed time split."""
    return rows.groupBy(KEY, split_of(F.col("ts"), validation, test).alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def normalized(rows: DataFrame, volatility: str | None, floor: float = 1e-6) -> DataFrame:
    """rows with `target`: the label, divided by a volatility column that is kept above a floor."""
    y = F.col(LABEL)
    return rows.withColumn("target", F.try_divide(y, F.greatest(volatility, F.lit(floor))) if volatility else y)


def within(value: Column, lower: Column, upper: Column) -> Column:
    """A value kept between two bounds, where they are known; null stays null."""
    return F.when(value.isNotNull(), F.least(upper, F.greatest(lower, value)))


def clipped(rows: DataFrame, train: Column, bounds: tuple[float, float], by: list[str]) -> DataFrame:
    """rows with `target` clipped to quantiles of the training rows only, and these quantiles; null targets stay null.

    A row of bounds per group is joined: as many as there are series or folds.
    """
    found = quantiles(rows.filter(train), F.col("target"), by, {"lower": bounds[0], "upper": bounds[1]})
    return rows.join(found, by).withColumn("target", within(F.col("target"), F.col("lower"), F.col("upper")))


def fold_months(rows: DataFrame, start: str) -> DataFrame:
    """A row per series and month from `start` to the month of its last row at or after it."""
    begin = F.lit(start).cast("date")
    last = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp")).groupBy(KEY).agg(F.max("ts").alias("last"))
    months = F.sequence(begin, F.trunc("last", "MM"), F.expr("interval 1 month"))
    return last.select(KEY, F.explode(months).alias("begin"))


def months_from(rows: DataFrame, start: str) -> list[str]:
    """The months of all series' folds in order: a list bounded by the calendar."""
    return [r.month for r in fold_months(rows, start).select(month(F.col("begin")).alias("month")).distinct().orderBy("month").collect()]


def month_after(seconds: int) -> Column:
    """The month whose next ones all begin more than so many seconds after a row."""
    return F.trunc(F.timestamp_seconds(F.unix_seconds("ts") + seconds), "MM")


def past_bounds(rows: DataFrame, months: list[str], purge_seconds: int, bounds: tuple[float, float]) -> DataFrame:
    """month, q: two quantiles of each series' targets that end more than so many seconds before each of these months.

    Months are a list that the calendar bounds; rows are not copied to later months.
    """
    ends = F.explode(F.array(*[F.lit(f"{m}-01").cast("date") for m in months])).alias("until")
    untils = rows.select(KEY).distinct().select(KEY, ends)
    found = Expanding(rows, F.col("target"), [KEY], month_after(purge_seconds), untils).quantiles(list(bounds))
    return found.select(KEY, month(F.col("until").cast("timestamp")).alias("month"), "q")


def folds(rows: DataFrame, start: str, horizon_seconds: int, inner_days: int = 30, skip_empty: bool = False) -> DataFrame:
    """Counts and training bounds of each monthly purged walk-forward fold.

    Training ends a horizon before the month; the last `inner_days` before that end validate,
    and are themselves purged from what fits. Months without rows to predict are skipped; a
    month with nothing to fit or validate on raises an error, or is left out with skip_empty. Rows
    are counted by month once, and these counts joined with later months; bounds come from blocks
    of targets in order.
    """
    inner, months = inner_days * 86_400, fold_months(rows, start)
    ends = {"fit_rows": inner + horizon_seconds, "train_rows": horizon_seconds, "older_rows": inner, "here": 0}
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), month_after(s).alias("period")) for k, s in ends.items()])).alias("t")
    counts = rows.select(KEY, told).groupBy(KEY, "t.kind", "t.period").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.col("period") < F.col("begin")
    found = counts.join(months, KEY).groupBy(KEY, "begin").agg(
        *[F.coalesce(F.sum(F.when(earlier & (F.col("kind") == k), F.col("n"))), F.lit(0)).alias(k) for k in ends if k != "here"],
        F.coalesce(F.sum(F.when((F.col("period") == F.col("begin")) & (F.col("kind") == "here"), F.col("n"))), F.lit(0)).alias("predict_rows"),
    )
    found = found.withColumn("validation_rows", F.greatest(F.col("train_rows") - F.col("older_rows"), F.lit(0)))
    untils = months.select(KEY, F.col("begin").alias("until"))
    bounds = Expanding(rows, F.col("target"), [KEY], month_after(horizon_seconds), untils).quantiles([0.005, 0.995])
    bounds = bounds.select(KEY, F.col("until").alias("begin"), "q")
    found = found.join(bounds, [KEY, "begin"], "left").withColumn("month", month(F.col("begin").cast("timestamp")))
    if skip_empty:
        found = found.filter("fit_rows > 0 and validation_rows > 0")
    checked = F.when(
        (F.col("fit_rows") == 0) | (F.col("validation_rows") == 0), F.raise_error(F.lit("empty fold"))
    ).otherwise(F.col("fit_rows"))
    return found.filter("predict_rows > 0").select(
        KEY,
        "month",
        checked.cast("long").alias("fit_rows"),
        "validation_rows",
        "train_rows",
        "predict_rows",
        F.get("q", 0).alias("lower"),
        F.get("q", 1).alias("upper"),
    )


def thinned(rows: DataFrame, horizon_seconds: int) -> DataFrame:
    """Rows whose time is a multiple of the horizon: labels that don't overlap."""
    return rows.filter(F.unix_seconds("ts") % horizon_seconds == 0)
