"""Column functions shared by the operators: NULL-safe statistics, full windows, ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY = "series_id"


def by_time(*extra: str) -> WindowSpec:
    """Rows of a series (and of the further keys) in time order."""
    return Window.partitionBy(KEY, *extra).orderBy("ts")


def last_rows(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-(n - 1), 0)


def full(agg: Callable[[Column], Column], value: Column, window: WindowSpec, n: int) -> Column:
    """An aggregate over the last n rows, NULL unless all n values are there."""
    frame = last_rows(window, n)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows that have both; NULL when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 with ties at their mean, within `by`."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (
        F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1
    ) / F.lit(2.0)


def with_ranks(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """df with `<column>_rank` for each column; for groups that fit a task, as a month's rows do."""
    for c in columns:
        df = df.withColumn(f"{c}_rank", average_rank(c, by))
    return df


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
