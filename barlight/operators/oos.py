"""Frozen out-of-sample evaluation with a warm-up from stored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlight.config import Config
from barlight.functions.stats import KEY, month
from barlight.operators.backtest import compounded, positions, sharpe, with_equity, with_thresholds
from barlight.operators.features import LABEL
from barlight.operators.metrics import rank_ic
from barlight.session import written


def with_history(history: DataFrame, test: DataFrame, config: Config) -> DataFrame:
    """history and test predictions as one series with thresholds; a test row wins over an older one."""
    both = history.select(KEY, "ts", "prediction", F.lit(False).alias("is_test")).unionByName(
        test.select(KEY, "ts", "prediction", F.lit(True).alias("is_test"))
    )
    n = F.row_number().over(Window.partitionBy(KEY, "ts").orderBy(F.desc("is_test"), "prediction"))
    return with_thresholds(both.withColumn("__n", n).filter("__n = 1").drop("__n"), config)


def reattached(rows: DataFrame, lookup: DataFrame, columns: list[str]) -> DataFrame:
    """rows with these columns taken anew from lookup, one row a series and time."""
    one = lookup.groupBy(KEY, "ts").agg(F.min(F.struct(*columns)).alias("r")).select(KEY, "ts", "r.*")
    return rows.drop(*columns).join(one, [KEY, "ts"], "left")


def evaluated(history: DataFrame, test: DataFrame, features: DataFrame, config: Config) -> DataFrame:
    """Positions over the whole series, so that they go on over the boundary; then test rows only.

    Written once, with what the reports need: each of them reads it several times.
    """
    rows = reattached(with_history(history, test, config), features, [LABEL])
    return written(positions(rows, config, F.col("is_test")).filter("is_test").drop("rn"), "evaluated")


def summary(rows: DataFrame, config: Config) -> DataFrame:
    """One row per series: activity, edge, costs, risk and rank correlations of the test."""
    on = F.col("position") == 1
    gross = F.when(on, F.col("gross_return"))
    cost = F.sum("transaction_cost") * 10_000
    active = F.count_if(on)
    table = with_equity(rows, [KEY]).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("test_rows"),
        active.alias("active_periods"),
        F.count_if(F.col("position_change") == 1).alias("entries"),
        F.count_if(F.col("position_change") == -1).alias("exits"),
        F.avg(on.cast("double")).alias("signal_frequency"),
        (F.avg(gross) * 10_000).alias("gross_bps"),
        (F.avg(gross) * 10_000 - F.try_divide(cost, active)).alias("net_edge_bps"),
        F.avg((gross > 0).cast("double")).alias("gross_hit_rate"),
        cost.alias("cost_bps"),
        sharpe(F.col("net_return"), config.periods_per_year).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        compounded(F.col("net_return")).alias("total_return"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    return table.join(rank_ic(rows, [KEY]).drop("n_rows"), KEY, "left")


def monthly(rows: DataFrame) -> DataFrame:
    """The months of the test; partial: the last row is before the end of its month."""
    rows = rows.withColumn("month", month(F.col("ts")))
    on = F.col("position") == 1
    gross = F.when(on, F.col("gross_return"))
    table = rows.groupBy(KEY, "month").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(on).alias("active_periods"),
        F.avg(on.cast("double")).alias("signal_frequency"),
        (F.avg(gross) * 10_000).alias("gross_bps"),
        F.avg((gross > 0).cast("double")).alias("gross_hit_rate"),
        (F.sum("transaction_cost") * 10_000).alias("cost_bps"),
        compounded(F.col("net_return")).alias("monthly_return"),
        (F.max("ts") < F.add_months(F.trunc(F.max("ts"), "MM"), 1).cast("timestamp")).alias("is_partial"),
    )
    return table.join(rank_ic(rows, [KEY, "month"], small=True).drop("n_rows"), [KEY, "month"], "left")
