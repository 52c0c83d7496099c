"""Signals from past-only thresholds, signal and position backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.config import Config
from barlight.functions.stats import KEY, month
from barlight.operators.features import LABEL
from barlight.operators.ordered import CHUNK, ordered_index, quantiles, running_max, running_product, running_sum, with_previous
from barlight.operators.rolling import past_quantiles
from barlight.session import written

SIDES = ("long", "short", "long_short")


def with_thresholds(rows: DataFrame, config: Config) -> DataFrame:
    """rows with short_threshold and long_threshold, quantiles of past predictions only."""
    q = {"short_threshold": config.tail, "long_threshold": 1 - config.tail}
    found = past_quantiles(rows, "prediction", q, config.threshold_window, config.min_history)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in q})


def signals(rows: DataFrame, config: Config) -> DataFrame:
    """A row per side: signal, gross return, cost and net return. Long wins over short."""
    p, long, short = F.col("prediction"), F.col("long_threshold"), F.col("short_threshold")
    up = F.coalesce(p >= long, F.lit(False)) & short.isNotNull()
    down = F.coalesce(p <= short, F.lit(False)) & long.isNotNull()
    side = F.col("side")
    signal = F.when(up & side.isin("long", "long_short"), 1).when(down & side.isin("short", "long_short"), -1).otherwise(0)
    out = rows.withColumn("side", F.explode(F.array(*map(F.lit, SIDES)))).withColumn("signal", signal)
    cost = F.when(F.col("signal") != 0, F.lit(config.signal_cost)).otherwise(0.0)
    return out.withColumns({"gross_return": F.col("signal") * F.col(LABEL), "transaction_cost": cost}).withColumn(
        "net_return", F.col("gross_return") - F.col("transaction_cost")
    )


def with_equity(rows: DataFrame, by: list[str], value: str = "net_return") -> DataFrame:
    """rows with equity (product of 1 + value) and its drawdown below the running peak, in chunks of a group."""
    out = running_product(ordered_index(rows, ["ts"], by=by), 1 + F.col(value), "equity", by=by)
    out = running_max(out, F.col("equity"), "__peak", by=by)
    return out.withColumn("drawdown", F.try_divide("equity", "__peak") - 1).drop("__peak", "rn")


def sharpe(value: Column, periods: float) -> Column:
    return F.try_divide(F.avg(value), F.stddev_samp(value)) * F.sqrt(F.lit(float(periods)))


def compounded(value: Column) -> Column:
    return F.product(1 + value) - 1


def side_summary(rows: DataFrame, config: Config) -> DataFrame:
    """One row per series and side over rows with thresholds; only the counts if there's no trade."""
    held = rows.filter(F.col("long_threshold").isNotNull() & F.col("short_threshold").isNotNull())
    on = F.col("signal") != 0
    gross, net = F.when(on, F.col("gross_return")), F.when(on, F.col("net_return"))
    found = with_equity(held, [KEY, "side"]).groupBy(KEY, "side").agg(
        F.count_if(on).alias("trades"),
        F.count_if(F.col("signal") == 1).alias("long_trades"),
        F.count_if(F.col("signal") == -1).alias("short_trades"),
        (F.avg(gross) * 10_000).alias("gross_bps"),
        (F.avg(net) * 10_000).alias("net_bps"),
        F.avg((gross > 0).cast("double")).alias("gross_hit_rate"),
        F.avg((net > 0).cast("double")).alias("net_hit_rate"),
        (F.avg(F.when(F.col("signal") == 1, gross)) * 10_000).alias("long_bps"),
        (F.avg(F.when(F.col("signal") == -1, gross)) * 10_000).alias("short_bps"),
        sharpe(F.col("net_return"), config.periods_per_year).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        compounded(F.col("net_return")).alias("total_return"),
    )
    some = F.col("trades") > 0
    return found.withColumns({c: F.when(some, F.col(c)) for c in ("sharpe", "max_drawdown", "total_return")})


def side_monthly(rows: DataFrame) -> DataFrame:
    """Trades, basis points, hit rate and compounded return of each side and month."""
    on = F.col("signal") != 0
    net = F.when(on, F.col("net_return"))
    return rows.groupBy(KEY, "side", month(F.col("ts")).alias("month")).agg(
        F.count_if(on).alias("trades"),
        (F.avg(F.when(on, F.col("gross_return"))) * 10_000).alias("gross_bps"),
        (F.avg(net) * 10_000).alias("net_bps"),
        F.avg((net > 0).cast("double")).alias("net_hit_rate"),
        F.when(F.count_if(on) > 0, compounded(F.col("net_return"))).otherwise(0.0).alias("monthly_return"),
    )


def positive_months(monthly: DataFrame, by: list[str]) -> DataFrame:
    return monthly.groupBy(*by).agg(F.avg((F.col("monthly_return") > 0).cast("double")).alias("positive_months"))


def side_comparison(rows: DataFrame, config: Config) -> DataFrame:
    """The summary of every side with its parameters and the share of months above zero."""
    return (
        side_summary(rows, config)
        .join(positive_months(side_monthly(rows), [KEY, "side"]), [KEY, "side"])
        .withColumns({"tail": F.lit(config.tail), "cost_bps": F.lit(config.signal_cost * 10_000)})
    )


def positions(rows: DataFrame, config: Config, active: Column | None = None) -> DataFrame:
    """Long positions above the threshold, with turnover, costs and returns.

    The change on the first row is against no position. `active`: where returns and costs count.
    """
    here = F.lit(True) if active is None else active
    wanted = F.coalesce((F.col("prediction") >= F.col("long_threshold")).cast("int"), F.lit(0))
    out = with_previous(rows.withColumn("position", wanted), {"__before": "position"})
    change = F.col("position") - F.coalesce("__before", F.lit(0))
    out = out.withColumn("position_change", change).withColumn("turnover", F.abs("position_change")).drop("__before")
    return out.withColumns(
        {
            "gross_return": F.when(here, F.col("position") * F.col(LABEL)).otherwise(0.0),
            "transaction_cost": F.when(here, F.col("turnover") * config.turnover_cost).otherwise(0.0),
        }
    ).withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))


def position_summary(rows: DataFrame, config: Config) -> DataFrame:
    """One row per series over rows with a threshold; series that are never active have none."""
    on = F.col("position") == 1
    found = with_equity(rows.filter(F.col("long_threshold").isNotNull()), [KEY]).groupBy(KEY).agg(
        F.count_if(on).alias("active_periods"),
        F.count_if(F.col("position_change") == 1).alias("entries"),
        F.count_if(F.col("position_change") == -1).alias("exits"),
        F.sum("turnover").cast("long").alias("turnover"),
        (F.avg(F.when(on, F.col("gross_return"))) * 10_000).alias("gross_bps"),
        (F.sum("transaction_cost") * 10_000).alias("cost_bps"),
        sharpe(F.col("net_return"), config.periods_per_year).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        compounded(F.col("net_return")).alias("total_return"),
    )
    return found.filter("active_periods > 0")


def position_monthly(rows: DataFrame) -> DataFrame:
    on = F.col("position") == 1
    return rows.groupBy(KEY, month(F.col("ts")).alias("month")).agg(
        F.count_if(on).alias("active_periods"),
        F.sum("turnover").cast("long").alias("turnover"),
        (F.avg(F.when(on, F.col("gross_return"))) * 10_000).alias("gross_bps"),
        compounded(F.col("net_return")).alias("monthly_return"),
    )


def holding_runs(rows: DataFrame, bar_minutes: float, chunk: int = CHUNK) -> DataFrame:
    """Lengths of unbroken holdings: runs of position 1 by a running count of changes, chunk by chunk.

    A run is counted where its rows are, then over the chunks it goes on in; medians are of counted lengths.
    """
    shown = rows.select(KEY, "ts", "position", *[c for c in ("rn",) if c in rows.columns])
    changed = with_previous(shown, {"__before": "position"}, chunk)
    new = F.coalesce(F.col("position") != F.col("__before"), F.lit(True)).cast("int")
    runs = running_sum(changed, new, "run", chunk)
    lengths = written(runs.filter("position = 1").groupBy(KEY, "run").agg(F.count(F.lit(1)).alias("n")), "holdings")
    found = lengths.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("holdings"),
        F.avg("n").alias("mean_length"),
        F.max("n").alias("max_length"),
        (F.avg("n") * bar_minutes).alias("mean_minutes"),
    )
    return found.join(quantiles(lengths, F.col("n").cast("double"), [KEY], {"median_length": 0.5}), KEY)
