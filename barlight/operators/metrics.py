"""Prediction-quality metrics by group: errors, correlations, deciles, tails, robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.functions import stats
from barlight.functions.stats import month, safe_corr
from barlight.operators import ordered
from barlight.operators.features import LABEL

Y, P = LABEL, "prediction"


def scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows, mean absolute and root mean square error, Pearson correlation."""
    e = F.col(P) - F.col(Y)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        safe_corr(F.col(Y), F.col(P)).alias("pearson_ic"),
    )


def rank_ic(rows: DataFrame, by: list[str], small: bool = False) -> DataFrame:
    """Pearson and Spearman correlation over rows with both values; NULL for fewer than two.

    small: the groups fit a task each, so that windows rank them.
    """
    both = rows.filter(F.col(Y).isNotNull() & F.col(P).isNotNull())
    enough = F.count(F.lit(1)) >= 2
    ranked = stats.with_ranks(both, [Y, P], by) if small else ordered.with_ranks(both.select(*by, Y, P), [Y, P], by)
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.when(enough, safe_corr(F.col(Y), F.col(P))).alias("pearson_ic"),
        F.when(enough, safe_corr(F.col(f"{Y}_rank"), F.col(f"{P}_rank"))).alias("spearman_ic"),
    )


def with_decile(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """rows with `bin`, the quantile bin of the prediction's rank (ties by time): bin k holds ranks up to 1+(n-1)(k+1)/bins."""
    numbered = ordered.ordered_index(rows, [P, "ts"], by=by, size="n")
    r, n = F.col("rn"), F.col("n")
    at = F.when(n > 1, F.floor((bins * (r - 1) + n - 2) / F.greatest(n - 1, F.lit(1))) - 1).otherwise(0)
    return numbered.withColumn("bin", F.greatest(at, F.lit(0)).cast("int")).drop("rn", "n")


def decile_spread(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean label of the lowest and the highest tenth by prediction, and their difference."""
    binned = with_decile(rows.select(*by, "ts", P, Y), by).groupBy(*by)
    low, high = F.avg(F.when(F.col("bin") == 0, F.col(Y))), F.avg(F.when(F.col("bin") == 9, F.col(Y)))
    return binned.agg(low.alias("bottom_decile"), high.alias("top_decile"), (high - low).alias("decile_spread"))


def trimmed_ic(rows: DataFrame, by: list[str], q: float = 0.99) -> DataFrame:
    """Correlations over rows whose label is not beyond the q-quantile of its size."""
    size = F.abs(F.col(Y))
    limit = ordered.quantiles(rows, size, by, {"__limit": q})
    return rank_ic(rows.join(limit, by).filter(size <= F.col("__limit")).drop("__limit"), by)


def tail_metrics(rows: DataFrame, by: list[str], tail: float = 0.01) -> DataFrame:
    """Mean basis points and hit rate of going short at the lowest and long at the highest predictions."""
    joined = rows.join(ordered.quantiles(rows, F.col(P), by, {"__low": tail, "__high": 1 - tail}), by)
    low, high = F.col(P) <= F.col("__low"), F.col(P) >= F.col("__high")
    y = F.col(Y)
    return joined.groupBy(*by).agg(
        (-F.avg(F.when(low, y)) * 10_000).alias("short_bps"),
        F.avg(F.when(low, (y < 0).cast("double"))).alias("short_hit_rate"),
        (F.avg(F.when(high, y)) * 10_000).alias("long_bps"),
        F.avg(F.when(high, (y > 0).cast("double"))).alias("long_hit_rate"),
    )


def monthly_ic(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of the monthly Spearman correlation, share above zero."""
    per = rank_ic(rows.withColumn("month", month(F.col("ts"))), [*by, "month"], small=True)
    ic = F.col("spearman_ic")
    return per.groupBy(*by).agg(
        F.count(ic).alias("months"),
        F.avg(ic).alias("ic_mean"),
        F.stddev_pop(ic).alias("ic_std"),
        F.avg(F.when(ic.isNotNull(), (ic > 0).cast("double"))).alias("ic_positive"),
    )


def winner_removal(rows: DataFrame, by: list[str], tail: float = 0.01, drops: tuple[int, ...] = (0, 1, 3, 5)) -> DataFrame:
    """Mean basis points of the highest predictions without their best few labels (ties by time)."""
    top = rows.join(ordered.quantiles(rows, F.col(P), by, {"__edge": 1 - tail}), by).filter(F.col(P) >= F.col("__edge"))
    top = ordered.ordered_index(top.select(*by, "ts", Y), [F.desc(Y), "ts"], by=by).withColumnRenamed("rn", "n")
    return top.groupBy(*by).agg(
        *[(F.avg(F.when(F.col("n") > d, F.col(Y))) * 10_000).alias(f"remove_{d}") for d in drops]
    )
