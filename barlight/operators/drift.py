"""Population drift: stability index against all earlier months, monthly summaries, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.stats import KEY, month, safe_corr, with_ranks
from barlight.operators.backtest import compounded
from barlight.operators.ordered import Expanding, quantiles
from barlight.session import written

WATCHED = ("prediction", "volatility_48", "volume_ratio_48", "return_12", "price_ma_ratio_48")
BINS = 10
LEAST = 1e-6


def psi(samples: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """Stability index of samples(by.., value, current): current values against the others.

    Edges are the distinct quantiles of the reference values, the outer ones open; fewer than
    three leave NULL. Shares below 1e-6 count as that; bins without values take part.
    """
    known = samples.filter("value is not null")
    q = F.percentile(F.when(~F.col("current"), F.col("value")), [i / bins for i in range(bins + 1)])
    edges = known.groupBy(*by).agg(
        q.alias("q"), F.count_if("current").alias("__c"), F.count_if(~F.col("current")).alias("__r")
    )
    distinct = F.array_distinct("q")
    edges = edges.withColumn("n_bins", F.size(distinct) - 1).withColumn(
        "inner", F.when(F.size(distinct) >= 3, F.slice(distinct, 2, F.size(distinct) - 2))
    )
    at = F.size(F.filter("inner", lambda e: e <= F.col("value")))
    counts = known.join(edges.select(*by, "inner"), by).filter("inner is not null").groupBy(*by, at.alias("bin"))
    counts = counts.agg(F.count_if("current").alias("c"), F.count_if(~F.col("current")).alias("r"))
    every = edges.filter("inner is not null and __c > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)))
    shares = every.join(counts, [*by, "bin"], "left").select(
        *by,
        F.greatest(F.coalesce("c", F.lit(0)) / F.col("__c"), F.lit(LEAST)).alias("c"),
        F.greatest(F.coalesce("r", F.lit(0)) / F.col("__r"), F.lit(LEAST)).alias("r"),
    )
    found = shares.groupBy(*by).agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))
    return edges.select(*by).join(found, by, "left")


def monthly_psi(rows: DataFrame, columns: tuple[str, ...] = WATCHED, bins: int = BINS) -> DataFrame:
    """Each month but the first against all earlier ones, as `psi` does it: a `<column>_psi` each.

    Edges and counts of the earlier months come from blocks of values in order (`ordered.Expanding`), so
    that a row is not copied to all later months; its own month's edges are joined to it once.
    """
    by = [KEY, "column"]
    key = [*by, "month"]
    rows = written(rows.select(KEY, month(F.col("ts")).alias("month"), *columns), "drift")
    long = rows.unpivot([KEY, "month"], list(columns), "column", "value").filter("value is not null")
    months = rows.select(KEY, F.col("month").alias("until")).distinct()
    first = months.groupBy(KEY).agg(F.min("until").alias("first"))
    later = months.join(first, KEY).filter("until > first").drop("first")
    each = later.select(KEY, F.explode(F.array(*map(F.lit, columns))).alias("column"), "until")
    before = Expanding(long, F.col("value"), by, F.col("month"), each)
    edges = before.quantiles([i / bins for i in range(bins + 1)]).withColumn("q", F.array_distinct("q"))
    inner = F.slice("q", 2, F.size("q") - 2)
    edges = edges.filter(F.size("q") >= 3).select(*by, F.col("until").alias("month"), F.col("n").alias("all"), inner.alias("inner"))
    edges = written(edges, "edges")
    # earlier months: values under each edge, then the differences
    bounds = edges.select(*by, F.col("month").alias("until"), F.posexplode("inner").alias("at", "bound"))
    less = bounds.join(before.below(bounds.drop("at")), [*by, "until", "bound"]).select(*by, F.col("until").alias("month"), "at", "less")
    last = edges.select(*key, F.size("inner").alias("at"), F.col("all").alias("less"))
    order = Window.partitionBy(*key).orderBy("at")
    earlier = less.unionByName(last).withColumn("r", F.col("less") - F.coalesce(F.lag("less").over(order), F.lit(0)))
    # the month itself
    at = F.size(F.filter("inner", lambda e: e <= F.col("value")))
    own = long.join(edges, key).groupBy(*key, at.alias("at")).agg(F.count(F.lit(1)).alias("c"))
    size = own.groupBy(*key).agg(F.sum("c").alias("held"))
    shares = earlier.join(own, [*key, "at"], "left").join(size, key).join(edges.select(*key, "all"), key)
    c = F.greatest(F.coalesce("c", F.lit(0)) / F.col("held"), F.lit(LEAST))
    r = F.greatest(F.col("r") / F.col("all"), F.lit(LEAST))
    found = shares.groupBy(*key).agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
    pivoted = found.groupBy(KEY, "month").pivot("column", list(columns)).agg(F.first("psi"))
    out = later.withColumnRenamed("until", "month").join(pivoted, [KEY, "month"], "left")
    return out.select(KEY, "month", *[F.col(c).alias(f"{c}_psi") for c in columns])


def monthly_summary(rows: DataFrame) -> DataFrame:
    """Activity, predictions and returns of each month; the quantiles of all months come from one numbering of counted values."""
    rows = rows.withColumn("month", month(F.col("ts")))
    tails = quantiles(rows, F.col("prediction"), [KEY, "month"], {"prediction_p01": 0.01, "prediction_p99": 0.99})
    on = F.col("position") == 1
    gross = F.when(on, F.col("gross_return"))
    found = rows.groupBy(KEY, "month").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(on).alias("active_periods"),
        F.avg(on.cast("double")).alias("signal_frequency"),
        F.avg("prediction").alias("prediction_mean"),
        F.stddev_samp("prediction").alias("prediction_std"),
        (F.avg(gross) * 10_000).alias("gross_bps"),
        F.avg((gross > 0).cast("double")).alias("signal_hit_rate"),
        compounded(F.col("net_return")).alias("monthly_return"),
    )
    return found.join(tails, [KEY, "month"], "left")


def monthly_stats(rows: DataFrame, columns: tuple[str, ...] = WATCHED[1:]) -> DataFrame:
    each = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    return rows.groupBy(KEY, month(F.col("ts")).alias("month")).agg(*each)


def psi_level(value: Column) -> Column:
    return F.when(value.isNull(), "NA").when(value < 0.10, "stable").when(value < 0.25, "moderate").otherwise("large")


def drift_report(rows: DataFrame, columns: tuple[str, ...] = WATCHED) -> DataFrame:
    """Summary, stability indices and feature statistics of each month, with mean, greatest and level."""
    key = [KEY, "month"]
    kept = {KEY, "ts", "position", "gross_return", "net_return", *columns}
    rows = written(rows.select(*[c for c in rows.columns if c in kept]), "drift")
    report = monthly_summary(rows).join(monthly_psi(rows, columns), key, "left").join(
        monthly_stats(rows, columns[1:]), key, "left"
    )
    values = [F.col(f"{c}_psi") for c in columns]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    known = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return report.withColumns({"mean_psi": F.try_divide(total, known), "max_psi": F.greatest(*values)}).withColumn(
        "max_psi_level", psi_level(F.col("max_psi"))
    )


def extreme_months(report: DataFrame, n: int = 5) -> DataFrame:
    """The n months of each series with the lowest basis points (those without any come last), and with the highest max_psi."""
    low = F.row_number().over(Window.partitionBy(KEY).orderBy(F.asc_nulls_last("gross_bps"), "month"))
    high = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc_nulls_last("max_psi"), "month"))
    kept = [KEY, "month", "gross_bps", "max_psi", "rank"]
    worst = report.withColumn("rank", low)
    drifted = report.filter("max_psi is not null").withColumn("rank", high)
    return (
        worst.select(F.lit("worst").alias("list"), *kept)
        .unionByName(drifted.select(F.lit("drift").alias("list"), *kept))
        .filter(F.col("rank") <= n)
    )


def drift_vs_performance(report: DataFrame) -> DataFrame:
    """Correlations over months of mean_psi and basis points."""
    both = report.filter("mean_psi is not null and gross_bps is not null")
    ranked = with_ranks(both, ["mean_psi", "gross_bps"], [KEY])
    return ranked.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("months"),
        safe_corr(F.col("mean_psi"), F.col("gross_bps")).alias("pearson"),
        safe_corr(F.col("mean_psi_rank"), F.col("gross_bps_rank")).alias("spearman"),
    )
