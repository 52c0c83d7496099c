"""Registered queries over bars that Spark derives from the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.config import DAILY, HALF_HOUR
from barlight.functions.stats import KEY, month
from barlight.operators import backtest, drift, features, metrics, models, monitor, oos, ordered, targets, validate
from barlight.plans import sql
from barlight.session import shared_dir, written, written_at
from barlight.sources import bars as sources

VALIDATION, TEST = "2000-01-01", "2001-01-01"
CUTOFF = "2001-01-01"
HORIZON = DAILY.horizon_seconds
#: Boosting of the queries: ten times the usual step of 0.03, and a tenth of the usual trees (1,000 for
#: a comparison of losses, 300 for a target variant, 500 for a fold) and patience (50), as each tree is
#: several small jobs here. Early stopping decides below these limits.
STEP = 0.3
COMPARED_TREES = 100
TARGET_TREES = 30
WALK_TREES = 50
PATIENCE = 5
VARIANTS = {"raw": None, "vol_12": "volatility_12", "vol_48": "volatility_48"}
NUDGE = 1e-12


def tidy(df: DataFrame, *columns: str, time: str = "yyyy-MM-dd", wide: tuple[str, ...] = ()) -> DataFrame:
    """The columns in comparable form: doubles to 8 digits, integers as long, times as text.

    Columns in `wide`, of any magnitude, become text with 7 significant digits. Values move up by
    NUDGE first, so that an exact tie of the ninth digit rounds the same whatever its last bit.
    """
    out = []
    for c in columns:
        kind = df.schema[c].dataType
        if c in wide:
            out.append(F.when(F.col(c).isNotNull(), F.format_string("%.6e", F.col(c).cast("double"))).alias(c))
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.round(F.col(c).cast("double") + NUDGE, 8).alias(c))
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.LongType)):
            out.append(F.col(c).cast("long").alias(c))
        elif isinstance(kind, T.TimestampType):
            out.append(F.date_format(c, time).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def utc(spark: SparkSession) -> SparkSession:
    """The session in UTC, which days, months and hours of all queries are in."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def daily(spark: SparkSession, sf_dir: str, series: str = "l_returnflag") -> DataFrame:
    return sources.daily_bars(utc(spark), sf_dir, series)


def half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.event_bars(utc(spark), sf_dir)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily features with the momentum prediction: no trained model, so that SQL can follow."""
    table = features.feature_table(daily(spark, sf_dir), DAILY.bar_seconds, DAILY.horizon)
    return models.momentum(table)


def limited(rows: DataFrame) -> DataFrame:
    """Predictions of every third day, whose labels don't overlap, with thresholds; only the columns that reports look at."""
    shown = targets.thinned(rows, HORIZON).select(KEY, "ts", features.LABEL, *drift.WATCHED)
    return backtest.with_thresholds(shown, DAILY)


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the daily predictions."""
    return backtest.positions(limited(predicted(spark, sf_dir)), DAILY)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of the position backtest over all lines as one series."""
    table = features.feature_table(daily(spark, sf_dir, "'all'"), DAILY.bar_seconds, DAILY.horizon)
    rows = backtest.positions(limited(models.momentum(table)), DAILY)
    return tidy(backtest.position_monthly(rows), KEY, "month", "active_periods", "turnover", "gross_bps", "monthly_return")


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.signals(limited(predicted(spark, sf_dir)), DAILY)


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.monitored(held(spark, sf_dir), DAILY)


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test positions after the cutoff, with earlier predictions as warm-up."""
    rows = targets.thinned(predicted(spark, sf_dir), HORIZON).select(KEY, "ts", "prediction", features.LABEL)
    rows = written(rows, "predictions")
    history = sources.prediction_history(rows, CUTOFF)
    test = rows.filter(F.col("ts") >= F.lit(CUTOFF).cast("timestamp"))
    return oos.evaluated(history, test, rows, DAILY)


def stored_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `tested`, from a stage of predictions by month, to which a second run has written the last months anew."""
    path = shared_dir(spark, "stage")
    rows = targets.thinned(predicted(spark, sf_dir), HORIZON).select(KEY, "ts", "prediction", features.LABEL)
    rows = written(rows, "predictions")
    sources.write_monthly(rows, path)
    sources.write_monthly(rows.filter(F.col("ts") >= F.lit(CUTOFF).cast("timestamp")), path)
    history = sources.prediction_history(sources.read_monthly(spark, path, end=CUTOFF), CUTOFF)
    return oos.evaluated(history, sources.read_monthly(spark, path, begin=CUTOFF), sources.read_monthly(spark, path), DAILY)


def select_sql(ctes: str, table: str, columns: dict[str, str], where: str = "") -> str:
    """SQL of a query: columns by kind, d (8 digits), e (7 significant), i (long), s (as is), t (day), u (and time)."""
    form = {"e": "CASE WHEN {0} IS NOT NULL THEN printf('%.6e', {0}::DOUBLE) END", "d": "round({0}::DOUBLE + 1e-12::DOUBLE, 8)", "i": "({0})::BIGINT", "s": "{0}", "t": "strftime({0}, '%Y-%m-%d')", "u": "strftime({0}, '%Y-%m-%d %H:%M:%S')"}
    items = ", ".join(f"{form[k].format(c)} AS {c}" for c, k in columns.items())
    return f"WITH {ctes}\nSELECT {items} FROM {table} {where}"


def kinds(d: str = "", i: str = "", s: str = KEY, t: str = "", u: str = "", e: str = "") -> dict[str, str]:
    """Column kinds from blank-separated names."""
    return {c: k for k, names in (("s", s), ("t", t), ("u", u), ("i", i), ("d", d), ("e", e)) for c in names.split()}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, make: Callable[[SparkSession, str], DataFrame], columns: dict[str, str], ctes: str | None = None, table: str = "", where: str = "") -> None:
    """Register a query whose result is these columns; with ctes also its SQL."""
    time = "yyyy-MM-dd HH:mm:ss" if "u" in columns.values() else "yyyy-MM-dd"
    wide = tuple(c for c, k in columns.items() if k == "e")
    QUERIES[name] = lambda spark, sf_dir: tidy(make(spark, sf_dir), *columns, time=time, wide=wide)
    if ctes is not None:
        ORACLES[name] = select_sql(ctes, table, columns, where)


# --- sources and quality -------------------------------------------------------------------

PRICES = "open high low close volume"


def _bars_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour bars as raw rows with some repeated times, typed and cleaned."""
    bars = half_hours(spark, sf_dir)
    raw = bars.select(KEY, F.unix_millis("ts").alias("ts_ms"), *PRICES.split())
    again = raw.filter("ts_ms % 10800000 = 0").withColumn("open", F.col("open") + 1)
    return sources.clean_bars(sources.typed_bars(raw.unionByName(again)))


query(
    "bars_clean",
    _bars_clean,
    kinds(PRICES, u="ts"),
    sql.HALF_HOUR
    + """,
raw_ AS (SELECT * FROM bars UNION ALL SELECT * REPLACE (open + 1 AS open) FROM bars WHERE epoch_ms(ts) % 10800000 = 0),
one AS (SELECT * FROM raw_ QUALIFY row_number() OVER (PARTITION BY series_id, ts ORDER BY open, high, low, close, volume) = 1)""",
    "one",
)


def _bars_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written as a stage's CSV and Parquet tables and read back, with what differs between the two."""
    clean = sources.clean_bars(daily(spark, sf_dir))
    paths = {fmt: shared_dir(spark, f"stage-{fmt}") for fmt in ("csv", "parquet")}
    for fmt, path in paths.items():
        sources.write_stage(clean, path, fmt=fmt)
    bars, other = (sources.read_bars(spark, path, fmt) for fmt, path in paths.items())
    both = other.withColumn("in_both", F.lit(1)).dropDuplicates([KEY, "ts", "close"]).select(KEY, "ts", "close", "in_both")
    return bars.join(both, [KEY, "ts", "close"], "left").withColumn("in_both", F.coalesce("in_both", F.lit(0)))


query("bars_stored", _bars_stored, kinds(PRICES, "in_both", t="ts"), sql.DAILY + ",\no AS (SELECT *, 1 AS in_both FROM bars)", "o")
query(
    "quality_profile",
    lambda s, d: validate.profile(half_hours(s, d)),
    kinds(i="n_rows", u="first_ts last_ts"),
    sql.HALF_HOUR + ",\no AS (SELECT series_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1)",
    "o",
)


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with faults put in by day, so that every check finds some."""
    day = F.dayofmonth("ts")
    bars = daily(spark, sf_dir)
    return bars.select(
        KEY,
        F.when(day == 31, F.date_trunc("month", "ts")).otherwise(F.col("ts")).alias("ts"),
        F.when(day != 7, F.col("open")).alias("open"),
        F.when(day == 9, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(day == 11, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
        F.when(day == 13, F.lit(0.0)).otherwise(F.col("close")).alias("close"),
        F.when(day == 15, -F.col("volume")).when(day != 17, F.col("volume")).alias("volume"),
    )


_COUNTS = (
    "missing_ts missing_open missing_high missing_low missing_close missing_volume duplicate_ts nonpositive_open "
    "nonpositive_high nonpositive_low nonpositive_close high_too_low low_too_high negative_volume"
)
query(
    "quality_counts",
    lambda s, d: validate.counts(_spoiled(s, d)),
    kinds(i=_COUNTS),
    sql.DAILY
    + """,
sp AS (SELECT series_id, CASE WHEN day(ts) = 31 THEN date_trunc('month', ts)::TIMESTAMP ELSE ts END AS ts, CASE WHEN day(ts) <> 7 THEN open END AS open,
    CASE WHEN day(ts) = 9 THEN low - 1 ELSE high END AS high, CASE WHEN day(ts) = 11 THEN high + 1 ELSE low END AS low,
    CASE WHEN day(ts) = 13 THEN 0.0 ELSE close END AS close,
    CASE WHEN day(ts) = 15 THEN -volume WHEN day(ts) <> 17 THEN volume END AS volume FROM bars),
o AS (SELECT series_id, """
    + ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in ["ts", *PRICES.split()])
    + ", count(*) - count(DISTINCT ts) - max((ts IS NULL)::INTEGER) AS duplicate_ts, "
    + ", ".join(f"count(*) FILTER ({c} <= 0) AS nonpositive_{c}" for c in PRICES.split()[:4])
    + """, count(*) FILTER (high < greatest(open, close, low)) AS high_too_low,
    count(*) FILTER (low > least(open, close, high)) AS low_too_high, count(*) FILTER (volume < 0) AS negative_volume FROM sp GROUP BY 1)""",
    "o",
)
query(
    "quality_gaps",
    lambda s, d: validate.gaps(half_hours(s, d), HALF_HOUR.bar_seconds),
    kinds(i="gap_seconds missing_bars", u="previous_ts ts"),
    sql.HALF_HOUR
    + """,
g AS (SELECT series_id, ts, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS previous_ts FROM bars),
o AS (SELECT *, epoch(ts) - epoch(previous_ts) AS gap_seconds, floor((epoch(ts) - epoch(previous_ts)) / 1800) - 1 AS missing_bars
  FROM g WHERE epoch(ts) - epoch(previous_ts) > 1800)""",
    "o",
)

# --- features ------------------------------------------------------------------------------

query(
    "segments",
    lambda s, d: features.segmented(half_hours(s, d), HALF_HOUR.bar_seconds),
    kinds("close", "segment_id", u="ts"),
    sql.HALF_HOUR + "," + sql.segments(1800),
    "seg",
)


def _half_hour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.features_of(half_hours(spark, sf_dir), HALF_HOUR.bar_seconds)


_I_FEATURES = sql.HALF_HOUR + "," + sql.segments(1800) + "," + sql.features()
for _name, _columns in {
    "features_price": "return_1 return_3 return_6 return_12 return_24 ma_6 ma_12 ma_48 price_ma_ratio_6 price_ma_ratio_12 "
    "price_ma_ratio_48 volatility_6 volatility_12 volatility_48 future_return",
    "features_volume": "volume_change_1 volume_ma_12 volume_ma_48 volume_ratio_12 volume_ratio_48 volume_zscore_48",
}.items():
    query(_name, _half_hour_features, kinds(_columns, "segment_id", u="ts"), _I_FEATURES, "feat")
query(
    "features_candle_time",
    _half_hour_features,
    kinds("candle_return high_low_range upper_shadow lower_shadow", "segment_id hour day_of_week", u="ts"),
    _I_FEATURES,
    "feat",
)
query(
    "feature_table",
    lambda s, d: features.feature_table(daily(s, d), DAILY.bar_seconds, DAILY.horizon),
    kinds(" ".join([*PRICES.split(), *features.FEATURES[:-2], features.LABEL]), "segment_id hour day_of_week", t="ts"),
    sql.DAILY + "," + sql.segments(86_400) + "," + sql.features(),
    "clean",
)

# --- splits, targets, folds ----------------------------------------------------------------

query(
    "split_summary",
    lambda s, d: targets.split_summary(predicted(s, d), VALIDATION, TEST),
    kinds(i="n_rows", s=f"{KEY} split", t="first_ts last_ts"),
    sql.predicted()
    + f""",
o AS (SELECT series_id, CASE WHEN ts < '{VALIDATION}' THEN 'train' WHEN ts < '{TEST}' THEN 'validation' ELSE 'test' END AS split,
    count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM pred GROUP BY 1, 2)""",
    "o",
)


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = targets.normalized(predicted(spark, sf_dir), "volatility_48", DAILY.volatility_floor)
    return targets.clipped(rows, F.col("ts") < F.lit(VALIDATION).cast("timestamp"), DAILY.clip, [KEY])


query(
    "normalized_target",
    _target,
    kinds("lower upper target", t="ts"),
    sql.predicted()
    + f""",
nrm AS (SELECT series_id, ts, future_return / greatest(volatility_48, 1e-6::DOUBLE) AS raw_ FROM pred),
bnd AS (SELECT series_id, quantile_cont(raw_, 0.005) AS lower, quantile_cont(raw_, 0.995) AS upper FROM nrm WHERE ts < '{VALIDATION}' GROUP BY 1),
o AS (SELECT *, least(upper, greatest(lower, raw_)) AS target FROM nrm JOIN bnd USING (series_id))""",
    "o",
)
query(
    "fold_table",
    lambda s, d: targets.folds(targets.normalized(predicted(s, d), None), TEST, HORIZON, skip_empty=True),
    kinds("lower upper", "fit_rows validation_rows train_rows predict_rows", s=f"{KEY} month"),
    sql.predicted()
    + f""",
lst AS (SELECT series_id, max(ts) AS last FROM pred WHERE ts >= '{TEST}' GROUP BY 1),
mon_ AS (SELECT series_id, unnest(generate_series('{TEST}'::TIMESTAMP, date_trunc('month', last)::TIMESTAMP, INTERVAL 1 MONTH)) AS b FROM lst),
jn AS (SELECT p.series_id, p.ts, future_return, b, epoch(ts) AS e, epoch(b) AS m FROM pred p JOIN mon_ USING (series_id) WHERE ts < b + INTERVAL 1 MONTH),
o AS (SELECT series_id, strftime(b, '%Y-%m') AS month, count(*) FILTER (e < m - 2592000 - {HORIZON}) AS fit_rows,
    count(*) FILTER (e >= m - 2592000 AND e < m - {HORIZON}) AS validation_rows, count(*) FILTER (e < m - {HORIZON}) AS train_rows,
    count(*) FILTER (e >= m) AS predict_rows, quantile_cont(future_return, 0.005) FILTER (e < m - {HORIZON}) AS lower,
    quantile_cont(future_return, 0.995) FILTER (e < m - {HORIZON}) AS upper FROM jn GROUP BY series_id, b HAVING count(*) FILTER (e >= m) > 0
    AND count(*) FILTER (e < m - 2592000 - {HORIZON}) > 0 AND count(*) FILTER (e >= m - 2592000 AND e < m - {HORIZON}) > 0)""",
    "o",
)
query(
    "non_overlap",
    lambda s, d: targets.thinned(predicted(s, d), HORIZON),
    kinds("prediction future_return", t="ts"),
    sql.predicted(),
    "pred",
    f"WHERE epoch(ts)::BIGINT % {HORIZON} = 0",
)

# --- models and metrics --------------------------------------------------------------------


def _baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir)
    both = models.zero(rows).withColumn("model", F.lit("zero")).unionByName(rows.withColumn("model", F.lit("momentum")))
    return metrics.scores(both, [KEY, "model"])


query(
    "baseline_scores",
    _baselines,
    kinds("mae rmse pearson_ic", "n_rows", s=f"{KEY} model"),
    sql.predicted()
    + """,
two AS (SELECT series_id, future_return AS y, 0.0::DOUBLE AS p, 'zero' AS model FROM pred UNION ALL SELECT series_id, future_return, prediction, 'momentum' FROM pred),
o AS (SELECT series_id, model, count(*) AS n_rows, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse,
    covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0) AS pearson_ic FROM two GROUP BY 1, 2)""",
    "o",
)


def _parts(table: DataFrame, volatility: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of a feature table; targets in units of a volatility are clipped, raw ones not."""
    rows = targets.normalized(table, volatility)
    begin = F.lit(VALIDATION).cast("timestamp")
    if volatility:
        rows = targets.clipped(rows, F.col("ts") < begin, DAILY.clip, [KEY])
    return rows.filter(F.col("ts") < begin), rows.filter((F.col("ts") >= begin) & (F.col("ts") < F.lit(TEST).cast("timestamp")))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily feature table, written once for all fits."""
    return written(features.feature_table(daily(spark, sf_dir), DAILY.bar_seconds, DAILY.horizon), "features")


def _ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = _parts(_table(spark, sf_dir))
    return metrics.scores(models.ridge(train, valid), [KEY])


def _fit_and_valid() -> tuple[Column, Column]:
    begin, end = (F.lit(t).cast("timestamp") for t in (VALIDATION, TEST))
    return F.col("ts") < begin, (F.col("ts") >= begin) & (F.col("ts") < end)


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit, valid = _fit_and_valid()
    rows = targets.normalized(_table(spark, sf_dir), None).filter(fit | valid)
    losses = {"l1": "absolute", "l2": "squared", "huber": "huber"}
    return models.comparison(rows, fit, valid, losses, COMPARED_TREES, PATIENCE, STEP, ("close", features.LABEL))


def _target_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets raw and in units of two volatilities, these clipped: three models in step over one table."""
    fit, valid = _fit_and_valid()
    rows = _table(spark, sf_dir).filter(fit | valid)
    for name, volatility in VARIANTS.items():
        rows = targets.normalized(rows, volatility)
        if volatility:
            rows = targets.clipped(rows, fit, DAILY.clip, [KEY]).drop("lower", "upper")
        rows = rows.withColumnRenamed("target", f"target_{name}")
    jobs = {name: models.Job(fit, f"target_{name}", "absolute", TARGET_TREES, valid) for name in VARIANTS}
    found, _ = models.boosted(rows, jobs, [KEY, "ts", features.LABEL, *[j.target for j in jobs.values()]], PATIENCE, STEP)
    # the market's own return is what all variants are scored on
    out = models.tagged(targets.thinned(found.filter(valid), HORIZON), list(jobs)).select("ts", "prediction", features.LABEL, "model")
    return models.target_scores(written(out, "variants"))


def _walkforward(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The target rows, and the predictions of every month from the test's start to the last row."""
    rows = targets.normalized(_table(spark, sf_dir), "volatility_48")
    months = targets.months_from(rows, TEST)
    return rows, models.walkforward(rows, months, HORIZON, WALK_TREES, skip_empty=True, clip=DAILY.clip, patience=PATIENCE, step=STEP)


#: Paths of trained predictions by application, tables and name: queries that look at the same models train them once.
_trained: dict[tuple[str, str, str], str] = {}


def trained(name: str, make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Predictions as a stored stage of this application: written by the first query that needs them, read by all."""

    def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _trained:
            utc(spark)
            _trained[key] = written_at(make(spark, sf_dir), name)[1]
        return utc(spark).read.parquet(_trained[key])

    return stored


_compared_once = trained("compared", _compared)
_walked_once = trained("walked", lambda spark, sf_dir: _walkforward(spark, sf_dir)[1])
_SCORES = kinds("mae rmse pearson_ic spearman_ic trimmed_pearson_ic trimmed_spearman_ic", "n_rows", s="model")
query("ridge_score", _ridge, kinds("mae rmse pearson_ic", "n_rows"))
query("gbt_comparison", lambda s, d: models.model_scores(_compared_once(s, d)), _SCORES)
query(
    "gbt_targets",
    _target_variants,
    _SCORES
    | kinds(
        "bottom_decile top_decile decile_spread short_bps short_hit_rate long_bps long_hit_rate ic_mean ic_std ic_positive "
        "remove_0 remove_1 remove_3 remove_5",
        "months",
        s="model",
    ),
)
query("best_model", lambda s, d: models.best_model(_compared_once(s, d)), kinds("close future_return prediction", s=f"{KEY} model", t="ts"))
query("walkforward_predictions", _walked_once, kinds("prediction", "best_iteration", s=f"{KEY} prediction_month", t="ts"))


def _fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = targets.normalized(_table(spark, sf_dir), "volatility_48"), _walked_once(spark, sf_dir)
    return models.fold_report(targets.folds(rows, TEST, HORIZON, skip_empty=True), found)


query(
    "fold_report",
    _fold_report,
    kinds("lower upper", "fit_rows validation_rows train_rows predict_rows best_iteration", s=f"{KEY} month"),
)
query(
    "rank_metrics",
    lambda s, d: metrics.rank_ic(predicted(s, d), [KEY]),
    kinds("pearson_ic spearman_ic", "n_rows"),
    sql.predicted() + "," + sql.ic("pred", "series_id", "o"),
    "o",
)
query(
    "decile_spread",
    lambda s, d: metrics.decile_spread(predicted(s, d), [KEY]),
    kinds("bottom_decile top_decile decile_spread"),
    sql.predicted()
    + """,
nr AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY prediction, ts) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM pred),
bn AS (SELECT *, greatest((10 * (r - 1) + n - 2) // (n - 1) - 1, 0) AS bin FROM nr),
o AS (SELECT series_id, avg(future_return) FILTER (bin = 0) AS bottom_decile, avg(future_return) FILTER (bin = 9) AS top_decile,
    avg(future_return) FILTER (bin = 9) - avg(future_return) FILTER (bin = 0) AS decile_spread FROM bn GROUP BY 1)""",
    "o",
)
query(
    "trimmed_ic",
    lambda s, d: metrics.trimmed_ic(predicted(s, d), [KEY]),
    kinds("pearson_ic spearman_ic", "n_rows"),
    sql.predicted()
    + """,
lim AS (SELECT series_id, quantile_cont(abs(future_return), 0.99) AS lim FROM pred GROUP BY 1),
trm AS (SELECT pred.* FROM pred JOIN lim USING (series_id) WHERE abs(future_return) <= lim),"""
    + sql.ic("trm", "series_id", "o"),
    "o",
)
query(
    "tail_metrics",
    lambda s, d: metrics.tail_metrics(predicted(s, d), [KEY]),
    kinds("short_bps short_hit_rate long_bps long_hit_rate"),
    sql.predicted()
    + """,
q AS (SELECT series_id, quantile_cont(prediction, 0.01) AS lo, quantile_cont(prediction, 0.99) AS hi FROM pred GROUP BY 1),
o AS (SELECT series_id, -avg(future_return) FILTER (prediction <= lo) * 10000 AS short_bps,
    avg((future_return < 0)::INTEGER) FILTER (prediction <= lo) AS short_hit_rate, avg(future_return) FILTER (prediction >= hi) * 10000 AS long_bps,
    avg((future_return > 0)::INTEGER) FILTER (prediction >= hi) AS long_hit_rate FROM pred JOIN q USING (series_id) GROUP BY 1)""",
    "o",
)
query(
    "monthly_ic",
    lambda s, d: metrics.monthly_ic(predicted(s, d), [KEY]),
    kinds("ic_mean ic_std ic_positive", "months"),
    sql.predicted()
    + ","
    + sql.ic("pred", "series_id, month", "mic")
    + """,
o AS (SELECT series_id, count(spearman_ic) AS months, avg(spearman_ic) AS ic_mean, stddev_pop(spearman_ic) AS ic_std,
    avg((spearman_ic > 0)::INTEGER) AS ic_positive FROM mic GROUP BY 1)""",
    "o",
)
query(
    "winner_removal",
    lambda s, d: metrics.winner_removal(predicted(s, d), [KEY]),
    kinds("remove_0 remove_1 remove_3 remove_5"),
    sql.predicted()
    + """,
q AS (SELECT series_id, quantile_cont(prediction, 0.99) AS hi FROM pred GROUP BY 1),
tp AS (SELECT pred.*, row_number() OVER (PARTITION BY series_id ORDER BY future_return DESC, ts) AS n FROM pred JOIN q USING (series_id) WHERE prediction >= hi),
o AS (SELECT series_id, """
    + ", ".join(f"avg(future_return) FILTER (n > {k}) * 10000 AS remove_{k}" for k in (0, 1, 3, 5))
    + " FROM tp GROUP BY 1)",
    "o",
)

# --- signals and backtests -----------------------------------------------------------------

query(
    "rolling_thresholds",
    lambda s, d: limited(predicted(s, d)),
    kinds("prediction short_threshold long_threshold", t="ts"),
    sql.predicted() + "," + sql.thresholds(),
    "thr",
)
query(
    "side_backtest",
    sided,
    kinds("gross_return transaction_cost net_return", "signal", s=f"{KEY} side", t="ts"),
    sql.sides(),
    "side_bt",
)
query(
    "side_monthly",
    lambda s, d: backtest.side_monthly(sided(s, d)),
    kinds("gross_bps net_bps net_hit_rate monthly_return", "trades", s=f"{KEY} side month"),
    sql.sides() + "," + sql.side_months(),
    "side_m",
)
_SUMMARY = "gross_hit_rate net_hit_rate long_bps short_bps"
query(
    "side_summary",
    lambda s, d: backtest.side_summary(sided(s, d), DAILY),
    kinds(_SUMMARY, "trades long_trades short_trades", s=f"{KEY} side", e="gross_bps net_bps sharpe max_drawdown total_return"),
    sql.sides() + "," + sql.side_sum(),
    "side_s",
)
query(
    "side_comparison",
    lambda s, d: backtest.side_comparison(sided(s, d), DAILY),
    kinds("positive_months tail cost_bps", "trades", s=f"{KEY} side", e="net_bps sharpe total_return"),
    sql.sides()
    + ","
    + sql.side_sum()
    + ","
    + sql.side_months()
    + """,
pm AS (SELECT series_id, side, avg((monthly_return > 0)::INTEGER) AS positive_months FROM side_m GROUP BY ALL),
o AS (SELECT *, 0.01 AS tail, 1.0 AS cost_bps FROM side_s JOIN pm USING (series_id, side))""",
    "o",
)
query(
    "position_backtest",
    held,
    kinds("gross_return transaction_cost net_return", "position position_change turnover", t="ts"),
    sql.backtested(),
    "pos",
)
query(
    "position_summary",
    lambda s, d: backtest.position_summary(held(s, d), DAILY),
    kinds("gross_bps cost_bps max_drawdown", "active_periods entries exits turnover", e="sharpe total_return"),
    sql.backtested()
    + f""",
e AS (SELECT *, product(1 + net_return) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM pos WHERE long_threshold IS NOT NULL),
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM e),
o AS (SELECT series_id, count(*) FILTER (position = 1) AS active_periods, count(*) FILTER (position_change = 1) AS entries,
    count(*) FILTER (position_change = -1) AS exits, sum(turnover) AS turnover, avg(gross_return) FILTER (position = 1) * 10000 AS gross_bps,
    sum(transaction_cost) * 10000 AS cost_bps, avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt({sql.PERIODS}) AS sharpe,
    min(drawdown) AS max_drawdown, product(1 + net_return) - 1 AS total_return FROM dd GROUP BY 1 HAVING count(*) FILTER (position = 1) > 0)""",
    "o",
)
query(
    "position_monthly",
    lambda s, d: backtest.position_monthly(held(s, d)),
    kinds("gross_bps monthly_return", "active_periods turnover", s=f"{KEY} month"),
    sql.backtested()
    + """,
o AS (SELECT series_id, month, count(*) FILTER (position = 1) AS active_periods, sum(turnover) AS turnover,
    avg(gross_return) FILTER (position = 1) * 10000 AS gross_bps, product(1 + net_return) - 1 AS monthly_return FROM pos GROUP BY 1, 2)""",
    "o",
)
query(
    "holding_runs",
    lambda s, d: backtest.holding_runs(held(s, d), 1440.0),
    kinds("mean_length median_length mean_minutes", "holdings max_length"),
    sql.backtested()
    + """,
fl AS (SELECT *, CASE WHEN position IS DISTINCT FROM lag(position) OVER (PARTITION BY series_id ORDER BY ts) THEN 1 ELSE 0 END AS nw FROM pos),
rn_ AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM fl),
ln_ AS (SELECT series_id, run, count(*) AS n FROM rn_ WHERE position = 1 GROUP BY 1, 2),
o AS (SELECT series_id, count(*) AS holdings, avg(n) AS mean_length, quantile_cont(n, 0.5) AS median_length, max(n) AS max_length,
    avg(n) * 1440 AS mean_minutes FROM ln_ GROUP BY 1)""",
    "o",
)

# --- drift ---------------------------------------------------------------------------------

query(
    "psi_monthly",
    lambda s, d: drift.monthly_psi(targets.thinned(predicted(s, d), HORIZON)),
    kinds(" ".join(f"{c}_psi" for c in drift.WATCHED), s=f"{KEY} month"),
    sql.backtested() + "," + sql.psi(),
    "psi_m",
)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_report(held(spark, sf_dir))


QUERIES["drift_report"] = lambda s, d: tidy(
    _report(s, d), KEY, "month", "max_psi_level", "n_rows", "active_periods", *sql.REPORT
)
ORACLES["drift_report"] = select_sql(
    sql.drift()
    + """,
o AS (SELECT *, CASE WHEN max_psi IS NULL THEN 'NA' WHEN max_psi < 0.1 THEN 'stable' WHEN max_psi < 0.25 THEN 'moderate' ELSE 'large' END AS max_psi_level FROM rep)""",
    "o",
    kinds(" ".join(sql.REPORT), "n_rows active_periods", s=f"{KEY} month max_psi_level"),
)
query(
    "drift_top",
    lambda s, d: drift.extreme_months(_report(s, d)),
    kinds("gross_bps max_psi", "rank", s=f"{KEY} list month"),
    sql.drift()
    + """,
o AS (SELECT series_id, 'worst' AS list, month, gross_bps, max_psi, row_number() OVER (PARTITION BY series_id ORDER BY gross_bps NULLS LAST, month) AS rank
    FROM rep QUALIFY rank <= 5
  UNION ALL SELECT series_id, 'drift', month, gross_bps, max_psi, row_number() OVER (PARTITION BY series_id ORDER BY max_psi DESC, month) AS rank
    FROM rep WHERE max_psi IS NOT NULL QUALIFY rank <= 5)""",
    "o",
)
query(
    "drift_vs_performance",
    lambda s, d: drift.drift_vs_performance(_report(s, d)),
    kinds("pearson spearman", "months"),
    sql.drift()
    + f""",
bo AS (SELECT * FROM rep WHERE mean_psi IS NOT NULL AND gross_bps IS NOT NULL),
br AS (SELECT *, {sql.rank("mean_psi", "series_id")} AS mr, {sql.rank("gross_bps", "series_id")} AS gr FROM bo),
o AS (SELECT series_id, count(*) AS months, covar_pop(mean_psi, gross_bps) / nullif(stddev_pop(mean_psi) * stddev_pop(gross_bps), 0) AS pearson,
    covar_pop(mr, gr) / nullif(stddev_pop(mr) * stddev_pop(gr), 0) AS spearman FROM br GROUP BY 1)""",
    "o",
)

# --- monitoring ----------------------------------------------------------------------------

_ROLLING = (
    "is_win rolling_signal_count rolling_signal_frequency rolling_avg_gross_bps rolling_hit_rate "
    "current_drawdown_30d historical_signal_frequency signal_frequency_ratio"
)
query(
    "monitor_rolling",
    lambda s, d: monitor.rolling_metrics(held(s, d), DAILY),
    kinds(_ROLLING, "is_active", t="ts", e="equity rolling_30d_return"),
    sql.monitor(),
    "mon",
)
query(
    "monitor_max_drawdown",
    lambda s, d: monitor.rolling_metrics(held(s, d), DAILY),
    kinds("rolling_max_drawdown_30d", t="ts"),
    sql.max_drawdown(),
    "mdd",
)
_MEASURES = " ".join(c for c in monitor.MEASURES if c != "rolling_30d_return")
_STATES = f"{KEY} sample_status raw_performance_status performance_status alert_reason overall_status"
query("monitor_status", watched, kinds(s=_STATES, t="ts"), sql.status(), "sta")
query(
    "monitor_counts",
    lambda s, d: monitor.status_counts(watched(s, d)),
    kinds(i="n_rows", s=f"{KEY} overall_status"),
    sql.status() + ",\no AS (SELECT series_id, overall_status, count(*) AS n_rows FROM sta GROUP BY 1, 2)",
    "o",
)
query(
    "monitor_daily",
    lambda s, d: monitor.daily(watched(s, d)),
    kinds("rolling_signal_count rolling_avg_gross_bps rolling_hit_rate", s=_STATES, t="ts", e="equity"),
    sql.days(),
    "day_",
)
query(
    "monitor_monthly",
    lambda s, d: monitor.monthly(watched(s, d)),
    kinds(f"{_MEASURES} alert_share critical_share", "days", s=f"{KEY} month {' '.join(monitor.STATES)}", e="equity rolling_30d_return"),
    sql.days()
    + """,
o AS (SELECT series_id, month, count(*) AS days, """
    + ", ".join(f"last({c} ORDER BY ts) AS {c}" for c in [*monitor.STATES, *monitor.MEASURES, "equity"])
    + """, avg((performance_status IN ('WARNING', 'CRITICAL'))::INTEGER) AS alert_share,
    avg((performance_status = 'CRITICAL')::INTEGER) AS critical_share FROM day_ GROUP BY 1, 2)""",
    "o",
)
query(
    "monitor_reasons",
    lambda s, d: monitor.reason_counts(watched(s, d)),
    kinds(i="n_rows", s=f"{KEY} reason"),
    sql.status()
    + """,
ex AS (SELECT series_id, unnest(string_split(alert_reason, '|')) AS reason FROM sta WHERE alert_reason <> 'NONE'),
o AS (SELECT series_id, reason, count(*) AS n_rows FROM ex GROUP BY 1, 2)""",
    "o",
)
query(
    "monitor_transitions",
    lambda s, d: monitor.transitions(watched(s, d)),
    kinds(_MEASURES, s=f"{KEY} previous_status raw_performance_status {' '.join(monitor.STATES)}", t="ts", e="rolling_30d_return"),
    sql.status()
    + """,
lg AS (SELECT *, lag(overall_status) OVER (PARTITION BY series_id ORDER BY ts) AS previous_status FROM sta),
o AS (SELECT * FROM lg WHERE overall_status IS DISTINCT FROM previous_status QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 40)""",
    "o",
)

# --- out of sample, long series ------------------------------------------------------------

query(
    "oos_predictions",
    tested,
    kinds("prediction long_threshold future_return gross_return transaction_cost net_return", "position position_change turnover", t="ts"),
    sql.oos(CUTOFF),
    "tst",
)
_IC = sql.ic("tst", "series_id", "tic")
query(
    "oos_summary",
    lambda s, d: oos.summary(tested(s, d), DAILY),
    kinds(
        "signal_frequency gross_bps net_edge_bps gross_hit_rate cost_bps max_drawdown pearson_ic spearman_ic",
        "test_rows active_periods entries exits",
        t="first_ts last_ts",
        e="sharpe total_return",
    ),
    sql.oos(CUTOFF)
    + ","
    + _IC
    + f""",
te AS (SELECT *, product(1 + net_return) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM tst),
td AS (SELECT *, equity / max(equity) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM te),
ts_ AS (SELECT series_id, count(*) AS test_rows, count(*) FILTER (position = 1) AS active_periods, count(*) FILTER (position_change = 1) AS entries,
    count(*) FILTER (position_change = -1) AS exits, avg(position) AS signal_frequency, avg(gross_return) FILTER (position = 1) * 10000 AS gross_bps,
    avg(gross_return) FILTER (position = 1) * 10000 - sum(transaction_cost) * 10000 / nullif(count(*) FILTER (position = 1), 0) AS net_edge_bps,
    avg((gross_return > 0)::INTEGER) FILTER (position = 1) AS gross_hit_rate, sum(transaction_cost) * 10000 AS cost_bps,
    avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt({sql.PERIODS}) AS sharpe, min(drawdown) AS max_drawdown,
    product(1 + net_return) - 1 AS total_return, min(ts) AS first_ts, max(ts) AS last_ts FROM td GROUP BY 1),
o AS (SELECT * FROM ts_ LEFT JOIN tic USING (series_id))""",
    "o",
)
_OOS_MONTHLY = kinds(
    "signal_frequency gross_bps gross_hit_rate cost_bps monthly_return pearson_ic spearman_ic",
    "n_rows active_periods",
    s=f"{KEY} month is_partial",
)
query(
    "oos_monthly",
    lambda s, d: oos.monthly(tested(s, d)),
    _OOS_MONTHLY,
    sql.oos(CUTOFF)
    + ","
    + sql.ic("tst", "series_id, month", "mic").replace("count(*) AS n_rows", "count(*) AS n_ic")
    + """,
om AS (SELECT series_id, month, count(*) AS n_rows, count(*) FILTER (position = 1) AS active_periods, avg(position) AS signal_frequency,
    avg(gross_return) FILTER (position = 1) * 10000 AS gross_bps, avg((gross_return > 0)::INTEGER) FILTER (position = 1) AS gross_hit_rate,
    sum(transaction_cost) * 10000 AS cost_bps, product(1 + net_return) - 1 AS monthly_return,
    max(ts) < date_trunc('month', max(ts)) + INTERVAL 1 MONTH AS is_partial FROM tst GROUP BY 1, 2),
o AS (SELECT * FROM om LEFT JOIN mic USING (series_id, month))""",
    "o",
)
QUERIES["oos_stored"] = lambda s, d: tidy(oos.monthly(stored_test(s, d)), *_OOS_MONTHLY)
ORACLES["oos_stored"] = ORACLES["oos_monthly"]
query(
    "ordered_index",
    lambda s, d: ordered.ordered_index(daily(s, d), ["ts"]),
    kinds("close", "rn", t="ts"),
    sql.DAILY + ",\no AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM bars)",
    "o",
)
query(
    "running_equity",
    lambda s, d: ordered.running_product(ordered.ordered_index(held(s, d), ["ts"]), 1 + F.col("net_return"), "equity", 100),
    kinds(i="rn", t="ts", e="equity"),
    sql.backtested()
    + """,
o AS (SELECT *, product(1 + net_return) OVER w AS equity, row_number() OVER w AS rn FROM pos
  WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING))""",
    "o",
)
