"""Gap-aware rolling features and the forward-return label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barlight.functions.stats import KEY, by_time, full
from barlight.operators.ordered import CHUNK, haloed, in_chunk, ordered_index, owned

RETURNS = (1, 3, 6, 12, 24)
AVERAGES = (6, 12, 48)
VOLUME_AVERAGES = (12, 48)
FEATURES = [
    *[f"return_{k}" for k in RETURNS],
    *[f"price_ma_ratio_{w}" for w in AVERAGES],
    *[f"volatility_{w}" for w in AVERAGES],
    "volume_change_1",
    *[f"volume_ratio_{w}" for w in VOLUME_AVERAGES],
    "volume_zscore_48",
    "candle_return",
    "high_low_range",
    "upper_shadow",
    "lower_shadow",
    "hour",
    "day_of_week",
]
LABEL = "future_return"


#: What a row's features look back on: returns, then 48 of them.
REACH = max(AVERAGES) + 1


def _segments(bars: DataFrame, bar_seconds: int, before: int, after: int, chunk: int) -> DataFrame:
    """bars in chunks with a halo, with segment_id: flags of new segments, summed up in each chunk and over the chunks before."""
    rows = haloed(ordered_index(bars, ["ts"]), before, after, chunk)
    last = F.lag("ts").over(in_chunk())
    new = last.isNull() | (F.unix_seconds("ts") - F.unix_seconds(last) > bar_seconds)
    # the first row lent to a chunk has none before it: it is in the segment of the next
    new = F.when(F.lag("rn").over(in_chunk()).isNull(), F.col("rn") == 1).otherwise(new)
    rows = rows.withColumn("__new", new.cast("long"))
    totals = rows.groupBy(KEY, "__chunk").agg(F.sum(F.when(F.col("__own"), F.col("__new"))).alias("__n"))
    earlier = Window.partitionBy(KEY).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(KEY, "__chunk", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    size = max(chunk, before, after)
    lent = F.sum(F.when(F.col("rn") <= F.col("__chunk") * size, F.col("__new")).otherwise(0)).over(Window.partitionBy(KEY, "__chunk"))
    here = F.sum("__new").over(in_chunk())
    rows = rows.withColumns({"__here": here, "__lent": lent}).join(totals, [KEY, "__chunk"])
    return rows.withColumn("segment_id", F.col("__base") + F.col("__here") - F.col("__lent")).drop("__new", "__here", "__lent", "__base")


def segmented(bars: DataFrame, bar_seconds: int, chunk: int = CHUNK) -> DataFrame:
    """bars with segment_id: runs without a gap of more than one bar, numbered from 1."""
    return owned(_segments(bars, bar_seconds, 1, 0, chunk)).drop("rn")


def _ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def with_features(bars: DataFrame, horizon: int = 3, window: WindowSpec | None = None) -> DataFrame:
    """Segmented bars with all features and the label; NULL wherever a window is not full.

    Two window stages over one partitioning: volatility needs the returns of the first. `window` is the
    rows of a segment in order, or of a part of it that has REACH rows before and `horizon` after those that count.
    """
    w = window or by_time("segment_id")
    close, volume, opened = F.col("close"), F.col("volume"), F.col("open")
    first = {f"return_{k}": _ratio(close, F.lag("close", k).over(w)) - 1 for k in RETURNS}
    first |= {f"ma_{n}": full(F.avg, close, w, n) for n in AVERAGES}
    first |= {f"volume_ma_{n}": full(F.avg, volume, w, n) for n in VOLUME_AVERAGES}
    first |= {
        "volume_change_1": _ratio(volume, F.lag("volume").over(w)) - 1,
        "__volume_std": full(F.stddev_samp, volume, w, 48),
        LABEL: _ratio(F.lead("close", horizon).over(w), close) - 1,
    }
    second = {f"price_ma_ratio_{n}": _ratio("close", f"ma_{n}") - 1 for n in AVERAGES}
    second |= {f"volatility_{n}": full(F.stddev_samp, F.col("return_1"), w, n) for n in AVERAGES}
    second |= {f"volume_ratio_{n}": _ratio("volume", f"volume_ma_{n}") for n in VOLUME_AVERAGES}
    second |= {
        "volume_zscore_48": _ratio(volume - F.col("volume_ma_48"), "__volume_std"),
        "candle_return": _ratio(close - opened, opened),
        "high_low_range": _ratio(F.col("high") - F.col("low"), opened),
        "upper_shadow": _ratio(F.col("high") - F.greatest("open", "close"), opened),
        "lower_shadow": _ratio(F.least("open", "close") - F.col("low"), opened),
        "hour": F.hour("ts"),
        "day_of_week": F.weekday("ts"),
    }
    return bars.withColumns(first).withColumns(second).drop("__volume_std")


def features_of(bars: DataFrame, bar_seconds: int = 300, horizon: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Segments, features and label of all bars: windows over chunks of a series, which borrow the rows that they look at."""
    rows = _segments(bars, bar_seconds, REACH, horizon, chunk)
    return owned(with_features(rows, horizon, in_chunk(None, "segment_id"))).drop("rn")


def feature_table(bars: DataFrame, bar_seconds: int = 300, horizon: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Segments, features and label, without the rows that miss any value."""
    return features_of(bars, bar_seconds, horizon, chunk).na.drop("any")
