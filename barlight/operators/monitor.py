"""Rolling signal health: metrics, warning codes, a status with staged recovery, and reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.config import Config
from barlight.functions.stats import KEY, month
from barlight.operators.ordered import CHUNK, haloed, in_chunk, ordered_index, running, scanned, with_previous
from barlight.operators.rolling import in_chunks, worst_drawdowns

#: Limits of the codes, in order (code, measure, warning, critical); ratio has two.
LIMITS = (
    ("NEGATIVE_EDGE", "rolling_avg_gross_bps", 0.0, -1.0),
    ("LOW_HIT_RATE", "rolling_hit_rate", 0.48, 0.45),
    ("CURRENT_DRAWDOWN", "current_drawdown_30d", -0.03, -0.05),
    ("MAX_DRAWDOWN", "rolling_max_drawdown_30d", -0.05, -0.08),
)
RATIO_LIMITS = {"warning": (0.5, 2.0), "critical": (0.25, 3.0)}
RECOVERY = {"rolling_avg_gross_bps": 1.0, "rolling_hit_rate": 0.52, "current_drawdown_30d": -0.015}
SAMPLES = ((10, "VERY_LOW_SAMPLE"), (20, "LOW_SAMPLE"))


ROLLING = (
    "rolling_signal_count",
    "rolling_signal_frequency",
    "rolling_avg_gross_bps",
    "rolling_hit_rate",
    "rolling_30d_return",
    "current_drawdown_30d",
    "rolling_max_drawdown_30d",
)


def rolling_metrics(rows: DataFrame, config: Config) -> DataFrame:
    """rows (of a position backtest) with the rolling columns, equity and the frequency baseline.

    What runs from the first row on is summed up over chunks of a series; what looks at the last
    `monitor_window` rows is made in one pass over chunks that also see so many rows before.
    """
    window = config.monitor_window
    active = F.col("position") != 0
    rows = rows.withColumns(
        {"is_active": active.cast("int"), "is_win": F.when(active, (F.col("gross_return") > 0).cast("double"))}
    )
    rows = rows if "rn" in rows.columns else ordered_index(rows, ["ts"])
    both = {"equity": (F.product, 1 + F.col("net_return")), "__active": (F.sum, F.col("is_active"))}
    rows = running(rows, both, {"equity": lambda a, b: a * b, "__active": lambda a, b: a + b})
    before = F.try_divide(F.col("__active") - F.col("is_active"), F.col("rn") - 1)
    rows = rows.withColumn("historical_signal_frequency", before).drop("__active")

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        def over(values: pd.Series) -> pd.core.window.Rolling:
            return values.rolling(window, min_periods=1)

        net, equity, gross = (pdf[c].astype(float) for c in ("net_return", "equity", "gross_return"))
        # a total loss has no logarithm: the window's return is then -1
        lost = over((net <= -1).astype(float)).max() > 0
        growth = np.expm1(over(np.log1p(net.where(net > -1, 0.0))).sum())
        growth = growth.where(over((net != 0).astype(float)).sum() > 0, 0.0)  # sliding sums leave a rest
        peak = over(equity).max()
        found = {
            "rolling_signal_count": over(pdf["is_active"]).sum(),
            "rolling_signal_frequency": over(pdf["is_active"]).mean(),
            "rolling_avg_gross_bps": over(gross.where(pdf["position"] != 0)).mean() * 10_000,
            "rolling_hit_rate": over(pdf["is_win"].astype(float)).mean(),
            "rolling_30d_return": growth.where(~lost, -1.0),
            "current_drawdown_30d": (equity / peak.where(peak != 0)) - 1,
            "rolling_max_drawdown_30d": np.where(pdf["rn"] >= 2, worst_drawdowns(equity.to_numpy(), window), np.nan),
        }
        return pdf.assign(**found)

    out = in_chunks(rows, window, fn, dict.fromkeys(ROLLING, "double"))
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ROLLING})
    return out.withColumn("signal_frequency_ratio", F.try_divide("rolling_signal_frequency", "historical_signal_frequency"))


def reasons(kind: str) -> Column:
    """The codes of a kind (warning or critical) that hold, in order."""
    at = 2 if kind == "warning" else 3
    low, high = RATIO_LIMITS[kind]
    ratio = F.col("signal_frequency_ratio")
    codes = [F.when(F.col(x[1]) < x[at], F.lit(x[0])) for x in LIMITS]
    codes.append(F.when((ratio < low) | (ratio > high), F.lit("SIGNAL_FREQUENCY")))
    return F.array_compact(F.array(*codes))


def sample_status(count: Column) -> Column:
    out = F.when(count.isNull(), "NO_DATA")
    for limit, name in SAMPLES:
        out = out.when(count < limit, name)
    return out.otherwise("SUFFICIENT")


def recovered() -> Column:
    tests = [F.col(c) > limit for c, limit in RECOVERY.items()]
    return F.coalesce(tests[0] & tests[1] & tests[2], F.lit(False))


def staged(rows: DataFrame, raw: str = "raw_performance_status", ok: str = "recovery", chunk: int = CHUNK) -> DataFrame:
    """rows with performance_status: raw alerts hold at once, recovery goes by stages.

    A run starts at each raw alert. After a WARNING, the first healthy row that passes the
    recovery test ends the alert; after a CRITICAL one the first healthy row is still WARNING
    and the test counts from the second on. Rows before any alert are healthy.

    So a row is a map of three states: an alert sends all to its own, a healthy row a critical state to
    WARNING, and one in WARNING to HEALTHY if it passes. Inside a chunk of a series windows compose these maps: after its
    first alert a row's state is known, before it there is one for each state that the chunk begins in.
    The chunks' maps are gone through in order, and each row takes what belongs to its chunk's first state.
    """
    sick, passed = F.col(raw) != "HEALTHY", F.col(ok)
    numbered = rows if "rn" in rows.columns else ordered_index(rows, ["ts"])
    cut = haloed(numbered, 0, 0, chunk).drop("__own")
    cut = cut.withColumn("__run", F.sum(sick.cast("int")).over(in_chunk()))
    run = in_chunk(None, "__run")
    cut = cut.withColumns({"__after": F.row_number().over(run) - 1, "__anchor": F.first(raw).over(run)})
    wait = F.when(F.col("__run") == 0, 0).when(F.col("__anchor") == "CRITICAL", 2).otherwise(1)
    heals = ~sick & passed & (F.col("__after") >= wait)
    late = heals & (F.col("__after") >= 1)  # what counts when the chunk begins after a critical row
    cut = cut.withColumns({"__healed": F.max(heals).over(run), "__late": F.max(late).over(run)})
    known = F.when(sick, F.col(raw)).when(F.col("__run") > 0, F.when(F.col("__healed"), "HEALTHY").otherwise("WARNING"))
    healed = {"H": F.lit(True), "W": F.col("__healed"), "C": F.col("__late")}
    maps = {k: F.coalesce(known, F.when(h, "HEALTHY").otherwise("WARNING")) for k, h in healed.items()}
    cut = cut.withColumns({f"__{k}": m for k, m in maps.items()})
    totals = cut.groupBy(KEY, "__chunk").agg(*[F.max_by(F.substring(f"__{k}", 1, 1), "rn").alias(k) for k in maps])
    begun = scanned(totals, "HWC", {k: F.col(k) for k in maps}, "H")
    state = F.col("__H")
    for k in ("W", "C"):
        state = F.when(F.col("__state") == k, F.col(f"__{k}")).otherwise(state)
    made = ["__chunk", "__run", "__after", "__anchor", "__healed", "__late", "__state", *[f"__{k}" for k in maps]]
    return cut.join(begun, [KEY, "__chunk"]).withColumn("performance_status", state).drop(*made)


def monitored(rows: DataFrame, config: Config) -> DataFrame:
    """All monitor columns of a position backtest."""
    return with_status(rolling_metrics(rows, config))


def with_status(rows: DataFrame) -> DataFrame:
    """rows with reasons, raw and staged status, alert reason and overall status."""
    out = rows.withColumns(
        {
            "sample_status": sample_status(F.col("rolling_signal_count")),
            "warnings": reasons("warning"),
            "criticals": reasons("critical"),
            "recovery": recovered(),
        }
    )
    raw = F.when(F.size("criticals") >= 2, "CRITICAL").when(F.size("warnings") >= 1, "WARNING").otherwise("HEALTHY")
    out = staged(out.withColumn("raw_performance_status", raw))
    state, sample = F.col("performance_status"), F.col("sample_status")
    # the codes of the state that holds: critical ones only in state CRITICAL
    codes = F.when((state == "CRITICAL") & (F.size("criticals") > 0), F.col("criticals")).otherwise(F.col("warnings"))
    reason = (
        F.when(state == "HEALTHY", "NONE").when(F.size(codes) > 0, F.concat_ws("|", codes)).otherwise("RECOVERY_HOLD")
    )
    overall = (
        F.when(sample == "NO_DATA", sample)
        .when((sample == "VERY_LOW_SAMPLE") & (state == "HEALTHY"), sample)
        .when(sample == "VERY_LOW_SAMPLE", F.concat(state, F.lit("_VERY_LOW_SAMPLE")))
        .when(sample == "LOW_SAMPLE", F.concat(state, F.lit("_LOW_CONFIDENCE")))
        .otherwise(state)
    )
    return out.withColumns({"alert_reason": reason, "overall_status": overall})


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(KEY, "overall_status").agg(F.count(F.lit(1)).alias("n_rows"))


def daily(rows: DataFrame) -> DataFrame:
    """The last row of each series and UTC day."""
    columns = [c for c in rows.columns if c != KEY]
    last = rows.groupBy(KEY, F.to_date("ts").alias("day")).agg(F.max_by(F.struct(*columns), "ts").alias("r"))
    return last.select(KEY, "day", "r.*")


#: What monthly and transition reports show of a row.
STATES = ("sample_status", "performance_status", "overall_status", "alert_reason")
MEASURES = (
    "rolling_signal_count",
    "rolling_avg_gross_bps",
    "rolling_hit_rate",
    "rolling_30d_return",
    "current_drawdown_30d",
    "rolling_max_drawdown_30d",
    "signal_frequency_ratio",
)


def monthly(rows: DataFrame) -> DataFrame:
    """States and measures on the last day of each month, with the shares of days in alert."""
    state = F.col("performance_status")
    return daily(rows).groupBy(KEY, month(F.col("ts")).alias("month")).agg(
        F.count(F.lit(1)).alias("days"),
        *[F.max_by(c, "ts").alias(c) for c in (*STATES, *MEASURES, "equity")],
        F.avg(state.isin("WARNING", "CRITICAL").cast("double")).alias("alert_share"),
        F.avg((state == "CRITICAL").cast("double")).alias("critical_share"),
    )


def reason_counts(rows: DataFrame) -> DataFrame:
    """How often each code is in the alert reasons; NONE rows have none."""
    told = rows.filter("alert_reason <> 'NONE'")
    return told.select(KEY, F.explode(F.split("alert_reason", "[|]")).alias("reason")).groupBy(KEY, "reason").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def transitions(rows: DataFrame, last: int | None = 40) -> DataFrame:
    """Rows whose overall status differs from the one before, the first row too; the last few."""
    shown = rows.select(KEY, "ts", "raw_performance_status", *STATES, *MEASURES, *[c for c in ("rn",) if c in rows.columns])
    found = with_previous(shown, {"previous_status": "overall_status"}).filter(~F.col("overall_status").eqNullSafe(F.col("previous_status")))
    found = found.select(KEY, "ts", "previous_status", "raw_performance_status", *STATES, *MEASURES)
    if last is None:
        return found
    # the last few of each range of rows, then of these
    found = found.withColumn("__part", F.spark_partition_id())
    for by in ([KEY, "__part"], [KEY]):
        n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts")))
        found = found.withColumn("__n", n).filter(F.col("__n") <= last).drop("__n")
    return found.drop("__part")
