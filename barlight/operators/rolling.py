"""Rolling statistics without a built-in sliding form, over chunks of a series with a halo."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.stats import KEY
from barlight.operators.ordered import haloed, ordered_index
from barlight.session import ship


def in_chunks(df: DataFrame, window: int, fn: Callable[[pd.DataFrame], pd.DataFrame], columns: dict[str, str], chunk: int | None = None) -> DataFrame:
    """df with new columns that fn computes from the rows of a series in time order.

    A series is cut into chunks of at least `window` rows; the last `window` rows of a chunk are
    also given to the next, where they are dropped after use. fn sees a chunk with its halo. Rows
    are numbered by `rn` where df has it, else without a task per series, and keep that number.
    """
    ship(df.sparkSession)
    size = max(window, chunk or 4 * window)
    numbered = df if "rn" in df.columns else ordered_index(df, ["ts"])
    spread = haloed(numbered, window, 0, size)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema] + [f"`{c}` {t}" for c, t in columns.items()]
    )
    names = [*numbered.columns, *columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.sort_values("rn"))
        return out.loc[out["__own"], names]

    return spread.groupBy(KEY, "__chunk").applyInPandas(run, schema)


def past_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], window: int, least: int) -> DataFrame:
    """Quantiles (linear) of the previous `window` values, the row itself left out; NULL below `least`."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        rolling = pdf[value].shift(1).rolling(window, min_periods=least)
        return pdf.assign(**{c: rolling.quantile(q) for c, q in quantiles.items()})

    return in_chunks(df, window, fn, dict.fromkeys(quantiles, "double"))


def past_quantiles_builtin(df: DataFrame, value: str, quantiles: dict[str, float], window: int, least: int) -> DataFrame:
    """The same with Spark's exact percentile over the frame: for short windows, and as a check."""
    frame = Window.partitionBy(KEY).orderBy("ts").rowsBetween(-window, -1)
    enough = F.count(value).over(frame) >= least
    return df.withColumns({c: F.when(enough, F.percentile(value, q).over(frame)) for c, q in quantiles.items()})


def worst_drawdowns(equity: np.ndarray, window: int, least: int = 2) -> np.ndarray:
    """Worst fall below the running peak inside each window of the last `window` values.

    Runs of 2^k rows are summed up as (peak, low, worst fall); two neighbours join in one step,
    and a window is put together from the runs of its binary digits: n log(window) work.
    """
    n = len(equity)
    peak, low, worst = equity.copy(), equity.copy(), np.zeros(n)

    def joined(a: tuple, b: tuple) -> tuple:
        with np.errstate(invalid="ignore", divide="ignore"):
            across = np.where(np.isfinite(a[0]), b[1] / a[0] - 1, 0.0)
        return np.fmax(a[0], b[0]), np.fmin(a[1], b[1]), np.fmin(np.fmin(a[2], b[2]), across)

    def moved(x: tuple, by: int) -> tuple:
        """The run that ends `by` rows earlier, nothing before the first row."""
        if by == 0:
            return x
        none = (-np.inf, np.inf, 0.0)
        return tuple(np.concatenate([np.full(min(by, n), f), v[: max(n - by, 0)]]) for v, f in zip(x, none, strict=True))

    run, size, out, held = (peak, low, worst), 1, None, 0
    while size <= window:
        if window & size:
            out = run if out is None else joined(moved(run, held), out)
            held += size
        run = joined(moved(run, size), run)
        size *= 2
    result = np.array(out[2])
    result[: least - 1] = np.nan
    return result
