"""Work on series of any length: chunks with halos, automata over chunks, counted quantiles."""

import re
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_market import START, bars, predictions, sequential

from barlight.functions.stats import KEY
from barlight.operators import backtest, drift, features, monitor, ordered, validate
from barlight.sources import bars as sources


def whole_series_windows(df):
    """Window definitions that are partitioned by the series alone and go through its rows."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return re.findall(r"windowspecdefinition\(series_id#\d+, (?:ts|rn|run)#\d+", plan)


@pytest.mark.parametrize("chunk", [1, 3, 4, 100])
def test_staged_status_equals_a_loop_over_chunks(spark, chunk):
    rng = np.random.default_rng(chunk)
    cases = []
    for k in range(40):
        n = int(rng.integers(1, 40))
        raw = rng.choice(["HEALTHY", "WARNING", "CRITICAL"], n, p=[0.8, 0.1, 0.1] if k % 3 else [1, 0, 0]).tolist()
        cases.append((raw, rng.integers(0, 2, n).tolist()))
    rows = [(str(k), START + timedelta(days=i), r, bool(o)) for k, (raw, ok) in enumerate(cases) for i, (r, o) in enumerate(zip(raw, ok, strict=True))]
    found = monitor.staged(spark.createDataFrame(rows, f"{KEY} string, ts timestamp, raw_performance_status string, recovery boolean"), chunk=chunk)
    assert not whole_series_windows(found) and "__run" not in found.columns
    got = found.toPandas().sort_values([KEY, "ts"])
    for k, (raw, ok) in enumerate(cases):
        assert got[got[KEY] == str(k)].performance_status.tolist() == sequential(raw, ok)


@pytest.mark.parametrize("chunk", [60, 101])
def test_features_by_chunks_are_those_of_the_whole_series(spark, chunk):
    rng = np.random.default_rng(3)
    table = bars(spark, np.exp(np.cumsum(rng.normal(0, 0.01, 400))).tolist(), volumes=rng.integers(1, 99, 400).astype(float).tolist())
    table = table.filter(~F.minute("ts").isin(35) | (F.hour("ts") % 3 > 0))  # gaps now and then
    whole = features.with_features(features.segmented(table, 300)).toPandas().sort_values("ts").reset_index(drop=True)
    parts = features.features_of(table, 300, chunk=chunk)
    assert not whole_series_windows(parts) and "Python" not in parts._jdf.queryExecution().executedPlan().toString()
    got = parts.toPandas().sort_values("ts").reset_index(drop=True)
    assert whole.segment_id.nunique() > 5 and got.columns.tolist() == whole.columns.tolist()
    for c in whole.columns:
        if whole[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], whole[c], rtol=1e-8, atol=1e-12, err_msg=c)
        else:
            assert (got[c] == whole[c]).all(), c
    gaps = [validate.gaps(table, 300, n) for n in (7, 1_000)]
    assert gaps[0].count() > 4 and gaps[0].exceptAll(gaps[1]).isEmpty() and not whole_series_windows(gaps[0])


def test_positions_and_holdings_over_chunks(spark):
    rng = np.random.default_rng(4)
    held = np.repeat(rng.integers(0, 2, 60), rng.integers(1, 12, 60))
    rows = predictions(spark, held).withColumnsRenamed({"prediction": "position"})
    r = backtest.holding_runs(rows, 15.0, 3).first()
    runs = [len(x) for x in "".join(map(str, held)).split("0") if x]
    assert (r.holdings, r.max_length, r.median_length) == (len(runs), max(runs), np.median(runs)) and r.mean_length == pytest.approx(np.mean(runs))


@pytest.fixture
def ranges(monkeypatch):
    """Numbers of rows of the ranges that groups are dealt to."""
    sizes = []

    def watched(df, name, **options):
        out = written(df, name, **options)
        if name == "ranges":
            sizes.append([r["count"] for r in out.groupBy("__part").count().collect()])
        return out

    written = ordered.written
    monkeypatch.setattr(ordered, "written", watched)
    return sizes


def test_quantiles_of_tied_values_deal_counts(spark, ranges):
    values = np.concatenate([np.zeros(9_000), np.random.default_rng(6).normal(size=1_000)])
    frame = spark.createDataFrame([("a", float(v)) for v in values], f"{KEY} string, v double")
    points = {"a": 0.01, "b": 0.03, "c": 0.5, "d": 0.955, "e": 0.999, "f": 1.0}
    got = ordered.quantiles(frame, F.col("v"), [KEY], points).first()
    np.testing.assert_allclose([got[n] for n in points], np.quantile(values, list(points.values())), atol=1e-12)
    assert sum(ranges[0]) == 1_001 and max(ranges[0]) <= 2 * np.mean(ranges[0])


def test_earlier_periods_of_tied_values(spark, ranges):
    rng = np.random.default_rng(7)
    v = np.where(rng.random(3_000) < 0.9, 0.0, np.round(rng.normal(size=3_000), 2))
    p = rng.integers(0, 6, 3_000)
    rows = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(p, v, strict=True)], f"{KEY} string, p int, v double")
    untils = spark.createDataFrame([("a", i) for i in range(1, 7)], f"{KEY} string, until int")
    found = ordered.Expanding(rows, F.col("v"), [KEY], F.col("p"), untils, block=16)
    q = [0.005, 0.04, 0.5, 0.96, 1.0]
    for r in found.quantiles(q).collect():
        np.testing.assert_allclose(r.q, np.quantile(v[p < r.until], q), atol=1e-12)
        assert r.n == (p < r.until).sum()
    bounds = untils.crossJoin(spark.createDataFrame([(-0.5,), (0.0,), (0.01,), (1.0,)], "bound double"))
    less = {(r.until, r.bound): r.less for r in found.below(bounds).collect()}
    assert less == {(u, b): (v[p < u] < b).sum() for u in range(1, 7) for b in (-0.5, 0.0, 0.01, 1.0)}
    assert sum(ranges[0]) < 1_200


def test_monthly_quantiles_have_no_percentile_of_a_group(spark):
    rng = np.random.default_rng(9)
    rows = predictions(spark, np.round(rng.normal(size=100), 1)).withColumns({"position": F.lit(0), "gross_return": F.lit(0.0), "net_return": F.lit(0.0)})
    found = drift.monthly_summary(rows)
    assert "percentile" not in found._jdf.queryExecution().analyzed().toString()
    got, held = found.toPandas().set_index("month"), rows.toPandas()
    for month, part in held.groupby(held.ts.dt.strftime("%Y-%m")):
        np.testing.assert_allclose(got.loc[month, ["prediction_p01", "prediction_p99"]].astype(float), part.prediction.quantile([0.01, 0.99]))


def test_a_month_is_written_anew_and_others_are_neither_touched_nor_read(spark, tmp_path):
    path, rows = str(tmp_path / "stage"), predictions(spark, range(90))
    sources.write_monthly(rows, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "stage").glob("month=*/*.parquet")}
    sources.write_monthly(rows.filter("month(ts) = 2").withColumn("prediction", F.col("prediction") + 100), path)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "stage").glob("month=*/*.parquet")}
    kept = {p for p in before if "2024-02" not in str(p)}
    assert kept and kept == {p for p in after if "2024-02" not in str(p)} and all(before[p] == after[p] for p in kept)
    part = sources.read_monthly(spark, path, "2024-02-10", "2024-03-02")
    assert sorted(r.prediction for r in part.collect()) == [60.0, *(float(i + 100) for i in range(40, 60))]
    assert len(part.inputFiles()) == 3 and "PartitionFilters: [isnotnull(month" in part._jdf.queryExecution().executedPlan().toString()
    assert sources.read_monthly(spark, path).count() == 90
