"""Operators on small hand-made frames: full windows, segments, ranks, states, leakage."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barlight.config import Config
from barlight.functions.stats import KEY
from barlight.operators import backtest, drift, features, metrics, models, monitor, oos, ordered, rolling, targets, validate
from barlight.plans import sql
from barlight.sources import bars as sources

START = datetime(2024, 1, 1)


def bars(spark, closes, minutes=5, series="a", volumes=None, at=None):
    rows = [
        (series, (at or START) + timedelta(minutes=minutes * i), c, c + 1.0, c - 1.0, c, float(v))
        for i, (c, v) in enumerate(zip(closes, volumes or [10.0] * len(closes), strict=True))
    ]
    return spark.createDataFrame(rows, sources.BARS)


def predictions(spark, p, y=None, series="a"):
    rows = [(series, START + timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(p, y or [0.01] * len(p), strict=True))]
    return spark.createDataFrame(rows, f"{KEY} string, ts timestamp, prediction double, future_return double")


def test_segments_and_usable_rows(spark):
    rng = np.random.default_rng(1)
    prices = (100 + rng.normal(0, 1, 80).cumsum()).tolist()
    volumes = rng.integers(1, 50, 80).tolist()
    first = bars(spark, prices[:60], volumes=volumes[:60])
    second = bars(spark, prices[60:], volumes=volumes[60:], at=START + timedelta(minutes=5 * 59 + 20))
    table = first.unionByName(second)
    gap = validate.gaps(table, 300).collect()
    assert [(g.gap_seconds, g.missing_bars) for g in gap] == [(1200, 3)]
    found = features.feature_table(table).toPandas()
    assert len(found) == 60 - 51 and set(found.segment_id) == {1}
    changed = features.feature_table(first.unionByName(second.withColumn("close", F.col("close") * 2))).toPandas()
    pd.testing.assert_frame_equal(found.sort_values("ts"), changed.sort_values("ts"))


def test_features_against_pandas(spark):
    rng = np.random.default_rng(2)
    close = pd.Series(100 + rng.normal(0, 1, 120).cumsum())
    volume = pd.Series(rng.integers(1, 50, 120).astype(float))
    got = features.with_features(features.segmented(bars(spark, close.tolist(), volumes=volume.tolist()), 300)).orderBy("ts").toPandas()
    r = close / close.shift(1) - 1
    for name, want in {
        "return_6": close / close.shift(6) - 1,
        "price_ma_ratio_48": close / close.rolling(48).mean() - 1,
        "volatility_12": r.rolling(12).std(),
        "volume_zscore_48": (volume - volume.rolling(48).mean()) / volume.rolling(48).std(),
        "future_return": close.shift(-3) / close - 1,
    }.items():
        np.testing.assert_allclose(got[name].astype(float), want, atol=1e-10, err_msg=name)
    assert got.day_of_week[0] == 0


def test_zero_volume_gives_null_not_an_error(spark):
    table = features.with_features(features.segmented(bars(spark, [1.0] * 60, volumes=[0.0] * 30 + [5.0] * 30), 300))
    row = table.orderBy("ts").collect()
    assert row[1].volume_change_1 is None and row[40].volume_change_1 == 0.0 and row[20].volume_ratio_12 is None


def test_quality_counts(spark):
    rows = [
        ("a", START, 1.0, 2.0, 0.5, 1.0, 1.0),
        ("a", START, 1.0, 2.0, 0.5, 1.0, 1.0),
        ("a", None, None, 2.0, 0.5, 1.0, 1.0),
        ("a", START + timedelta(minutes=5), 1.0, 0.9, 0.5, 1.0, -1.0),
        ("a", START + timedelta(minutes=10), 1.0, 2.0, 1.5, 1.0, 1.0),
        ("a", START + timedelta(minutes=15), 0.0, 2.0, -0.5, 1.0, None),
    ]
    r = validate.counts(spark.createDataFrame(rows, sources.BARS)).first()
    assert (r.missing_ts, r.missing_open, r.missing_volume, r.duplicate_ts) == (1, 1, 1, 1)
    assert (r.nonpositive_open, r.nonpositive_low, r.high_too_low, r.low_too_high, r.negative_volume) == (1, 1, 1, 1, 1)


@pytest.mark.parametrize("n", [1, 10, 11, 12, 20, 100])
def test_deciles_equal_quantile_bins(spark, n):
    frame = predictions(spark, np.arange(n) % 7)
    got = metrics.with_decile(frame, [KEY]).orderBy("prediction", "ts").toPandas()
    want = [0] if n == 1 else pd.qcut(np.arange(1, n + 1), 10, labels=False)
    assert got.bin.tolist() == list(want)


def test_constant_prediction_has_no_correlation(spark):
    r = metrics.scores(models.zero(predictions(spark, [1, 2, 3], [0.1, 0.2, 0.3])), [KEY]).first()
    assert r.pearson_ic is None and abs(r.mae - 0.2) < 1e-12
    assert metrics.rank_ic(predictions(spark, [1.0], [0.1]), [KEY]).first().spearman_ic is None


def test_rank_ic_with_ties(spark):
    p, y = [1, 1, 2, 3, 3, 5], [0.1, 0.3, 0.2, 0.5, 0.4, 0.4]
    r = metrics.rank_ic(predictions(spark, p, y), [KEY]).first()
    assert abs(r.spearman_ic - pd.Series(p).rank().corr(pd.Series(y).rank())) < 1e-12


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0.5, 1.5), min_size=1, max_size=60), st.integers(2, 20))
def test_rolling_drawdown_is_its_definition(values, window):
    equity = np.cumprod(values)
    got = rolling.worst_drawdowns(equity, window)
    for i in range(1, len(equity)):
        part = equity[max(0, i - window + 1) : i + 1]
        assert abs(got[i] - (part / np.maximum.accumulate(part) - 1).min()) < 1e-9


def test_thresholds_look_only_back(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=200)
    config = Config(threshold_window=40, min_history=10)
    frame = predictions(spark, p)
    q = {"low": 0.01, "high": 0.99}
    chunked = rolling.past_quantiles(frame, "prediction", q, 40, 10).orderBy("ts").toPandas()
    builtin = rolling.past_quantiles_builtin(frame, "prediction", q, 40, 10).orderBy("ts").toPandas()
    np.testing.assert_allclose(chunked.high, builtin.high.astype(float), atol=1e-12)
    assert chunked.high[:10].isna().all() and not np.isnan(chunked.high[10])
    p[100:] += 5
    later = backtest.with_thresholds(predictions(spark, p), config).orderBy("ts").toPandas()
    np.testing.assert_allclose(later.long_threshold[10:101].astype(float), chunked.high[10:101])


def test_long_wins_when_thresholds_meet(spark):
    row = predictions(spark, [1.0]).withColumns({"long_threshold": F.lit(1.0), "short_threshold": F.lit(1.0)})
    got = {r.side: r.signal for r in backtest.signals(row, Config()).collect()}
    assert got == {"long": 1, "short": -1, "long_short": 1}


def test_position_changes_and_holdings(spark):
    rows = predictions(spark, [0, 1, 1, 0, 1, 0]).withColumn("long_threshold", F.lit(1.0))
    held = backtest.positions(rows, Config())
    assert [r.position_change for r in held.orderBy("ts").collect()] == [0, 1, 0, -1, 1, -1]
    r = backtest.holding_runs(held, 15.0).first()
    assert (r.holdings, r.mean_length, r.median_length, r.max_length, r.mean_minutes) == (2, 1.5, 1.5, 2, 22.5)


def test_psi(spark):
    rng = np.random.default_rng(4)
    reference, current = rng.normal(size=500), np.concatenate([rng.normal(0.5, 1, 80), [99.0, -99.0]])
    rows = [("a", float(v), False) for v in reference] + [("a", float(v), True) for v in current]
    rows += [("t", 1.0, False)] * 5 + [("t", 2.0, True)]
    got = {r.k: r.psi for r in drift.psi(spark.createDataFrame(rows, "k string, value double, current boolean"), ["k"]).collect()}
    edges = np.unique(np.quantile(reference, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    r = np.maximum(np.histogram(reference, edges)[0] / len(reference), 1e-6)
    c = np.maximum(np.histogram(current, edges)[0] / len(current), 1e-6)
    assert abs(got["a"] - ((c - r) * np.log(c / r)).sum()) < 1e-9 and got["t"] is None


def sequential(raw, ok):
    state, out = "HEALTHY", []
    for r, good in zip(raw, ok, strict=True):
        if r != "HEALTHY":
            state = r
        elif state == "CRITICAL":
            state = "WARNING"
        elif state == "WARNING" and good:
            state = "HEALTHY"
        out.append(state)
    return out


def test_staged_status_equals_a_loop(spark):
    rng = np.random.default_rng(5)
    cases = [(["HEALTHY", "WARNING", "HEALTHY", "HEALTHY", "CRITICAL", "HEALTHY", "HEALTHY", "CRITICAL", "HEALTHY", "HEALTHY"], [0, 0, 0, 1, 0, 0, 1, 0, 1, 1])]
    for _ in range(150):
        n = int(rng.integers(1, 25))
        cases.append((rng.choice(["HEALTHY", "WARNING", "CRITICAL"], n, p=[0.7, 0.15, 0.15]).tolist(), rng.integers(0, 2, n).tolist()))
    rows = [(str(k), START + timedelta(days=i), r, bool(o)) for k, (raw, ok) in enumerate(cases) for i, (r, o) in enumerate(zip(raw, ok, strict=True))]
    frame = spark.createDataFrame(rows, f"{KEY} string, ts timestamp, raw_performance_status string, recovery boolean")
    got = monitor.staged(frame).toPandas().sort_values([KEY, "ts"])
    for k, (raw, ok) in enumerate(cases):
        assert got[got[KEY] == str(k)].performance_status.tolist() == sequential(raw, ok)


def test_position_goes_on_over_the_boundary(spark):
    config = Config(threshold_window=3, min_history=2, tail=0.5)
    rows = predictions(spark, [1, 2, 3, 4, 0, 0])
    cut = START + timedelta(days=4)
    test = rows.filter(F.col("ts") >= cut)
    got = oos.evaluated(sources.prediction_history(rows, str(cut)), test, rows, config).orderBy("ts").collect()
    assert [r.position_change for r in got] == [-1, 0] and got[0].transaction_cost == config.turnover_cost


def test_folds_need_rows_to_fit(spark):
    rows = predictions(spark, range(60)).withColumn("target", F.lit(0.0))
    with pytest.raises(Exception, match="empty fold"):
        targets.folds(rows, "2024-01-01", 900).collect()
    assert targets.folds(rows, "2024-02-01", 86_400, 10).count() == 1


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.1]
    y = x @ [1.0, -0.2, 3.0] + rng.normal(size=80)
    frame = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, target double")
    got = models.ridge(frame, frame, ["a", "b", "c"]).toPandas().prediction
    z = (x - x.mean(0)) / x.std(0)
    want = y.mean() + z @ np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_running_aggregates_pass_over_nulls_and_signs(spark):
    values = [0.5, None, -2.0, 3.0, None, -1.0, 4.0, 0.25, None, 2.0, -3.0]
    rows = [(k, i, v) for k in ("a", "b") for i, v in enumerate(values if k == "a" else [None, None, None, 2.0, 5.0])]
    numbered = ordered.ordered_index(spark.createDataFrame(rows, f"{KEY} string, i int, v double"), ["i"], 3)
    for chunk in (1, 2, 3, 100):
        got = ordered.running_sum(ordered.running_max(ordered.running_product(numbered, F.col("v"), "p", chunk), F.col("v"), "m", chunk), F.col("v"), "s", chunk)
        for k in ("a", "b"):
            found = got.filter(F.col(KEY) == k).orderBy("i").toPandas()
            v = pd.Series(found.v, dtype=float)
            seen = v.notna().cumsum() > 0
            np.testing.assert_allclose(found.p.astype(float), v.fillna(1).cumprod().where(seen))
            np.testing.assert_allclose(found.s.astype(float), v.fillna(0).cumsum().where(seen))
            np.testing.assert_allclose(found.m.astype(float), v.cummax().ffill())


def test_quantiles_and_ranks_without_a_task_per_group(spark):
    rng = np.random.default_rng(12)
    rows = [(k, float(v)) for k, n in (("a", 200), ("b", 7), ("c", 1)) for v in rng.integers(0, 25, n)] + [("b", None)]
    frame = spark.createDataFrame(rows, f"{KEY} string, v double").repartition(5)
    points = {"low": 0.005, "mid": 0.5, "high": 0.99}
    got = {r[KEY]: r for r in ordered.quantiles(frame, F.col("v"), [KEY], points).collect()}
    ranked = ordered.with_ranks(frame.filter("v is not null"), ["v"], [KEY]).toPandas()
    for k in ("a", "b", "c"):
        values = pd.Series([v for s, v in rows if s == k and v is not None])
        for name, q in points.items():
            assert abs(got[k][name] - values.quantile(q)) < 1e-12
        mine = ranked[ranked[KEY] == k]
        np.testing.assert_allclose(sorted(mine.v_rank), sorted(values.rank()))
        assert mine.groupby("v").v_rank.nunique().max() == 1


def test_expanding_quantiles_and_counts_by_blocks(spark):
    rng = np.random.default_rng(17)
    rows = [(k, int(p), float(v)) for k, n in (("a", 300), ("b", 9)) for p, v in zip(rng.integers(0, 6, n), rng.integers(0, 40, n), strict=True)] + [("a", 0, None)]
    frame = spark.createDataFrame(rows, f"{KEY} string, p int, v double").repartition(3)
    untils = spark.createDataFrame([(k, u) for k in ("a", "b") for u in range(8)], f"{KEY} string, until int")
    points = [0.0, 0.1, 0.5, 0.995, 1.0]
    bounds = [0.0, 3.5, 17.0, 30.0]
    for block in (1, 7, 1000, None):
        before = ordered.Expanding(frame, F.col("v"), [KEY], F.col("p"), untils, block)
        got = {(r[KEY], r.until): r for r in before.quantiles(points).collect()}
        wanted = untils.filter(f"{KEY} = 'a'").withColumn("bound", F.explode(F.array(*map(F.lit, bounds))))
        less = {(r.until, r.bound): r.less for r in before.below(wanted).collect()}
        for k in ("a", "b"):
            for u in range(8):
                values = np.array([v for s, p, v in rows if s == k and p < u and v is not None])
                assert ((k, u) in got) == bool(len(values))
                if len(values):
                    assert got[k, u].n == len(values)
                    np.testing.assert_allclose(got[k, u].q, np.quantile(values, points), atol=1e-12)
                if k == "a":
                    assert [less[u, b] for b in bounds] == [int((values < b).sum()) for b in bounds]


def test_monthly_psi_is_that_of_copied_rows(spark):
    rng = np.random.default_rng(18)
    n = 240
    rows = [("a", START + timedelta(days=i), float(rng.integers(0, 30)), float(rng.normal()), 1.0, None if i % 3 else 2.0) for i in range(n)]
    frame = spark.createDataFrame(rows, f"{KEY} string, ts timestamp, x double, y double, one double, few double")
    got = {r.month: r for r in drift.monthly_psi(frame, ("x", "y", "one", "few")).collect()}
    table = frame.toPandas()
    table["month"] = table.ts.dt.strftime("%Y-%m")
    assert sorted(got) == sorted(table.month.unique())[1:]
    copies = [(m, c, float(v), at == m) for m in got for c in ("x", "y") for at, v in zip(table.month, table[c], strict=True) if at <= m]
    want = drift.psi(spark.createDataFrame(copies, "month string, column string, value double, current boolean"), ["month", "column"])
    for r in want.collect():
        assert abs(got[r.month][f"{r.column}_psi"] - r.psi) < 1e-9
    assert all(r.one_psi is None and r.few_psi is None for r in got.values())


def test_missing_times_that_repeat_are_duplicates(spark):
    rows = [("a", t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in (START, START, None, None, None)] + [("b", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = {r[KEY]: r.duplicate_ts for r in validate.counts(spark.createDataFrame(rows, sources.BARS)).collect()}
    assert got == {"a": 3, "b": 0}


def test_position_summary_leaves_the_warm_up_out(spark):
    """Worked by hand: returns of the three rows with a threshold are 0.02 - 0.00005, -0.01 and 0 - 0.00005."""
    rows = predictions(spark, [5, 5, 2, 2, 0], [0.5, 0.5, 0.02, -0.01, 0.3])
    rows = rows.withColumn("long_threshold", F.when(F.col("ts") >= START + timedelta(days=2), 1.0))
    config = Config(bar_seconds=86_400)
    r = backtest.position_summary(backtest.positions(rows, config), config).first()
    net = np.array([0.02 - 5e-5, -0.01, -5e-5])
    assert (r.active_periods, r.entries, r.exits, r.turnover) == (2, 1, 1, 2)
    assert abs(r.sharpe - net.mean() / net.std(ddof=1) * np.sqrt(365 / 3)) < 1e-9
    assert abs(r.total_return - (np.prod(1 + net) - 1)) < 1e-12
    assert abs(r.max_drawdown - ((1 + net[1]) * (1 + net[2]) - 1)) < 1e-12


def test_periods_follow_the_thinned_rows():
    assert Config().periods_per_year == 35_040 and Config(bar_seconds=86_400).periods_per_year == 365 / 3


def test_alert_reason_and_overall_status_by_state(spark):
    """Worked by hand: the codes shown are those of the state that holds, and no state is lost at few samples."""
    cases = [  # count, edge, hit rate, drawdown now, worst drawdown, ratio, recent state; reason, overall
        ("a", 30.0, -2.0, 0.60, 0.0, 0.0, 1.0, "NEGATIVE_EDGE", "WARNING"),  # one critical code: a warning
        ("b", 30.0, -2.0, 0.46, 0.0, 0.0, 1.0, "NEGATIVE_EDGE|LOW_HIT_RATE", "WARNING"),  # both warnings are told
        ("c", 30.0, -2.0, 0.40, -0.04, 0.0, 1.0, "NEGATIVE_EDGE|LOW_HIT_RATE", "CRITICAL"),  # critical ones only
        ("d", 5.0, 2.0, 0.60, 0.0, 0.0, 1.0, "NONE", "VERY_LOW_SAMPLE"),
        ("e", 5.0, -0.5, 0.60, 0.0, 0.0, 1.0, "NEGATIVE_EDGE", "WARNING_VERY_LOW_SAMPLE"),
        ("f", 15.0, 2.0, 0.60, 0.0, 0.0, 1.0, "NONE", "HEALTHY_LOW_CONFIDENCE"),
        ("g", 15.0, -2.0, 0.40, 0.0, 0.0, 1.0, "NEGATIVE_EDGE|LOW_HIT_RATE", "CRITICAL_LOW_CONFIDENCE"),
        ("h", None, None, None, None, None, None, "NONE", "NO_DATA"),
    ]
    names = "rolling_signal_count rolling_avg_gross_bps rolling_hit_rate current_drawdown_30d rolling_max_drawdown_30d signal_frequency_ratio"
    schema = f"{KEY} string, ts timestamp, " + ", ".join(f"{c} double" for c in names.split())
    got = monitor.with_status(spark.createDataFrame([(c[0], START, *c[1:7]) for c in cases], schema)).collect()
    assert {r[KEY]: (r.alert_reason, r.overall_status) for r in got} == {c[0]: c[7:] for c in cases}


def test_worst_months_end_with_those_without_a_value(spark):
    rows = [("a", f"2024-0{i}", g, m) for i, (g, m) in enumerate([(2.0, None), (None, 0.3), (-1.0, 0.2)], 1)]
    got = drift.extreme_months(spark.createDataFrame(rows, f"{KEY} string, month string, gross_bps double, max_psi double")).collect()
    assert [r.month for r in sorted(got, key=lambda r: r["rank"]) if r.list == "worst"] == ["2024-03", "2024-01", "2024-02"]
    assert [r.month for r in sorted(got, key=lambda r: r["rank"]) if r.list == "drift"] == ["2024-02", "2024-03"]


def test_rolling_metrics_against_pandas(spark):
    rng = np.random.default_rng(14)
    n, config = 150, Config(monitor_window=12)
    position, change = rng.integers(0, 2, n), rng.normal(0, 0.02, n)
    rows = [(s, START + timedelta(days=i), int(position[i]), float(position[i] * change[i]), float(position[i] * change[i] - 1e-5)) for s in "ab" for i in range(n)]
    frame = spark.createDataFrame(rows, f"{KEY} string, ts timestamp, position int, gross_return double, net_return double")
    got = monitor.rolling_metrics(frame, config).filter(f"{KEY} = 'b'").orderBy("ts").toPandas()
    gross, net, active = pd.Series(position * change), pd.Series(position * change - 1e-5), pd.Series(position)
    equity = (1 + net).cumprod()
    for name, want in {
        "rolling_signal_count": active.rolling(12, min_periods=1).sum(),
        "rolling_avg_gross_bps": gross.where(active != 0).rolling(12, min_periods=1).mean() * 10_000,
        "rolling_hit_rate": (gross > 0).astype(float).where(active != 0).rolling(12, min_periods=1).mean(),
        "rolling_30d_return": np.expm1(np.log1p(net).rolling(12, min_periods=1).sum()),
        "equity": equity,
        "current_drawdown_30d": equity / equity.rolling(12, min_periods=1).max() - 1,
        "historical_signal_frequency": active.shift(1).expanding(1).mean(),
    }.items():
        np.testing.assert_allclose(got[name].astype(float), want, atol=1e-10, err_msg=name)


def test_comparison_has_a_model_for_each_loss(spark):
    rows = modelled(spark, 80).withColumn("future_return", F.col("target") * 2)
    got = models.comparison(rows, F.col("ts") < "2024-02-20", F.col("ts") >= "2024-02-20", {"l1": "absolute", "l2": "squared", "huber": "huber"}, 3, patience=1).toPandas()
    assert got.columns.tolist() == [KEY, "ts", "target", "future_return", "model", "prediction"] and len(got) == 3 * 30
    wide = got.pivot(index="ts", columns="model", values="prediction")
    assert all((wide[a] != wide[b]).any() for a, b in (("l1", "l2"), ("l2", "huber"), ("l1", "huber")))


def test_best_model_from_stored_predictions_equals_sql(spark, tmp_path):
    rng = np.random.default_rng(16)
    y = rng.normal(size=90)
    rows = [("a", START + timedelta(days=i), float(y[i]), float(y[i] * w + rng.normal()), m) for m, w in (("x", 0.2), ("y", 2.0), ("z", 0.0)) for i in range(90)]
    spark.createDataFrame(rows, f"{KEY} string, ts timestamp, future_return double, prediction double, model string").write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.sql(f"create view pred as select * from '{tmp_path}/p/*.parquet'")
    lim = "lim AS (SELECT model, quantile_cont(abs(future_return), 0.99) AS lim FROM pred GROUP BY 1), trm AS (SELECT pred.* FROM pred JOIN lim USING (model) WHERE abs(future_return) <= lim),"
    want = con.sql(f"WITH {lim}{sql.ic('trm', 'model', 'o')} SELECT model, spearman_ic, pearson_ic FROM o ORDER BY spearman_ic DESC").fetchall()
    got = {r.model: r for r in models.model_scores(stored).collect()}
    for model, spearman, pearson in want:
        assert abs(got[model].trimmed_spearman_ic - spearman) < 1e-12 and abs(got[model].trimmed_pearson_ic - pearson) < 1e-12
    best = models.best_model(stored)
    assert {r.model for r in best.collect()} == {want[0][0]} == {"y"} and best.count() == 90
    assert set(models.target_scores(stored).columns) >= {"decile_spread", "long_bps", "ic_mean", "remove_5"}


def test_trained_predictions_go_on_to_the_backtest(spark):
    """Walk-forward predictions joined to their labels, thinned, and backtested: every stage keeps its rows."""
    rows = modelled(spark).withColumn("future_return", F.col("target") / 1000)
    found = models.walkforward(rows, targets.months_from(rows, "2024-02-01"), 86_400, 2, 10, patience=1)
    both = found.join(rows.select(KEY, "ts", "future_return"), [KEY, "ts"])
    config = Config(bar_seconds=86_400, horizon=1, threshold_window=30, min_history=5, tail=0.2)
    held = backtest.positions(backtest.with_thresholds(targets.thinned(both, config.horizon_seconds), config), config)
    assert held.count() == found.count() == 89
    r = backtest.position_summary(held, config).first()
    assert r.active_periods > 0 and r.entries >= r.exits


def test_fold_report_has_the_rows_of_the_fold_table(spark):
    rows = modelled(spark)
    table = targets.folds(rows, "2024-01-01", 86_400, 10, skip_empty=True)
    found = models.walkforward(rows, targets.months_from(rows, "2024-01-01"), 86_400, 2, 10, skip_empty=True, patience=1)
    report = models.fold_report(table, found).toPandas()
    assert sorted(report.month) == sorted(table.toPandas().month) and report.best_iteration.between(1, 2).all()


def test_ordered_index_and_running_product(spark):
    frame = predictions(spark, np.linspace(0.9, 1.1, 50))
    numbered = ordered.ordered_index(frame, ["ts"], 5)
    got = ordered.running_product(numbered, F.col("prediction"), "total", 7).orderBy("ts").toPandas()
    assert got.rn.tolist() == list(range(1, 51))
    np.testing.assert_allclose(got.total, np.cumprod(np.linspace(0.9, 1.1, 50)))


def test_clean_and_round_trip(spark, tmp_path):
    table = bars(spark, [1.0, 2.0, 3.0])
    twice = table.unionByName(table.withColumn("open", F.col("open") + 1))
    clean = sources.clean_bars(twice)
    assert clean.filter("open = close").count() == 3
    for fmt in ("parquet", "csv"):
        sources.write_stage(clean, str(tmp_path / fmt), fmt=fmt)
        assert sources.read_bars(spark, str(tmp_path / fmt), fmt).select("ts", "close").exceptAll(clean.select("ts", "close")).isEmpty()


def test_walkforward_takes_every_month_and_real_tree_limits(spark, monkeypatch):
    from barlight.plans import queries

    taken = {}
    monkeypatch.setattr(models, "walkforward", lambda rows, months, horizon, trees, **k: taken.update(months=months, trees=trees))
    queries._walkforward(spark, "/root/testdata/sf0.01")
    folds = queries.QUERIES["fold_table"](spark, "/root/testdata/sf0.01").toPandas()
    assert taken["months"] == sorted(set(folds.month)) and len(taken["months"]) > 2 and taken["trees"] == 50


def modelled(spark, n=120):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, len(features.FEATURES)))
    rows = [("a", START + timedelta(days=i), *map(float, r), float(r[0] + (1000.0 if i in (5, n - 50) else 0.0))) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"{KEY} string, ts timestamp, " + ", ".join(f"`{c}` double" for c in features.FEATURES) + ", target double")


def test_walkforward_predicts_each_month_once(spark):
    rows = modelled(spark)
    with pytest.raises(ValueError, match="empty fold 2024-01"):
        models.walkforward(rows, targets.months_from(rows, "2024-01-01"), 86_400, 2, 10)
    got = models.walkforward(rows, targets.months_from(rows, "2024-01-01"), 86_400, 2, 10, skip_empty=True).toPandas()
    assert got.ts.is_unique and got.prediction_month.value_counts().to_dict() == {"2024-02": 29, "2024-03": 31, "2024-04": 29}


def test_walkforward_clips_targets_by_training_rows_of_the_fold(spark, monkeypatch):
    seen, grow = [], models.grow

    def watched(rows, jobs, patience, step):
        for at, job in jobs.items():
            seen.append([rows.filter(f).orderBy("ts").toPandas()[job.target] for f in (job.fit, job.valid) if f is not None])
        return grow(rows, jobs, patience, step)

    monkeypatch.setattr(models, "grow", watched)
    rows = modelled(spark)
    models.walkforward(rows, ["2024-04"], 86_400, 2, 30)
    (fit, valid), (refit,) = seen
    raw = rows.orderBy("ts").toPandas().target
    ends = {"fit": 60, "refit": 90}  # 2024-03-02 and 2024-04-01, each less a day
    bounds = {name: raw[:end].quantile([0.005, 0.995]).to_numpy() for name, end in ends.items()}
    np.testing.assert_allclose(fit, raw[:60].clip(*bounds["fit"]))
    np.testing.assert_allclose(valid, raw[61:90].clip(*bounds["fit"]))
    np.testing.assert_allclose(refit, raw[:90].clip(*bounds["refit"]))
    assert bounds["refit"][1] < raw[:90].max()


def test_clipped_keeps_null_targets(spark):
    rows = predictions(spark, [1.0, 2.0, 3.0, 9.0]).withColumn("target", F.when(F.col("prediction") < 9, F.col("prediction")))
    got = targets.clipped(rows, F.lit(True), (0.05, 0.95), [KEY]).orderBy("ts").toPandas().target
    np.testing.assert_allclose(got[:3], [1.1, 2.0, 2.9])
    assert np.isnan(got[3])


def test_tree_queries_have_limits_above_the_patience(spark, monkeypatch):
    from barlight.plans import queries

    taken = []

    def watched(rows, jobs, keep, patience=50, step=0.03, trees=None):
        taken.extend((job.trees, job.loss, patience, step) for job in jobs.values())
        return rows.select(*keep, *[F.lit(0.0).alias(n) for n in jobs]), {}

    monkeypatch.setattr(models, "boosted", watched)
    queries._compared(spark, "/root/testdata/sf0.01")
    queries._target_variants(spark, "/root/testdata/sf0.01")
    assert taken == [(100, x, 5, 0.3) for x in ("absolute", "squared", "huber")] + [(30, "absolute", 5, 0.3)] * 3
