"""DuckDB SQL of the registered queries, put together from common table expressions."""

from __future__ import annotations

DAY = "strftime(ts, '%Y-%m-%d')"
TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
#: Three daily bars; backtests take one row a horizon, so many a year.
HORIZON = 259_200
PERIODS = "(365 * 86400 / 259200.0::DOUBLE)"
MONTH = "strftime(ts, '%Y-%m')"

DAILY = """
lines AS (SELECT l_returnflag AS series_id, l_shipdate::TIMESTAMP AS ts, l_extendedprice / l_quantity AS p,
    l_quantity, l_orderkey, l_linenumber FROM lineitem),
bars AS (SELECT series_id, ts, first(p ORDER BY l_orderkey, l_linenumber, p) AS open, max(p) AS high, min(p) AS low,
    last(p ORDER BY l_orderkey, l_linenumber, p) AS close, sum(l_quantity)::DOUBLE AS volume
  FROM lines GROUP BY series_id, ts)"""

HALF_HOUR = """
bars AS (SELECT event_type AS series_id, time_bucket(INTERVAL '30 minutes', ts::TIMESTAMP) AS ts,
    first(value ORDER BY ts, event_id, value) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id, value) AS close,
    count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""


def segments(seconds: int) -> str:
    return f"""
flagged AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > {seconds} THEN 1 ELSE 0 END AS new_
  FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
seg AS (SELECT * EXCLUDE (new_), sum(new_) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS segment_id FROM flagged)"""


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY series_id, segment_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, column: str, n: int) -> str:
    return f"CASE WHEN count({column}) {_frame(n)} = {n} THEN {agg}({column}) {_frame(n)} END"


def features() -> str:
    """Table feat: all features and the label of seg; table clean: its rows without NULL."""
    w = "OVER (PARTITION BY series_id, segment_id ORDER BY ts)"
    one = [f"close / nullif(lag(close, {k}) {w}, 0) - 1 AS return_{k}" for k in (1, 3, 6, 12, 24)]
    one += [f"{_full('avg', 'close', n)} AS ma_{n}" for n in (6, 12, 48)]
    one += [f"{_full('avg', 'volume', n)} AS volume_ma_{n}" for n in (12, 48)]
    one += [
        f"volume / nullif(lag(volume) {w}, 0) - 1 AS volume_change_1",
        f"{_full('stddev_samp', 'volume', 48)} AS volume_std",
        f"lead(close, 3) {w} / nullif(close, 0) - 1 AS future_return",
    ]
    two = [f"close / nullif(ma_{n}, 0) - 1 AS price_ma_ratio_{n}" for n in (6, 12, 48)]
    two += [f"{_full('stddev_samp', 'return_1', n)} AS volatility_{n}" for n in (6, 12, 48)]
    two += [f"volume / nullif(volume_ma_{n}, 0) AS volume_ratio_{n}" for n in (12, 48)]
    two += [
        "(volume - volume_ma_48) / nullif(volume_std, 0) AS volume_zscore_48",
        "(close - open) / nullif(open, 0) AS candle_return",
        "(high - low) / nullif(open, 0) AS high_low_range",
        "(high - greatest(open, close)) / nullif(open, 0) AS upper_shadow",
        "(least(open, close) - low) / nullif(open, 0) AS lower_shadow",
        "hour(ts)::INTEGER AS hour",
        "(isodow(ts) - 1)::INTEGER AS day_of_week",
    ]
    return f"""
f1 AS (SELECT *, {", ".join(one)} FROM seg),
feat AS (SELECT * EXCLUDE (volume_std), {", ".join(two)} FROM f1),
clean AS (SELECT * FROM feat WHERE COLUMNS(*) IS NOT NULL)"""


def predicted() -> str:
    """Table pred: clean rows of daily bars with the momentum prediction."""
    return f"{DAILY},{segments(86_400)},{features()},\npred AS (SELECT *, return_3 AS prediction, {MONTH} AS month FROM clean)"


def rank(column: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {column}) + (count(*) OVER (PARTITION BY {by}, {column}) - 1) / 2.0)"


def rounded(*columns: str, digits: int = 8) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def ic(table: str, by: str, name: str) -> str:
    """Table `name`: n_rows, pearson_ic, spearman_ic of table by groups."""
    return f"""
{name}_r AS (SELECT *, {rank("future_return", by)} AS yr, {rank("prediction", by)} AS pr FROM {table}),
{name} AS (SELECT {by}, count(*) AS n_rows,
    CASE WHEN count(*) >= 2 THEN covar_pop(future_return, prediction) / nullif(stddev_pop(future_return) * stddev_pop(prediction), 0) END AS pearson_ic,
    CASE WHEN count(*) >= 2 THEN covar_pop(yr, pr) / nullif(stddev_pop(yr) * stddev_pop(pr), 0) END AS spearman_ic
  FROM {name}_r GROUP BY {by})"""


def thresholds(table: str = "pred", name: str = "thr") -> str:
    """Table `name`: the thinned rows of table with thresholds from past rows only."""
    q = "CASE WHEN count(prediction) OVER w >= 112 THEN quantile_cont(prediction, {}) OVER w END AS {}"
    return f"""
{name} AS (SELECT *, {q.format(0.01, "short_threshold")}, {q.format(0.99, "long_threshold")} FROM (SELECT * FROM {table} WHERE epoch(ts)::BIGINT % {HORIZON} = 0)
  WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 480 PRECEDING AND 1 PRECEDING))"""


def sides() -> str:
    return f"""{predicted()},{thresholds()},
side_rows AS (SELECT thr.*, s.side, CASE
    WHEN short_threshold IS NULL OR long_threshold IS NULL THEN 0
    WHEN side IN ('long', 'long_short') AND prediction >= long_threshold THEN 1
    WHEN side IN ('short', 'long_short') AND prediction <= short_threshold THEN -1 ELSE 0 END AS signal
  FROM thr, (VALUES ('long'), ('short'), ('long_short')) s(side)),
side_bt AS (SELECT *, signal * future_return AS gross_return, CASE WHEN signal <> 0 THEN 1e-4::DOUBLE ELSE 0.0::DOUBLE END AS transaction_cost,
    signal * future_return - CASE WHEN signal <> 0 THEN 1e-4::DOUBLE ELSE 0.0::DOUBLE END AS net_return FROM side_rows)"""


def side_months() -> str:
    return f"""
side_m AS (SELECT series_id, side, month, count(*) FILTER (signal <> 0) AS trades,
    avg(gross_return) FILTER (signal <> 0) * 10000 AS gross_bps, avg(net_return) FILTER (signal <> 0) * 10000 AS net_bps,
    avg((net_return > 0)::INTEGER) FILTER (signal <> 0) AS net_hit_rate,
    CASE WHEN count(*) FILTER (signal <> 0) > 0 THEN product(1 + net_return) - 1 ELSE 0.0 END AS monthly_return
  FROM side_bt GROUP BY ALL)"""


def side_sum() -> str:
    return f"""
side_e AS (SELECT *, product(1 + net_return) OVER (PARTITION BY series_id, side ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity
  FROM side_bt WHERE short_threshold IS NOT NULL AND long_threshold IS NOT NULL),
side_d AS (SELECT *, equity / max(equity) OVER (PARTITION BY series_id, side ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM side_e),
side_s AS (SELECT series_id, side, count(*) FILTER (signal <> 0) AS trades, count(*) FILTER (signal = 1) AS long_trades,
    count(*) FILTER (signal = -1) AS short_trades,
    avg(gross_return) FILTER (signal <> 0) * 10000 AS gross_bps, avg(net_return) FILTER (signal <> 0) * 10000 AS net_bps,
    avg((gross_return > 0)::INTEGER) FILTER (signal <> 0) AS gross_hit_rate,
    avg((net_return > 0)::INTEGER) FILTER (signal <> 0) AS net_hit_rate,
    avg(gross_return) FILTER (signal = 1) * 10000 AS long_bps, avg(gross_return) FILTER (signal = -1) * 10000 AS short_bps,
    CASE WHEN count(*) FILTER (signal <> 0) > 0 THEN avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt({PERIODS}) END AS sharpe,
    CASE WHEN count(*) FILTER (signal <> 0) > 0 THEN min(drawdown) END AS max_drawdown,
    CASE WHEN count(*) FILTER (signal <> 0) > 0 THEN product(1 + net_return) - 1 END AS total_return
  FROM side_d GROUP BY ALL)"""


def positions(table: str = "thr", active: str = "true", name: str = "pos") -> str:
    return f"""
{name}_0 AS (SELECT *, coalesce((prediction >= long_threshold)::INTEGER, 0) AS position FROM {table}),
{name}_1 AS (SELECT *, position - coalesce(lag(position) OVER (PARTITION BY series_id ORDER BY ts), 0) AS position_change FROM {name}_0),
{name}_2 AS (SELECT *, abs(position_change) AS turnover, CASE WHEN {active} THEN position * future_return ELSE 0.0 END AS gross_return,
    CASE WHEN {active} THEN abs(position_change) * 5e-5::DOUBLE ELSE 0.0 END AS transaction_cost FROM {name}_1),
{name} AS (SELECT *, gross_return - transaction_cost AS net_return FROM {name}_2)"""


def backtested() -> str:
    return f"{predicted()},{thresholds()},{positions()}"


WATCHED = ("prediction", "volatility_48", "volume_ratio_48", "return_12", "price_ma_ratio_48")


def psi() -> str:
    """Table psi_m: a `<column>_psi` for each series and month but the first."""
    long = " UNION ALL ".join(f"SELECT series_id, month AS at_, '{c}' AS col, {c} AS value FROM pos" for c in WATCHED)
    pick = ", ".join(f"max(psi) FILTER (col = '{c}') AS {c}_psi" for c in WATCHED)
    cuts = ", ".join(str(i / 10) for i in range(11))
    return f"""
long_ AS ({long}),
months_ AS (SELECT DISTINCT series_id, month FROM pos),
later AS (SELECT m.* FROM months_ m JOIN (SELECT series_id, min(month) AS first FROM months_ GROUP BY 1) f USING (series_id) WHERE month > first),
sam AS (SELECT l.series_id, m.month, l.col, l.value, l.at_ = m.month AS cur FROM long_ l JOIN later m ON l.series_id = m.series_id AND l.at_ <= m.month),
edg AS (SELECT series_id, month, col, count(*) FILTER (cur) AS nc, count(*) FILTER (NOT cur) AS nr,
    list_sort(list_distinct(quantile_cont(value, [{cuts}]) FILTER (NOT cur))) AS q FROM sam GROUP BY ALL),
ed2 AS (SELECT *, q[2:len(q) - 1] AS inner_ FROM edg WHERE len(q) >= 3),
cnt AS (SELECT s.series_id, s.month, s.col, len(list_filter(inner_, lambda e: e <= s.value)) AS bin,
    count(*) FILTER (cur) AS c, count(*) FILTER (NOT cur) AS r FROM sam s JOIN ed2 USING (series_id, month, col) GROUP BY ALL),
evr AS (SELECT series_id, month, col, nc, nr, unnest(range(len(q) - 1)) AS bin FROM ed2),
shr AS (SELECT series_id, month, col, greatest(coalesce(c, 0) / nc, 1e-6::DOUBLE) AS c, greatest(coalesce(r, 0) / nr, 1e-6::DOUBLE) AS r
  FROM evr LEFT JOIN cnt USING (series_id, month, col, bin)),
psi_l AS (SELECT series_id, month, col, sum((c - r) * ln(c / r)) AS psi FROM shr GROUP BY ALL),
psi_m AS (SELECT series_id, month, {pick} FROM psi_l GROUP BY ALL)"""


STAT_COLUMNS = [f"{c}_{s}" for c in WATCHED[1:] for s in ("mean", "std")]


def drift() -> str:
    stats = ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in WATCHED[1:])
    total = " + ".join(f"coalesce({c}_psi, 0)" for c in WATCHED)
    known = " + ".join(f"({c}_psi IS NOT NULL)::INTEGER" for c in WATCHED)
    return f"""{backtested()},{psi()},
msum AS (SELECT series_id, month, count(*) AS n_rows, count(*) FILTER (position = 1) AS active_periods, avg(position) AS signal_frequency,
    avg(prediction) AS prediction_mean, stddev_samp(prediction) AS prediction_std, quantile_cont(prediction, 0.01) AS prediction_p01,
    quantile_cont(prediction, 0.99) AS prediction_p99, avg(gross_return) FILTER (position = 1) * 10000 AS gross_bps,
    avg((gross_return > 0)::INTEGER) FILTER (position = 1) AS signal_hit_rate, product(1 + net_return) - 1 AS monthly_return
  FROM pos GROUP BY ALL),
mstat AS (SELECT series_id, month, {stats} FROM pos GROUP BY ALL),
rep0 AS (SELECT * FROM msum LEFT JOIN psi_m USING (series_id, month) LEFT JOIN mstat USING (series_id, month)),
rep AS (SELECT *, ({total}) / nullif({known}, 0) AS mean_psi, greatest({", ".join(f"{c}_psi" for c in WATCHED)}) AS max_psi FROM rep0)"""


REPORT = [
    "signal_frequency", "prediction_mean", "prediction_std", "prediction_p01", "prediction_p99", "gross_bps", "signal_hit_rate",
    "monthly_return", *[f"{c}_psi" for c in WATCHED], *STAT_COLUMNS, "mean_psi", "max_psi",
]


def monitor() -> str:
    """Table mon: rolling columns of pos; 96-row windows."""
    w = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)"
    every = "OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return f"""{backtested()},
act AS (SELECT *, position AS is_active, CASE WHEN position <> 0 THEN (gross_return > 0)::INTEGER::DOUBLE END AS is_win FROM pos),
mon0 AS (SELECT *, (sum(is_active) {w})::DOUBLE AS rolling_signal_count, avg(is_active) {w} AS rolling_signal_frequency,
    (avg(CASE WHEN position <> 0 THEN gross_return END) {w}) * 10000 AS rolling_avg_gross_bps, avg(is_win) {w} AS rolling_hit_rate,
    exp(sum(ln(1 + net_return)) {w}) - 1 AS rolling_30d_return, product(1 + net_return) {every} AS equity,
    avg(is_active) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS historical_signal_frequency,
    row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM act),
mon AS (SELECT *, equity / max(equity) {w} - 1 AS current_drawdown_30d,
    rolling_signal_frequency / nullif(historical_signal_frequency, 0) AS signal_frequency_ratio FROM mon0)"""


def max_drawdown() -> str:
    return f"""{monitor()},
pairs AS (SELECT a.series_id, a.rn, b.equity, max(b.equity) OVER (PARTITION BY a.series_id, a.rn ORDER BY b.rn ROWS UNBOUNDED PRECEDING) AS peak
  FROM mon a JOIN mon b ON a.series_id = b.series_id AND b.rn BETWEEN a.rn - 95 AND a.rn),
worst AS (SELECT series_id, rn, CASE WHEN rn >= 2 THEN min(equity / peak - 1) END AS rolling_max_drawdown_30d FROM pairs GROUP BY series_id, rn),
mdd AS (SELECT * FROM mon JOIN worst USING (series_id, rn))"""


def _codes(edge: float, hit: float, now: float, worst: float, low: float, high: float) -> str:
    return f"""list_filter([CASE WHEN rolling_avg_gross_bps < {edge} THEN 'NEGATIVE_EDGE' END, CASE WHEN rolling_hit_rate < {hit} THEN 'LOW_HIT_RATE' END,
    CASE WHEN current_drawdown_30d < {now} THEN 'CURRENT_DRAWDOWN' END, CASE WHEN rolling_max_drawdown_30d < {worst} THEN 'MAX_DRAWDOWN' END,
    CASE WHEN signal_frequency_ratio < {low} OR signal_frequency_ratio > {high} THEN 'SIGNAL_FREQUENCY' END], lambda x: x IS NOT NULL)"""


def status() -> str:
    """Table sta: all status columns."""
    return f"""{max_drawdown()},
st0 AS (SELECT *, {_codes(0.0, 0.48, -0.03, -0.05, 0.5, 2.0)} AS warnings, {_codes(-1.0, 0.45, -0.05, -0.08, 0.25, 3.0)} AS criticals,
    coalesce(rolling_avg_gross_bps > 1 AND rolling_hit_rate > 0.52 AND current_drawdown_30d > -0.015, false) AS recovery,
    CASE WHEN rolling_signal_count IS NULL THEN 'NO_DATA' WHEN rolling_signal_count < 10 THEN 'VERY_LOW_SAMPLE'
      WHEN rolling_signal_count < 20 THEN 'LOW_SAMPLE' ELSE 'SUFFICIENT' END AS sample_status FROM mdd),
st1 AS (SELECT *, CASE WHEN len(criticals) >= 2 THEN 'CRITICAL' WHEN len(warnings) >= 1 THEN 'WARNING' ELSE 'HEALTHY' END AS raw_performance_status FROM st0),
st2 AS (SELECT *, sum((raw_performance_status <> 'HEALTHY')::INTEGER) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM st1),
st3 AS (SELECT *, row_number() OVER r - 1 AS k, first_value(raw_performance_status) OVER r AS anchor FROM st2 WINDOW r AS (PARTITION BY series_id, run ORDER BY ts)),
st4 AS (SELECT *, max((raw_performance_status = 'HEALTHY' AND recovery AND k >= CASE WHEN anchor = 'CRITICAL' THEN 2 ELSE 1 END)::INTEGER)
    OVER (PARTITION BY series_id, run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS healed FROM st3),
st5 AS (SELECT *, CASE WHEN raw_performance_status <> 'HEALTHY' THEN raw_performance_status WHEN run = 0 OR healed = 1 THEN 'HEALTHY' ELSE 'WARNING' END
    AS performance_status FROM st4),
sta AS (SELECT *, CASE WHEN performance_status = 'HEALTHY' THEN 'NONE' WHEN performance_status = 'CRITICAL' AND len(criticals) > 0 THEN array_to_string(criticals, '|')
      WHEN len(warnings) > 0 THEN array_to_string(warnings, '|') ELSE 'RECOVERY_HOLD' END AS alert_reason,
    CASE WHEN sample_status = 'NO_DATA' OR (sample_status = 'VERY_LOW_SAMPLE' AND performance_status = 'HEALTHY') THEN sample_status
      WHEN sample_status = 'VERY_LOW_SAMPLE' THEN performance_status || '_VERY_LOW_SAMPLE' WHEN sample_status = 'LOW_SAMPLE' THEN performance_status || '_LOW_CONFIDENCE'
      ELSE performance_status END AS overall_status FROM st5)"""


def days() -> str:
    return f"""{status()},
day_ AS (SELECT * FROM sta QUALIFY row_number() OVER (PARTITION BY series_id, ts::DATE ORDER BY ts DESC) = 1)"""


def oos(cutoff: str) -> str:
    """Tables oos_all (history and test with thresholds) and tst (test rows of its positions)."""
    return f"""{predicted()},
uni AS (SELECT *, ts >= '{cutoff}'::TIMESTAMP AS is_test FROM pred),{thresholds("uni", "oos_all")},{positions("oos_all", "is_test", "opos")},
tst AS (SELECT * FROM opos WHERE is_test)"""
