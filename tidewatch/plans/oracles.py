"""SQL for the registered queries: another derivation of each result, for DuckDB."""

_EVENTS = """
ev AS (SELECT event_id AS alert_id, 'R' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS region, date_trunc('second', ts) AS s, CAST(round(value * 60) AS BIGINT) AS sec, event_type FROM events),
al AS (SELECT *, s + to_seconds(sec) AS f FROM ev WHERE sec > 0)"""
_RECORDS = _EVENTS + """,
rec AS (SELECT region, (s AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Kyiv' AS ls, ((s AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Kyiv') + to_seconds(sec) AS le, sec / 60.0 AS dur FROM al),
m0 AS (SELECT region, ls, le, max(le) OVER (PARTITION BY region ORDER BY ls, le ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM rec),
m1 AS (SELECT *, sum(CASE WHEN pe IS NULL OR ls > pe THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY ls, le ROWS UNBOUNDED PRECEDING) AS isl FROM m0),
merged AS (SELECT region, min(ls) AS s, max(le) AS e FROM m1 GROUP BY region, isl)"""
_HOURS = _RECORDS + """,
hp AS (SELECT region, s, e, unnest(generate_series(date_trunc('hour', s), e - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS h FROM merged),
hm AS (SELECT region, h, sum(epoch_us(least(e, h + INTERVAL 1 HOUR)) - epoch_us(greatest(s, h))) / 6e7 AS m FROM hp GROUP BY region, h),
ob AS (SELECT CAST(min(ls) AS DATE) AS a, CAST(max(le - INTERVAL 1 MICROSECOND) AS DATE) AS b FROM rec),
rg AS (SELECT region, row_number() OVER (ORDER BY region) AS region_id FROM (SELECT DISTINCT region FROM rec)),
gr AS (SELECT region_id, region, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS h FROM rg, ob),
rh AS (SELECT region_id, gr.region AS region_name, gr.h AS datetime_hour, CAST(gr.h AS DATE) AS date, coalesce(m, 0.0) AS alert_minutes_in_hour, coalesce(m, 0.0) > 0 AS is_alert_active,
  hour(gr.h) AS hour, isodow(gr.h) - 1 AS weekday, month(gr.h) AS month, hour(gr.h) >= 22 OR hour(gr.h) < 7 AS is_night, isodow(gr.h) <= 5 AND hour(gr.h) BETWEEN 9 AND 17 AS is_work_hour
  FROM gr LEFT JOIN hm ON gr.region = hm.region AND gr.h = hm.h)"""
_STATS = """,
rd0 AS (SELECT *, unnest(generate_series(date_trunc('day', ls), le - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS d FROM rec),
st AS (SELECT region, CAST(d AS DATE) AS date, count(*) AS raw_alert_record_count, max(dur) AS max_alert_duration, median(dur) AS median_alert_duration, min(greatest(ls, d)) AS first_alert_time, max(least(le, d + INTERVAL 1 DAY)) AS last_alert_time FROM rd0 GROUP BY region, d),
md0 AS (SELECT *, unnest(generate_series(date_trunc('day', s), e - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS d FROM merged),
md AS (SELECT region, d, greatest(s, d) AS cs, least(e, d + INTERVAL 1 DAY) AS ce FROM md0),
gp AS (SELECT *, epoch_us(cs) - epoch_us(coalesce(lag(ce) OVER (PARTITION BY region, d ORDER BY cs), d)) AS gap FROM md),
fw AS (SELECT region, CAST(d AS DATE) AS date, count(*) AS merged_alert_episode_count, greatest(max(gap), epoch_us(d + INTERVAL 1 DAY) - epoch_us(max(ce))) / 6e7 AS longest_alert_free_window_minutes FROM gp GROUP BY region, d)"""
_DAYS = _HOURS + _STATS + """,
dm AS (SELECT region_id, region_name, date, least(1440, sum(alert_minutes_in_hour)) AS t, least(540, coalesce(sum(alert_minutes_in_hour) FILTER (is_night), 0)) AS n, least(540, coalesce(sum(alert_minutes_in_hour) FILTER (is_work_hour), 0)) AS w FROM rh GROUP BY ALL),
rd AS (SELECT region_id, region_name, dm.date AS date, coalesce(raw_alert_record_count, 0) AS alert_count, coalesce(raw_alert_record_count, 0) AS raw_alert_record_count, coalesce(merged_alert_episode_count, 0) AS merged_alert_episode_count,
  CAST(t AS DOUBLE) AS alert_minutes_total, CAST(n AS DOUBLE) AS alert_minutes_night, CAST(w AS DOUBLE) AS alert_minutes_workday, CAST(max_alert_duration AS DOUBLE) AS max_alert_duration, CAST(median_alert_duration AS DOUBLE) AS median_alert_duration,
  coalesce(longest_alert_free_window_minutes, 1440.0) AS longest_alert_free_window_minutes, t / 1440 AS share_day_under_alert, n > 0 AS sleep_window_interrupted, w > 0 AS workday_interrupted, first_alert_time, last_alert_time
  FROM dm LEFT JOIN st ON st.region = region_name AND st.date = dm.date LEFT JOIN fw ON fw.region = region_name AND fw.date = dm.date)"""
_NATIONAL = """,
na0 AS (SELECT date, count(*) FILTER (alert_minutes_total > 0) AS regions_with_alerts_count, sum(alert_minutes_total) AS total_alert_minutes_all_regions FROM rd GROUP BY date),
si AS (SELECT date, max(k) AS max_regions_simultaneously_alerted FROM (SELECT date, datetime_hour, count(*) FILTER (is_alert_active) AS k FROM rh GROUP BY ALL) GROUP BY date),
na AS (SELECT na0.*, max_regions_simultaneously_alerted, coalesce(total_alert_minutes_all_regions / nullif(max(total_alert_minutes_all_regions) OVER (), 0), 0) AS national_alert_burden_index FROM na0 JOIN si USING (date))"""
_scale = lambda x: f"coalesce(({x} - min({x}) OVER ()) / nullif(max({x}) OVER () - min({x}) OVER (), 0), 0)"
_gini = lambda x, n: f"CASE WHEN sum({x}) = 0 OR min({x}) = max({x}) THEN 0 ELSE sum((2 * {n} - k - 1) * {x}) / (max(k) * sum({x})) END"
_METRICS = _DAYS + f""",
ix0 AS (SELECT *, least(1, greatest(0, 0.5 * {_scale("alert_minutes_total")} + 0.2 * {_scale("merged_alert_episode_count")} + 0.2 * {_scale("coalesce(max_alert_duration, 0)")} + 0.1 * {_scale("(1 - longest_alert_free_window_minutes / 1440)")})) AS alert_burden_index,
  least(1, alert_minutes_night / 540) AS sleep_disruption_index, least(1, alert_minutes_workday / 540) AS workday_disruption_index, longest_alert_free_window_minutes / 1440 AS alert_free_window_share, longest_alert_free_window_minutes < 480 AS low_recovery_day FROM rd),
ix AS (SELECT *, {", ".join(f"CASE WHEN {a}_index < 0.33 THEN 'low' WHEN {a}_index < 0.66 THEN 'medium' ELSE 'high' END AS {a}_category" for a in ("alert_burden", "sleep_disruption", "workday_disruption"))} FROM ix0),
rk AS (SELECT date, alert_minutes_total AS a, alert_burden_index AS b, row_number() OVER (PARTITION BY date ORDER BY alert_minutes_total) AS i, row_number() OVER (PARTITION BY date ORDER BY alert_burden_index) AS j, count(*) OVER (PARTITION BY date) AS k FROM ix),
tb AS (SELECT date, {_gini("a", "i")} AS gini_alert_minutes_total, {_gini("b", "j")} AS gini_alert_burden_index, avg(a) FILTER (i > k - greatest(1, ceil(k / 5.0))) AS t, avg(a) FILTER (i <= greatest(1, ceil(k / 5.0))) AS o FROM rk GROUP BY date),
iq AS (SELECT date, gini_alert_minutes_total, gini_alert_burden_index, CASE WHEN o = 0 AND t > 0 THEN NULL WHEN o = 0 THEN 1 ELSE t / o END AS top_bottom_alert_minutes_ratio FROM tb),
mt AS (SELECT ix.*, iq.* EXCLUDE (date) FROM ix JOIN iq USING (date))"""
_SUMMARY = """,
rs AS (SELECT region_id, region_name, min(date) AS date_start, max(date) AS date_end, count(*) AS days_count, sum(alert_minutes_total) AS total_alert_minutes, avg(alert_minutes_total) AS mean_daily_alert_minutes, median(alert_minutes_total) AS median_daily_alert_minutes,
  max(alert_minutes_total) AS max_daily_alert_minutes, CAST(sum(alert_count) AS BIGINT) AS total_alert_count, avg(alert_count) AS mean_daily_alert_count, sum(alert_minutes_night) AS total_night_alert_minutes, avg(sleep_disruption_index) AS mean_sleep_disruption_index,
  count(*) FILTER (sleep_disruption_category = 'high') AS high_sleep_disruption_days, sum(alert_minutes_workday) AS total_workday_alert_minutes, avg(workday_disruption_index) AS mean_workday_disruption_index, count(*) FILTER (workday_disruption_category = 'high') AS high_workday_disruption_days,
  avg(alert_burden_index) AS mean_alert_burden_index, count(*) FILTER (alert_burden_category = 'high') AS high_alert_burden_days, avg(longest_alert_free_window_minutes) AS mean_longest_alert_free_window_minutes, count(*) FILTER (low_recovery_day) AS low_recovery_days,
  count(*) FILTER (alert_minutes_total > 0) AS days_with_any_alert, count(*) FILTER (alert_minutes_total > 0) / count(*) AS share_days_with_any_alert FROM mt GROUP BY region_id, region_name)"""
_SERIES = """
oc AS (SELECT r_name, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
gd AS (SELECT r_name, CAST(unnest(generate_series((SELECT min(date) FROM oc), (SELECT max(date) FROM oc), INTERVAL 1 DAY)) AS DATE) AS date FROM region),
se AS (SELECT gd.r_name AS region_name, gd.date AS date, CAST(least(1440, 120 * coalesce(n, 0)) AS DOUBLE) AS alert_minutes_total, least(1440, 120 * coalesce(n, 0)) / 1440 AS alert_burden_index FROM gd LEFT JOIN oc ON gd.r_name = oc.r_name AND gd.date = oc.date)"""
_over = lambda f, n: f"{f} OVER (PARTITION BY region_name ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_ROLL = ", ".join(f"round({_over(f'avg({v})', n)}, 6) AS {name}_{n}d_mean" for name, v in (("alert_minutes", "alert_minutes_total"), ("abi", "alert_burden_index")) for n in (7, 14, 30))
_ROLL += ", " + ", ".join(f"round(coalesce({_over(f'stddev_samp({v})', n)}, 0), 6) AS {name}_{n}d_std" for name, v in (("alert_minutes", "alert_minutes_total"), ("abi", "alert_burden_index")) for n in (14, 30))
_part = lambda v, p: f"avg({v}) FILTER (n < 3 OR {p})"
_PERIODS = _SERIES + f""",
pn AS (SELECT region_name AS region, alert_minutes_total AS m, alert_burden_index AS b, row_number() OVER (PARTITION BY region_name ORDER BY date) AS i, count(*) OVER (PARTITION BY region_name) AS n FROM se),
pp AS (SELECT *, greatest(1, n // 3) AS x, greatest(greatest(1, n // 3) + 1, 2 * n // 3) AS y FROM pn),
pc AS (SELECT region, count(*) AS n_days, avg(m) AS mean_alert_minutes, coalesce(stddev_samp(m), 0) AS std_alert_minutes,
  {_part("m", "i <= x")} AS early_mean_alert_minutes, {_part("m", "(i > x AND i <= y)")} AS middle_mean_alert_minutes, {_part("m", "i > y")} AS late_mean_alert_minutes,
  {_part("b", "i <= x")} AS early_mean_abi, {_part("b", "(i > x AND i <= y)")} AS middle_mean_abi, {_part("b", "i > y")} AS late_mean_abi,
  avg(m) FILTER (n - i < 30) AS latest_30d_alert_minutes_mean, coalesce(avg(m) FILTER (n - i >= 30 AND n - i < 60), avg(m) FILTER (n - i < 30)) AS previous_30d_alert_minutes_mean FROM pp GROUP BY region),
pd AS (SELECT *, CASE WHEN early_mean_alert_minutes = 0 AND late_mean_alert_minutes = 0 THEN 1 ELSE late_mean_alert_minutes / nullif(early_mean_alert_minutes, 0) END AS late_vs_early_alert_minutes_ratio, late_mean_abi - early_mean_abi AS late_vs_early_abi_delta,
  latest_30d_alert_minutes_mean - previous_30d_alert_minutes_mean AS latest_vs_previous_30d_delta, CASE WHEN std_alert_minutes < 60 THEN 'low' WHEN std_alert_minutes < 180 THEN 'medium' ELSE 'high' END AS volatility_label,
  CASE WHEN abs(late_mean_alert_minutes - early_mean_alert_minutes) < 30 AND abs(late_mean_abi - early_mean_abi) < 0.03 THEN 'stable' WHEN late_mean_alert_minutes - early_mean_alert_minutes >= 30 AND late_mean_abi - early_mean_abi >= 0.03 THEN 'worsening'
  WHEN late_mean_alert_minutes - early_mean_alert_minutes <= -30 AND late_mean_abi - early_mean_abi <= -0.03 THEN 'improving' ELSE 'mixed' END AS trend_label FROM pc)"""


def _q(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _rounded(table: str, doubles: str, rest: str) -> str:
    return f"SELECT {rest}, {', '.join(f'round({c}, {9 if c in ("share_day_under_alert", "alert_free_window_share") else 6}) AS {c}' for c in doubles.split())} FROM {table}"


def _ranges(table: str, ranges: dict[str, tuple[float, float]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS metric, round(min({c}), 6) AS min, round(max({c}), 6) AS max, CAST({a} AS DOUBLE) AS lower, CAST({b} AS DOUBLE) AS upper, coalesce(min({c}) >= {a} AND max({c}) <= {b}, true) AS passed FROM {table}" for c, (a, b) in ranges.items())


_DAY_DOUBLES = "alert_minutes_total alert_minutes_night alert_minutes_workday max_alert_duration median_alert_duration longest_alert_free_window_minutes share_day_under_alert"
_DAY_REST = "region_id, region_name, date, alert_count, raw_alert_record_count, merged_alert_episode_count, sleep_window_interrupted, workday_interrupted, first_alert_time, last_alert_time"
_IQ = "gini_alert_minutes_total gini_alert_burden_index top_bottom_alert_minutes_ratio"
_CLEAN = _EVENTS + """,
off AS (SELECT DISTINCT 'official' AS source, region, event_type, s, f, sec FROM al WHERE event_type <> 'view' AND s >= TIMESTAMP '2024-01-10'),
vol AS (SELECT DISTINCT 'volunteer' AS source, region, event_type, s, f, sec FROM al WHERE event_type = 'view'),
cl AS (SELECT * FROM off UNION ALL SELECT * FROM vol WHERE (SELECT min(s) FROM off) IS NULL OR s < (SELECT min(s) FROM off))"""
_FR = {"alert_minutes_total": (0, 1440), "alert_minutes_night": (0, 540), "alert_minutes_workday": (0, 540), "longest_alert_free_window_minutes": (0, 1440), "share_day_under_alert": (0, 1)}
_MR = {c: (0, 1) for c in ("alert_burden_index", "sleep_disruption_index", "workday_disruption_index", "alert_free_window_share", "gini_alert_minutes_total", "gini_alert_burden_index")}

_FAULTY = """
f0 AS (SELECT event_id AS alert_id, 'R' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS region, date_trunc('second', ts) AS s, value,
              CASE WHEN value < 10 THEN 0 ELSE CAST(round(value * 60) AS BIGINT) END AS sec FROM events),
fa AS (SELECT *, CASE WHEN value >= 5 THEN s + to_seconds(sec) END AS f FROM f0)"""


def _round(k: int) -> str:
    """A round of binary segmentation: segments s<k> to s<k + 1>, by the split with the largest gain, if the region has one left."""
    return f""",
g{k} AS (SELECT s.region, s.a, s.b, p.p, (p.t - x.t) ** 2 / (p.p - s.a) + (y.t - p.t) ** 2 / (s.b - p.p) - (y.t - x.t) ** 2 / (s.b - s.a) AS gain
  FROM s{k} s JOIN cl ON cl.region = s.region AND {k} < cl.most JOIN px p ON p.region = s.region AND p.p % 5 = 0 AND p.p - s.a >= cl.lo AND s.b - p.p >= cl.lo
  JOIN px x ON x.region = s.region AND x.p = s.a JOIN px y ON y.region = s.region AND y.p = s.b),
h{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY gain DESC, a, p DESC) AS place FROM g{k}) WHERE place = 1),
s{k + 1} AS (SELECT s.region, s.a, s.b FROM s{k} s ANTI JOIN h{k} h ON h.region = s.region AND h.a = s.a
  UNION ALL SELECT region, a, p FROM h{k} UNION ALL SELECT region, p, b FROM h{k})"""


_SHIFTS = _PERIODS + """,
cv AS (SELECT region_name AS region, date, alert_minutes_total AS v, row_number() OVER (PARTITION BY region_name ORDER BY date) AS i, count(*) OVER (PARTITION BY region_name) AS n FROM se),
px AS (SELECT region, i AS p, sum(v) OVER (PARTITION BY region ORDER BY i) AS t FROM cv UNION ALL SELECT DISTINCT region, 0, 0 FROM cv),
c0 AS (SELECT region, count(*) AS n, greatest(3, least(30, count(*) // 6)) AS lo, stddev_samp(v) AS sd FROM cv GROUP BY region HAVING count(*) >= 18 AND max(v) <> 0 AND stddev_pop(v) >= 1e-9),
cl AS (SELECT *, least(3, greatest(1, n // lo - 1)) AS most FROM c0),
s0 AS (SELECT region, 0 AS a, n AS b FROM cl)""" + "".join(map(_round, range(3))) + """,
sw AS (SELECT cl.* FROM cl JOIN s3 ON s3.region = cl.region GROUP BY ALL HAVING count(*) = cl.most + 1),
sm AS (SELECT s.region, s.a, s.b, (y.t - x.t) / (s.b - s.a) AS mean, sw.sd FROM s3 s JOIN sw ON sw.region = s.region
  JOIN px x ON x.region = s.region AND x.p = s.a JOIN px y ON y.region = s.region AND y.p = s.b),
sg AS (SELECT *, lag(mean) OVER (PARTITION BY region ORDER BY a) AS before FROM sm),
sp AS (SELECT sg.region, cv.date FROM sg JOIN cv ON cv.region = sg.region AND cv.i = sg.a + 1 WHERE before IS NOT NULL AND abs(mean - before) >= greatest(60, 0.5 * sd)),
cp AS (SELECT pd.region, count(sp.date) AS n_change_points, coalesce(string_agg(CAST(sp.date AS VARCHAR), ';' ORDER BY sp.date), '') AS change_point_dates
  FROM pd LEFT JOIN sp ON sp.region = pd.region GROUP BY pd.region),
ts AS (SELECT pd.*, n_change_points, change_point_dates, CASE WHEN n_change_points <= 0 THEN 'no clear statistical shift' WHEN n_change_points >= 2 THEN 'repeated statistical shifts'
  ELSE 'possible statistical shift' END AS regime_shift_label FROM pd JOIN cp ON cp.region = pd.region),
rl AS (SELECT region_name, date, alert_minutes_total, round(alert_burden_index, 6) AS alert_burden_index, """ + _ROLL + """ FROM se),
rank AS (SELECT region, std_alert_minutes, latest_vs_previous_30d_delta, round_even(latest_30d_alert_minutes_mean / 60, 1) AS latest_hours, round_even(latest_vs_previous_30d_delta / 60, 1) AS delta_hours, volatility_label,
  CASE trend_label WHEN 'worsening' THEN 'historically increased' WHEN 'stable' THEN 'historically stable' WHEN 'improving' THEN 'historically decreased' ELSE 'mixed historical pattern' END AS public_trend_label,
  regime_shift_label AS public_shift_label, n_change_points FROM ts)"""
_TS = (
    "mean_alert_minutes std_alert_minutes early_mean_alert_minutes middle_mean_alert_minutes late_mean_alert_minutes early_mean_abi middle_mean_abi late_mean_abi "
    "latest_30d_alert_minutes_mean previous_30d_alert_minutes_mean late_vs_early_alert_minutes_ratio late_vs_early_abi_delta latest_vs_previous_30d_delta"
)
_TS_REST = "region, n_days, volatility_label, trend_label, n_change_points, change_point_dates, regime_shift_label"
_RANK = "SELECT region, latest_hours, delta_hours, volatility_label, public_trend_label, public_shift_label, n_change_points FROM rank ORDER BY"
_LONG = "date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'"
_CHOSEN = "region_name IN ('R01', 'R07') AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"
_per_day = lambda c, sign="": f"{sign}format('{{:,.1f}} h/day', {c} / 60)"
_CATEGORIES = ("alert_burden_category", "sleep_disruption_category", "workday_disruption_category")
_INDICES = " OR ".join(f"isinf({c})" for c in _MR)
_SERIES_ROWS = " OR ".join(f"isinf({c})" for c in ("alert_minutes_total", "alert_burden_index", "alert_minutes_30d_mean", "abi_30d_std"))

VIEWS = {
    "change_points": _q(_SHIFTS, "SELECT * FROM cp"),
    "timeseries_summary": _q(_SHIFTS, _rounded("ts", _TS, _TS_REST)),
    "timeseries_summary_row": _q(_SHIFTS, _rounded("ts", _TS, _TS_REST) + " WHERE region = 'ASIA'"),
    "timeseries_region": _q(_SHIFTS, f"SELECT * FROM rl WHERE region_name = 'ASIA' AND {_LONG}"),
    "stability_metric_series": _q(_SHIFTS, f"""SELECT region_name, date, alert_burden_index AS daily, abi_14d_mean AS rolling_14, abi_30d_mean AS rolling_30, abi_14d_std AS volatility_14,
      abi_30d_std AS volatility_30 FROM rl WHERE region_name = 'EUROPE' AND {_LONG}"""),
    "stability_cards": _q(_SHIFTS, f"""SELECT ts.region, {_per_day("latest_30d_alert_minutes_mean")} AS latest, {_per_day("previous_30d_alert_minutes_mean")} AS previous,
      {_per_day("ts.latest_vs_previous_30d_delta", "CASE WHEN ts.latest_vs_previous_30d_delta > 0 THEN '+' ELSE '' END || ")} AS change, ts.volatility_label, public_trend_label AS trend,
      public_shift_label AS shift, ts.n_change_points FROM ts JOIN rank ON rank.region = ts.region WHERE ts.region = 'ASIA'"""),
    "stability_ranking": _q(_SHIFTS, f"{_RANK} std_alert_minutes DESC, region LIMIT 10"),
    "recent_increase_ranking": _q(_SHIFTS, f"{_RANK} latest_vs_previous_30d_delta DESC, region LIMIT 10"),
    "example_regions": _q(_SHIFTS, """SELECT region, volatility_label, round(mean_alert_minutes, 6) AS mean_alert_minutes, round(std_alert_minutes, 6) AS std_alert_minutes FROM ts
      WHERE volatility_label IN ('medium', 'high') ORDER BY ts.std_alert_minutes DESC, ts.mean_alert_minutes DESC, region LIMIT 10"""),
    "shift_dates": _q(_SHIFTS, "SELECT region, CAST(date AS VARCHAR) AS shift_date FROM sp"),
    "series_checks": _q(_SHIFTS, f"""SELECT unnest(['series_columns', 'summary_columns']) AS metric, true AS passed
      UNION ALL SELECT 'row_count', (SELECT count(*) FROM rl) = (SELECT count(*) FROM se) UNION ALL SELECT 'series_infinite', count(*) = 0 FROM rl WHERE {_SERIES_ROWS}
      UNION ALL SELECT 'summary_infinite', count(*) = 0 FROM ts WHERE isinf(mean_alert_minutes) OR isinf(std_alert_minutes)
      UNION ALL SELECT 'volatility_label', count(*) = 0 FROM ts WHERE volatility_label NOT IN ('low', 'medium', 'high')
      UNION ALL SELECT 'trend_label', count(*) = 0 FROM ts WHERE trend_label NOT IN ('worsening', 'stable', 'improving', 'mixed')
      UNION ALL SELECT 'regime_shift_label', count(*) = 0 FROM ts WHERE NOT contains(regime_shift_label, 'statistical shift')"""),
    "chosen_cards": _q(_METRICS + _NATIONAL, f"""SELECT count(DISTINCT region_name) AS n_regions, format('{{:,.3f}}', avg(alert_burden_index)) AS mean_abi, format('{{:,.3f}}', avg(sleep_disruption_index)) AS mean_sdi,
      format('{{:,.3f}}', avg(workday_disruption_index)) AS mean_wdi, (SELECT max(max_regions_simultaneously_alerted) FROM na) AS max_regions_simultaneously_alerted_observed,
      format('{{:,.0f}} h', sum(alert_minutes_total) / 60) AS total_hours FROM mt WHERE {_CHOSEN}"""),
    "sidebar_choices": _q(_DAYS, """SELECT string_agg(DISTINCT region_name, ';' ORDER BY region_name) AS regions, min(date) AS first_date, max(date) AS last_date,
      coalesce(max(region_name) FILTER (region_name = 'Kyiv City'), min(region_name)) AS default_region FROM rd"""),
    "region_list": _q(_DAYS, "SELECT DISTINCT region_name FROM rd"),
    "chosen_rolling": _q(_METRICS, f"""SELECT region_name, date, round(alert_minutes_total, 6) AS alert_minutes_total, round({_over("avg(alert_minutes_total)", 14)}, 6) AS alert_minutes_total_rolling
      FROM mt WHERE {_CHOSEN}"""),
    "disruption_series": _q(_METRICS, f"""SELECT region_name, date, round(sleep_disruption_index, 6) AS sleep_disruption_index, round(workday_disruption_index, 6) AS workday_disruption_index
      FROM mt WHERE {_CHOSEN}"""),
    "metric_checks": _q(_METRICS, " UNION ALL ".join(f"SELECT '{c}' AS metric, coalesce(min({c}) >= 0 AND max({c}) <= 1, true) AS passed FROM mt" for c in _MR)
      + "".join(f" UNION ALL SELECT '{c}', count(*) FILTER ({c} NOT IN ('low', 'medium', 'high')) = 0 FROM mt" for c in _CATEGORIES)
      + f" UNION ALL SELECT 'no_infinite_values', count(*) FILTER ({_INDICES}) = 0 FROM mt"),
}

ORACLES = {
    "minutes_by_region_day": _q(_HOURS, "SELECT region AS region_name, CAST(h AS DATE) AS date, round(sum(m), 6) AS alert_minutes FROM hm GROUP BY ALL"),
    "merged_intervals": _q(_RECORDS, "SELECT region, s, e FROM merged"),
    "observed_range": _q(_HOURS, "SELECT a AS first_date, b AS last_date FROM ob"),
    "region_hour_features": _q(_HOURS, "SELECT * REPLACE (round(alert_minutes_in_hour, 6) AS alert_minutes_in_hour) FROM rh"),
    "daily_alert_stats": _q(_RECORDS + _STATS, _rounded("st", "max_alert_duration median_alert_duration", "region, date, raw_alert_record_count, first_alert_time, last_alert_time")),
    "longest_free_window": _q(_RECORDS + _STATS, _rounded("fw", "longest_alert_free_window_minutes", "region, date, merged_alert_episode_count")),
    "region_day_features": _q(_DAYS, _rounded("rd", _DAY_DOUBLES, _DAY_REST)),
    "national_day_features": _q(_DAYS + _NATIONAL, _rounded("na", "total_alert_minutes_all_regions national_alert_burden_index", "date, regions_with_alerts_count, max_regions_simultaneously_alerted")),
    "region_day_metrics": _q(_METRICS, _rounded("mt", f"{_DAY_DOUBLES} alert_burden_index sleep_disruption_index workday_disruption_index alert_free_window_share {_IQ}", f"{_DAY_REST}, low_recovery_day, alert_burden_category, sleep_disruption_category, workday_disruption_category")),
    "daily_inequality": _q(_METRICS, _rounded("iq", _IQ, "date")),
    "region_summary": _q(_METRICS + _SUMMARY, _rounded("rs", "total_alert_minutes mean_daily_alert_minutes median_daily_alert_minutes max_daily_alert_minutes mean_daily_alert_count total_night_alert_minutes mean_sleep_disruption_index total_workday_alert_minutes mean_workday_disruption_index mean_alert_burden_index mean_longest_alert_free_window_minutes share_days_with_any_alert", "region_id, region_name, date_start, date_end, days_count, total_alert_count, high_sleep_disruption_days, high_workday_disruption_days, high_alert_burden_days, low_recovery_days, days_with_any_alert")),
    "national_summary": _q(_METRICS + _NATIONAL, "SELECT min(date) AS date_start, max(date) AS date_end, count(*) AS days_count, round(sum(total_alert_minutes_all_regions), 6) AS total_alert_minutes_all_regions, round(avg(total_alert_minutes_all_regions), 6) AS mean_daily_total_alert_minutes_all_regions, round(max(total_alert_minutes_all_regions), 6) AS max_daily_total_alert_minutes_all_regions, round(avg(regions_with_alerts_count), 6) AS mean_regions_with_alerts_count, max(regions_with_alerts_count) AS max_regions_with_alerts_count, round(avg(national_alert_burden_index), 6) AS mean_national_alert_burden_index, max(max_regions_simultaneously_alerted) AS max_regions_simultaneously_alerted_observed, round(avg(gini_alert_minutes_total), 6) AS mean_gini_alert_minutes_total, round(avg(gini_alert_burden_index), 6) AS mean_gini_alert_burden_index FROM na JOIN iq USING (date)"),
    "clean_intervals": _q(_CLEAN, "SELECT row_number() OVER (ORDER BY s, f, region, event_type, source) AS alert_id, source, region, event_type AS alert_level, s AS started_at_utc, f AS finished_at_utc, CAST(s AS DATE) AS started_date_utc, sec AS duration_seconds, round(sec / 60.0, 6) AS duration_minutes, CASE WHEN sec > 86400 THEN 'long_interval' ELSE 'ok' END AS duration_quality FROM cl"),
    "clean_summary": _q(_CLEAN, "SELECT count(*) AS n_rows, count(DISTINCT region) AS n_regions, min(s) AS coverage_start, max(f) AS coverage_end FROM cl"),
    "rolling_series": _q(_SERIES, f"SELECT region_name, date, alert_minutes_total, round(alert_burden_index, 6) AS alert_burden_index, {_ROLL} FROM se"),
    "rolling_parameter": _q(_SERIES, f"SELECT region_name, date, alert_minutes_total, round(alert_burden_index, 6) AS alert_burden_index, round({_over('avg(alert_minutes_total)', 5)}, 6) AS alert_minutes_total_rolling FROM se"),
    "period_comparison": _q(_PERIODS, _rounded("pd", "mean_alert_minutes std_alert_minutes early_mean_alert_minutes middle_mean_alert_minutes late_mean_alert_minutes early_mean_abi middle_mean_abi late_mean_abi latest_30d_alert_minutes_mean previous_30d_alert_minutes_mean late_vs_early_alert_minutes_ratio late_vs_early_abi_delta latest_vs_previous_30d_delta", "region, n_days, volatility_label, trend_label")),
    "filter_region_day": _q(_DAYS, "SELECT region_name, date, round(alert_minutes_total, 6) AS alert_minutes_total FROM rd WHERE region_name IN ('R01', 'R07') AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"),
    "ranking_top10": _q(_METRICS + _SUMMARY, "SELECT region_name, round(mean_alert_burden_index, 6) AS mean_alert_burden_index FROM rs ORDER BY mean_alert_burden_index DESC, region_name LIMIT 10"),
    "overview_cards": _q(_METRICS, "SELECT count(DISTINCT region_name) AS n_regions, round(avg(alert_burden_index), 6) AS mean_abi, round(avg(sleep_disruption_index), 6) AS mean_sdi, round(avg(workday_disruption_index), 6) AS mean_wdi, round(sum(alert_minutes_total), 6) AS total_minutes FROM mt"),
    "inequality_series": _q(_METRICS, "SELECT date, round(gini_alert_minutes_total, 6) AS gini_minutes, round(gini_alert_burden_index, 6) AS gini_burden FROM iq WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"),
    "category_counts": _q(_METRICS, "SELECT alert_burden_category AS value, count(*) AS n FROM mt GROUP BY 1"),
    "feature_ranges": _q(_DAYS + _NATIONAL, " UNION ALL ".join(_ranges(t, r) for t, r in (("rh", {"alert_minutes_in_hour": (0, 60)}), ("rd", _FR), ("na", {"national_alert_burden_index": (0, 1)})))),
    "metric_ranges": _q(_METRICS, _ranges("mt", _MR)),
    "profile_alerts": _q(_FAULTY, "SELECT count(*) AS n_rows, count(DISTINCT region) AS n_regions, min(s) AS coverage_start, max(f) AS coverage_end, count(*) FILTER (f IS NULL) AS missing_ends, count(*) FILTER (sec <= 0) AS non_positive_durations, count(alert_id) - count(DISTINCT alert_id) AS duplicate_ids FROM fa"),
} | VIEWS
ORACLES |= {
    "streamed_intervals": ORACLES["merged_intervals"],
    "streamed_metrics": ORACLES["region_day_metrics"],
    "updated_days": ORACLES["region_day_features"],
    "closed_intervals": _q(_RECORDS, """SELECT region, min(ls) AS s, max(le) AS e, count(*) AS n_records FROM m1 GROUP BY region, isl
      HAVING max(le) <= (SELECT max(ls) FROM rec) - INTERVAL 6 HOUR"""),
    "region_medians": _q(_RECORDS, "SELECT region, round(CAST(median(dur) AS DOUBLE), 6) AS median FROM rec GROUP BY region"),
    "measured_checks": ORACLES["metric_checks"],
    "published_metrics": ORACLES["region_day_metrics"],
}
