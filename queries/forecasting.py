"""Forecast queries on user series with missing values, and on daily revenue."""

from pyspark.sql import functions as F

from mendcast.operators import clean as cl, forecast as fc, repair as rp
from mendcast.operators.boosting import per_series_boosting as per_series
from queries import query
from queries.cleaning import EXTERNAL, _external
from queries.fixtures import DEG, EV, LI, ev_deg, ev_user, li_day, rounded, rsql, stored
from queries.repairing import KNOTS, _line
from queries.scoring import train_12

H = 12
STATE = f"""o AS (SELECT series_id, pos, value, row_number() OVER w - 1 AS r, row_number() OVER (PARTITION BY series_id ORDER BY pos DESC) AS b,
  value - lag(value) OVER w AS d, lag(value) OVER w - lag(value, 2) OVER w AS e, count(*) OVER (PARTITION BY series_id) AS m
  FROM deg WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
lastp AS (SELECT series_id, max(pos) AS last_pos FROM deg GROUP BY series_id),
st AS (SELECT series_id, any_value(last_pos) AS last_pos, any_value(m) AS m, max(value) FILTER (b = 1) AS y, max(value) FILTER (b = 2) AS y2,
  max(value) FILTER (b = least(10, m)) AS y10, least(10, any_value(m)) AS k FROM o JOIN lastp USING (series_id) GROUP BY series_id),
steps AS (SELECT st.*, CAST(i AS BIGINT) AS step FROM st, range(1, {H + 1}) g(i))"""
BASE = f"{DEG}, {STATE}"
DIFF2 = "CASE WHEN m >= 2 THEN y + step * (y - y2) ELSE y END"


def _fsql(expr: str, cte: str = BASE, source: str = "steps", dp: int = 8) -> str:
    return rsql(f"WITH {cte} SELECT series_id, step, last_pos + step AS pos, {expr} AS predicted FROM {source}", "predicted", dp)


def _show(df, dp=8):
    return rounded(df.select("series_id", "step", "pos", "predicted"), dp)


def _register(name, fn, sql, dp=8):
    @query(name, sql)
    def run(spark, sf):
        return _show(fn(ev_deg(spark, sf)), dp)


_register("forecast_last_value", lambda d: fc.forecast_last_value(d, H), _fsql("y"))
# blocks of 8: the last ten values span several of them
_register("forecast_drift10", lambda d: fc.forecast_drift10(d, H, block=8), _fsql("y + step * (y - y10) / (k - 1)"))
_register("forecast_last_diff", lambda d: fc.forecast_last_diff(d, H), _fsql(DIFF2))
_register("forecast_secant10", lambda d: fc.forecast_secant10(d, H),
          _fsql(f"CASE WHEN m >= 5 THEN y + step * (y - y10) / CAST(k AS DOUBLE) ELSE {DIFF2} END"))

EW = f"""{BASE}, ew0 AS (SELECT series_id, least(20, m) AS n20, d, least(20, m) - b AS i FROM o WHERE b < least(20, m)),
ew AS (SELECT series_id, sum(d * exp(-1 + (i - 1) / CAST(n20 - 1 AS DOUBLE))) / sum(exp(-1 + (i - 1) / CAST(n20 - 1 AS DOUBLE))) AS tr FROM ew0 GROUP BY series_id)"""
_EWX = f"CASE WHEN m >= 5 THEN y + step * tr ELSE {DIFF2} END"
_register("forecast_exp_weighted_drift", lambda d: fc.forecast_exp_weighted_drift(d, H),
          _fsql(_EWX, EW, "steps JOIN ew USING (series_id)"))

DE = BASE.replace("ev AS (", "RECURSIVE ev AS (", 1) + """, t20 AS (SELECT series_id, value, least(20, m) - b AS i FROM o WHERE b <= least(20, m)),
de(series_id, i, level, trend) AS (
  SELECT series_id, CAST(0 AS BIGINT), CAST(0.3 AS DOUBLE) * value + CAST(0.7 AS DOUBLE) * value,
    CAST(0.3 AS DOUBLE) * ((CAST(0.3 AS DOUBLE) * value + CAST(0.7 AS DOUBLE) * value)
      - (CAST(0.3 AS DOUBLE) * value + CAST(0.7 AS DOUBLE) * (CAST(0.3 AS DOUBLE) * value + CAST(0.7 AS DOUBLE) * value))) FROM t20 WHERE i = 0
  UNION ALL SELECT t.series_id, t.i, CAST(0.3 AS DOUBLE) * t.value + CAST(0.7 AS DOUBLE) * (de.level + de.trend),
    CAST(0.3 AS DOUBLE) * ((CAST(0.3 AS DOUBLE) * t.value + CAST(0.7 AS DOUBLE) * (de.level + de.trend))
      - (CAST(0.3 AS DOUBLE) * t.value + CAST(0.7 AS DOUBLE) * (CAST(0.3 AS DOUBLE) * t.value + CAST(0.7 AS DOUBLE) * (de.level + de.trend))))
    + CAST(0.7 AS DOUBLE) * de.trend
  FROM de JOIN t20 t ON t.series_id = de.series_id AND t.i = de.i + 1),
dl AS (SELECT series_id, max_by(level, i) AS level, max_by(trend, i) AS trend FROM de GROUP BY series_id)"""
_register("forecast_double_exp20", lambda d: fc.forecast_double_exp20(d, H),
          _fsql(f"CASE WHEN m >= 5 THEN level + step * trend ELSE {DIFF2} END", DE, "steps JOIN dl USING (series_id)"))

A, B = "CAST(0.3 AS DOUBLE)", "CAST(0.1 AS DOUBLE)"


def _holt_cte(values: str) -> str:
    """Plain recursion over the observed values of ``values`` (series_id, r, v)."""
    return f"""hr(series_id, r, level, trend) AS (
  SELECT a.series_id, CAST(0 AS BIGINT), a.v, coalesce(b.v - a.v, 0) FROM {values} a LEFT JOIN {values} b ON b.series_id = a.series_id AND b.r = 1 WHERE a.r = 0
  UNION ALL SELECT t.series_id, t.r, {A} * t.v + (1 - {A}) * (h.level + h.trend),
    {B} * (({A} * t.v + (1 - {A}) * (h.level + h.trend)) - h.level) + (1 - {B}) * h.trend
  FROM hr h JOIN {values} t ON t.series_id = h.series_id AND t.r = h.r + 1),
hl AS (SELECT series_id, max_by(level, r) AS level, max_by(trend, r) AS trend FROM hr GROUP BY series_id)"""


HOLT = BASE.replace("ev AS (", "RECURSIVE ev AS (", 1) + ", hv AS (SELECT series_id, r, value AS v FROM o), " + _holt_cte("hv")
_register("forecast_holt", lambda d: fc.forecast_holt(d, H, 0.3, 0.1, block=16),
          _fsql("CASE WHEN m >= 2 THEN level + step * trend ELSE y END", HOLT, "steps JOIN hl USING (series_id)", 6), 6)

HOLTS = BASE.replace("ev AS (", "RECURSIVE ev AS (", 1) + """, ph AS (SELECT series_id, r % 7 AS p, avg(value) AS a FROM o GROUP BY ALL),
mu AS (SELECT series_id, avg(value) AS mu FROM o GROUP BY ALL),
hv AS (SELECT o.series_id, o.r, o.value - (ph.a - mu.mu) AS v FROM o JOIN ph ON ph.series_id = o.series_id AND ph.p = o.r % 7
  JOIN mu ON mu.series_id = o.series_id), """ + _holt_cte("hv")
_register("forecast_holt_seasonal", lambda d: fc.forecast_holt(d, H, 0.3, 0.1, season=7),
          _fsql("level + step * trend + (ph.a - mu.mu)", HOLTS,
                "(SELECT s.*, hl.level, hl.trend, (s.m + s.step - 1) % 7 AS q FROM steps s JOIN hl USING (series_id)) "
                "JOIN ph USING (series_id) JOIN mu USING (series_id)", 6).replace(
              "AS predicted FROM (SELECT s.*", "AS predicted FROM (SELECT s.*").replace(
              "JOIN mu USING (series_id))", "JOIN mu USING (series_id) WHERE ph.p = q)"), 6)

ARI = f"""{EW}, fit AS (SELECT series_id, greatest(least(CASE WHEN NOT isnan(regr_slope(d, e)) THEN regr_slope(d, e) END, 0.99), -0.99) AS phi,
  regr_avgy(d, e) AS ay, regr_avgx(d, e) AS ax FROM o GROUP BY series_id),
ari AS (SELECT *, (ay - phi * ax) / (1 - phi) AS mn FROM fit)"""
_register("forecast_ari1", lambda d: fc.forecast_ari1(d, H, block=16),
          _fsql(f"coalesce(CASE WHEN m >= 5 THEN y + step * mn + (y - y2 - mn) * phi * (1 - pow(phi, step)) / (1 - phi) END, {_EWX})",
                ARI, "steps JOIN ari USING (series_id) LEFT JOIN ew USING (series_id)"))

# daily revenue: long enough for the even subsample to drop rows
SUB = f"""{LI}, n AS (SELECT series_id, count(*) AS n, max(pos) AS last_pos FROM li GROUP BY series_id),
tgt AS (SELECT DISTINCT series_id, CASE WHEN i = 499 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / CAST(499 AS DOUBLE))) AS BIGINT) END AS pos FROM n, range(0, 500) g(i) WHERE n > 500),
sub AS (SELECT li.* FROM li JOIN n USING (series_id) WHERE n <= 500 OR EXISTS (SELECT 1 FROM tgt WHERE tgt.series_id = li.series_id AND tgt.pos = li.pos))"""


@query("even_subsample", rsql(f"WITH {SUB} SELECT series_id, pos, value FROM sub", "value", 8))
def even_subsample(spark, sf):
    return rounded(fc.even_subsample(li_day(spark, sf)).select("series_id", "pos", "value"), 8)


@query("forecast_trend", rsql(f"""WITH {LI}, n AS (SELECT series_id, max(pos) AS last_pos FROM li GROUP BY ALL),
f AS (SELECT series_id, regr_slope(value, pos) AS s, regr_intercept(value, pos) AS c FROM li GROUP BY ALL)
SELECT series_id, CAST(i AS BIGINT) AS step, last_pos + i AS pos, c + s * (last_pos + i) AS predicted FROM n JOIN f USING (series_id), range(1, 31) g(i)""", "predicted"))
def forecast_trend(spark, sf):
    return _show(fc.forecast_trend(li_day(spark, sf), 30), 6)


def gauss_sql(name: str, source: str, k: int) -> str:
    """CTEs that solve the systems ``m`` (rows of k coefficients and a right side) of ``source`` (series_id, m) by elimination."""
    row = "list_transform(m[i + 1], lambda v: v / m[i + 1][i + 1])"
    return f"""{name}_g(series_id, i, m) AS (SELECT series_id, 0, m FROM {source}
  UNION ALL SELECT series_id, i + 1, list_transform(range(1, {k + 1}), lambda r: CASE WHEN r = i + 1 THEN {row}
    ELSE list_transform(range(1, {k + 2}), lambda c: m[r][c] - m[r][i + 1] * m[i + 1][c] / m[i + 1][i + 1]) END) FROM {name}_g WHERE i < {k}),
{name} AS (SELECT series_id, list_transform(m, lambda r: r[{k + 1}]) AS b FROM {name}_g WHERE i = {k})"""


KNOT = 5
BASIS = ["1", "t", *[f"greatest(t - CAST({(i + 1) / (KNOT + 1)!r} AS DOUBLE), 0)" for i in range(KNOT)]]
_MOMENTS = ", ".join("[" + ", ".join(
    [f"avg({x} * {y})" + (f" + CAST({fc.RIDGE!r} AS DOUBLE)" if i == j else "") for j, y in enumerate(BASIS)] + [f"avg({x} * value)"]) + "]"
    for i, x in enumerate(BASIS))


@query("forecast_trend_changepoints", rsql(f"""WITH RECURSIVE {LI}, n AS (SELECT series_id, max(pos) AS last_pos FROM li GROUP BY ALL),
x AS (SELECT li.*, CAST(pos AS DOUBLE) / last_pos AS t FROM li JOIN n USING (series_id)), mom AS (SELECT series_id, [{_MOMENTS}] AS m FROM x GROUP BY ALL),
{gauss_sql('fit', 'mom', KNOT + 2)},
s AS (SELECT series_id, CAST(i AS BIGINT) AS step, last_pos + i AS pos, CAST(last_pos + i AS DOUBLE) / last_pos AS t, b FROM n JOIN fit USING (series_id), range(1, 31) g(i))
SELECT series_id, step, pos, {' + '.join(f'b[{i + 1}] * {x}' for i, x in enumerate(BASIS))} AS predicted FROM s""", "predicted", 4))
def forecast_trend_changepoints(spark, sf):
    return _show(fc.forecast_trend(li_day(spark, sf), 30, changepoints=KNOT), 4)


@query("forecast_trend_sparse")
def forecast_trend_sparse(spark, sf):
    """Up to 25 changes of slope, kept where they pay."""
    return _show(fc.forecast_trend(li_day(spark, sf), 30, changepoints=25, penalty=1.0), 4)


@query("zscore", rsql(f"""WITH {DEG}, z AS (SELECT series_id, avg(value) AS mu, stddev_samp(value) AS s FROM deg GROUP BY ALL)
SELECT series_id, pos, (value - mu) / CASE WHEN s > 0 THEN s ELSE 1 END AS value FROM deg JOIN z USING (series_id)""", "value", 8))
def zscore(spark, sf):
    return rounded(fc.zscore(ev_deg(spark, sf))[0].select("series_id", "pos", "value"), 8)


@query("unzscore", _fsql("y"))
def unzscore(spark, sf):
    scaled, stats = fc.zscore(ev_deg(spark, sf))
    return _show(fc.unzscore(fc.forecast_last_value(scaled, H), stats))


@query("lag_features", rsql(f"""WITH {LI}, l AS (SELECT series_id, pos, value AS y, {', '.join(f'lag(value, {i}) OVER w AS lag_{i}' for i in range(1, 6))}
  FROM li WINDOW w AS (PARTITION BY series_id ORDER BY pos)) SELECT * FROM l WHERE pos >= 5""", "y lag_1 lag_2 lag_3 lag_4 lag_5", 8))
def lag_features(spark, sf):
    return rounded(fc.lag_features(li_day(spark, sf), 5, block=64), 8)


@query("finite_guard_fallback", _fsql("CASE WHEN CAST(series_id AS INTEGER) % 3 = 0 THEN y ELSE y + step * (y - y10) / (k - 1) END"))
def finite_guard_fallback(spark, sf):
    d = ev_deg(spark, sf)
    broken = fc.forecast_drift10(d, H).withColumn(
        "predicted", F.when((F.col("series_id").cast("int") % 3 == 0) & (F.col("step") == 4), F.lit(float("nan"))).otherwise(F.col("predicted")))
    return _show(fc.finite_guard_fallback(broken, fc.forecast_last_value(d, H)))


def _sources(spark, sf):
    return fc.forecast_sources(train_12(spark, sf), rp.reconstruct(ev_deg(spark, sf), ["linear"]))


@query("forecast_sources", rsql(f"""WITH {DEG}, {KNOTS}, s0 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev)
SELECT 'original' AS source_type, series_id, NULL AS model, pos, value FROM s0 WHERE pos < CASE WHEN n > 12 THEN n - 12 ELSE n - greatest(1, n // 5) END
UNION ALL SELECT 'reconstructed', series_id, 'linear', pos, coalesce(value, {_line('pos')}) FROM kn""", "value", 8))
def forecast_sources(spark, sf):
    return rounded(_sources(spark, sf).select("source_type", "series_id", "model", "pos", "value"), 8)


@query("forecast", rsql(f"""WITH {DEG}, {KNOTS}, s0 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev),
src AS (SELECT 'original' AS source_type, series_id, NULL AS model, pos, value FROM s0 WHERE pos < CASE WHEN n > 12 THEN n - 12 ELSE n - greatest(1, n // 5) END
  UNION ALL SELECT 'reconstructed', series_id, 'linear', pos, coalesce(value, {_line('pos')}) FROM kn),
q AS (SELECT source_type, series_id, model, max(pos) AS last_pos, max_by(value, pos) FILTER (value IS NOT NULL) AS y FROM src GROUP BY ALL),
q2 AS (SELECT source_type, series_id, max_by(s.value, s.pos) AS y2 FROM (SELECT *, row_number() OVER (PARTITION BY source_type, series_id ORDER BY pos DESC) AS b
  FROM src WHERE value IS NOT NULL) s WHERE b = 2 GROUP BY ALL)
SELECT source_type, series_id, model, m AS prediction_model, CAST(i AS BIGINT) AS step, last_pos + i AS pos,
  CASE m WHEN 'last_value' THEN y ELSE y + i * (y - y2) END AS predicted
FROM q JOIN q2 USING (source_type, series_id), (VALUES ('last_value'), ('last_diff')) v(m), range(1, 6) g(i)""", "predicted", 8))
def forecast(spark, sf):
    out = fc.forecast(_sources(spark, sf), ["last_value", "last_diff"], 5)
    return rounded(out.select("source_type", "series_id", "model", "prediction_model", "step", "pos", "predicted"), 8)


def _all_models_sql() -> str:
    """Every closed form on original and repaired sources; a source is a series of its own."""
    src = f"""{DEG}, {KNOTS}, s0 AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev),
src AS (SELECT 'original|' || series_id AS series_id, pos, value FROM s0 WHERE pos < CASE WHEN n > 12 THEN n - 12 ELSE n - greatest(1, n // 5) END
  UNION ALL SELECT 'reconstructed|' || series_id, pos, coalesce(value, {_line('pos')}) FROM kn)""".replace("ev AS (", "RECURSIVE ev AS (", 1)
    states = ", ".join([STATE, EW[len(BASE) + 2:], DE[len("RECURSIVE ") + len(BASE) + 2:], "hv AS (SELECT series_id, r, value AS v FROM o)", _holt_cte("hv"),
                        ARI[len(EW) + 2:], "tl AS (SELECT series_id, regr_slope(value, pos) AS ts, regr_intercept(value, pos) AS tc FROM deg GROUP BY ALL)"])
    forms = {
        "last_value": "y", "drift10": "CASE WHEN k >= 2 THEN y + step * (y - y10) / (k - 1) ELSE y END", "last_diff": DIFF2,
        "secant10": f"CASE WHEN m >= 5 THEN y + step * (y - y10) / CAST(k AS DOUBLE) ELSE {DIFF2} END", "exp_weighted_drift": _EWX,
        "double_exp20": f"CASE WHEN m >= 5 THEN dl.level + step * dl.trend ELSE {DIFF2} END",
        "holt": "CASE WHEN m >= 2 THEN hl.level + step * hl.trend ELSE y END",
        "ari1": f"coalesce(CASE WHEN m >= 5 THEN y + step * mn + (y - y2 - mn) * phi * (1 - pow(phi, step)) / (1 - phi) END, {_EWX})",
        "trend": "tc + ts * (last_pos + step)",
    }
    case = " ".join(f"WHEN '{name}' THEN {form}" for name, form in forms.items())
    return f"""WITH {src}, {states.replace('FROM deg', 'FROM src')}
SELECT split_part(series_id, '|', 1) AS source_type, split_part(series_id, '|', 2) AS series_id, pm AS prediction_model, step, last_pos + step AS pos,
  CASE pm {case} END AS predicted
FROM steps LEFT JOIN ew USING (series_id) LEFT JOIN dl USING (series_id) LEFT JOIN hl USING (series_id) LEFT JOIN ari USING (series_id) JOIN tl USING (series_id),
  (VALUES {', '.join(f"('{name}')" for name in forms)}) v(pm)"""


@query("forecast_all_models", rsql(_all_models_sql(), "predicted", 5))
def forecast_all_models(spark, sf):
    """All closed-form forecasters over original and repaired sources."""
    out = fc.forecast(_sources(spark, sf), list(fc.FORECASTERS), H)
    return rounded(out.select("source_type", "series_id", "prediction_model", "step", "pos", "predicted"), 5)


@query("clean_train_allowlist", rsql(f"WITH {EXTERNAL} SELECT series_id, pos, value FROM medium", "value", 4).replace(
    "SELECT series_id, pos", "SELECT 'with_clean' AS series_id, pos").replace("FROM medium", "FROM medium WHERE pos < n - 50"))
def clean_train_allowlist(spark, sf):
    degraded, _, train, _ = _external(spark, sf)
    out = fc.clean_train_allowlist(train, degraded.select("series_id", "has_clean_train").distinct())
    return rounded(out.select("series_id", "pos", "value"), 4)


# ---- learners --------------------------------------------------------------------------------------

LAGS = 5


def _ols_sql(lags: int, source: str, name: str = "ols") -> str:
    """Least squares of a value on its lags over all series of ``source``: normal equations by elimination."""
    xs = ["1", *[f"lag_{i}" for i in range(1, lags + 1)]]
    moments = ", ".join("[" + ", ".join([f"sum(CAST({x} AS DOUBLE) * {y})" for y in xs] + [f"sum({x} * y)"]) + "]" for x in xs)
    return f"""lg AS (SELECT series_id, pos, value AS y, {', '.join(f'lag(value, {i}) OVER w AS lag_{i}' for i in range(1, lags + 1))}
  FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
nm AS (SELECT 'all' AS series_id, [{moments}] AS m FROM lg WHERE pos >= {lags} AND y + {' + '.join(xs)} IS NOT NULL), {gauss_sql(name, 'nm', lags + 1)}"""


def _roll_sql(lags: int, source: str, h: str, name: str = "ols") -> str:
    """The recursion of a linear model from the last values of each series; ``h``: steps, or a column of ``source``."""
    value = "b[1] + " + " + ".join(f"b[{i + 1}] * hist[{lags + 1 - i}]" for i in range(1, lags + 1))
    return f"""hs AS (SELECT series_id, (list(value ORDER BY pos) FILTER (value IS NOT NULL))[-{lags}:] AS hist, max(pos) AS last_pos FROM {source} GROUP BY series_id),
roll(series_id, step, last_pos, hist, predicted) AS (SELECT series_id, CAST(0 AS BIGINT), last_pos, hist, CAST(NULL AS DOUBLE) FROM hs
  UNION ALL SELECT roll.series_id, step + 1, last_pos, list_append(hist[2:], {value}), {value} FROM roll, {name} WHERE step < {h})"""


@query("linear_lag_model", rsql(f"""WITH RECURSIVE {LI}, {_ols_sql(LAGS, 'li')}, {_roll_sql(LAGS, 'li', '12')}
SELECT series_id, step, last_pos + step AS pos, predicted FROM roll WHERE step > 0""", "predicted", 4))
def linear_lag_model(spark, sf):
    features = stored(spark, sf, "li_lags", lambda: fc.lag_features(li_day(spark, sf), LAGS))
    model = fc.train_global_lag_model(features, learner="linear")
    return _show(fc.forecast_recursive(model, li_day(spark, sf), 12, LAGS), 4)


def _counters(spark, sf):
    """Per user a counter that wraps at five, shifted by the user: one model over all series can learn it exactly."""
    return stored(spark, sf, "counters", lambda: ev_user(spark, sf).select(
        "series_id", "pos", "ts", "x", ((F.col("pos") + F.col("series_id").cast("long")) % 5).cast("double").alias("value")))


_COUNT = f"""{EV}, n AS (SELECT series_id, count(*) AS n FROM ev GROUP BY ALL)
SELECT series_id, {{}}CAST(i AS BIGINT) AS step, CAST((n + i - 1 + CAST(series_id AS BIGINT)) % 5 AS DOUBLE) AS predicted FROM n, range(1, 13) g(i)"""


@query("boosted_lag_model", rsql("WITH " + _COUNT.format(""), "predicted", 1))
def boosted_lag_model(spark, sf):
    """The library's boosting (100 trees of depth 6 on 10 lags) over all series, stopped early by the last fifth of each."""
    features = stored(spark, sf, "counter_lags", lambda: fc.lag_features(cl.train_val_split(_counters(spark, sf)), 10))
    model = fc.train_global_lag_model(features, tolerance=0.0)
    return rounded(fc.forecast_recursive(model, _counters(spark, sf), 12).select("series_id", "step", "predicted"), 1)


@query("replicate_forecasts", rsql("WITH " + _COUNT.format("m AS prediction_model, CAST(k AS INTEGER) AS prediction_iteration, ").replace(
    "range(1, 13) g(i)", "range(1, 13) g(i), (VALUES ('boosting', 1), ('boosting', 2), ('boosting', 3)) v(m, k)"), "predicted", 1))
def replicate_forecasts(spark, sf):
    """Three replicates of a seeded learner."""
    features = fc.lag_features(_counters(spark, sf), 5)
    models, _ = fc.fit_replicates(features, ["boosting"], 3, trees=30, depth=5, lr=0.3)
    out, states = None, fc.histories(_counters(spark, sf), 12, 5)
    for (name, i), model in models.items():
        part = fc.forecast_recursive(model, _counters(spark, sf), 12, 5, name=name, iteration=i, states=states)
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("series_id", "prediction_model", "prediction_iteration", "step", "predicted"), 1)


PERIOD = 6


@query("per_series_boosting", rsql(f"""WITH {EV}, n AS (SELECT series_id, count(*) AS n FROM ev GROUP BY ALL)
SELECT series_id, CAST(i AS BIGINT) AS step, value AS predicted FROM n JOIN ev USING (series_id), range(1, 13) g(i) WHERE pos = (n + i - 1) % {PERIOD}""", "predicted", 3))
def per_series_boosting(spark, sf):
    """The first values of each user, repeated: only a model of its own continues every series."""
    points = stored(spark, sf, "repeated", lambda: ev_user(spark, sf).select("series_id", "pos", "value").join(
        ev_user(spark, sf).where(F.col("pos") < PERIOD).select("series_id", F.col("pos").alias("_p"), F.col("value").alias("_v")), "series_id"
    ).where(F.col("pos") % PERIOD == F.col("_p")).select("series_id", "pos", F.col("_v").alias("value")))
    model = per_series(points, lr=0.3)
    return rounded(fc.forecast_recursive(model, points, 12).select("series_id", "step", "predicted"), 3)


@query("per_series_boosting_days")
def per_series_boosting_days(spark, sf):
    """Daily revenue with the library's parameters, trees kept by the last fifth of each series."""
    split = cl.train_val_split(li_day(spark, sf))
    return _show(fc.forecast_recursive(per_series(split), li_day(spark, sf), 12), 2)


@query("training_metrics")
def training_metrics(spark, sf):
    """Trees kept and losses of each series."""
    split = cl.train_val_split(li_day(spark, sf))
    return rounded(per_series(split).select("series_id", "epochs_trained", "best_val_loss", "final_train_loss"), 3)
