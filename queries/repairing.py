"""Gap repair queries: each method on user series with 20 % of the values masked."""

from __future__ import annotations

from pyspark.sql import functions as F

from mendcast.layout import with_neighbours
from mendcast.operators import repair as rp
from queries import query
from queries.fixtures import DEG, DEG_KEYS, EVH, ev_deg, ev_hour, rounded, rsql

# nearest observed knots of each row: l1..l3 before (nearest first), r1..r3 after
KNOTS = """obs AS (SELECT series_id, pos, x, value AS v,
  lag(pos) OVER w AS p_1, lag(x) OVER w AS x_1, lag(value) OVER w AS v_1,
  lag(pos, 2) OVER w AS p_2, lag(x, 2) OVER w AS x_2, lag(value, 2) OVER w AS v_2,
  lead(pos) OVER w AS n_1, lead(x) OVER w AS y_1, lead(value) OVER w AS u_1,
  lead(pos, 2) OVER w AS n_2, lead(x, 2) OVER w AS y_2, lead(value, 2) OVER w AS u_2
  FROM deg WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
nb AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos) AS lp,
  first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rp FROM deg),
kn AS (SELECT nb.*, l.pos AS l1p, l.x AS l1x, l.v AS l1v, l.p_1 AS l2p, l.x_1 AS l2x, l.v_1 AS l2v,
  l.p_2 AS l3p, l.x_2 AS l3x, l.v_2 AS l3v, r.pos AS r1p, r.x AS r1x, r.v AS r1v,
  r.n_1 AS r2p, r.y_1 AS r2x, r.u_1 AS r2v, r.n_2 AS r3p, r.y_2 AS r3x, r.u_2 AS r3v
  FROM nb LEFT JOIN obs l ON l.series_id = nb.series_id AND l.pos = nb.lp
  LEFT JOIN obs r ON r.series_id = nb.series_id AND r.pos = nb.rp)"""

OUT = "series_id, pos"


def _filled_sql(expr: str, with_cte: str = f"{DEG}, {KNOTS}", source: str = "kn", dp: int = 8) -> str:
    return rsql(f"WITH {with_cte} SELECT {OUT}, coalesce(value, {expr}) AS value FROM {source}", "value", dp)


def _register(name: str, fn, sql: str, dp: int = 8):
    @query(name, sql)
    def run(spark, sf):
        return rounded(fn(ev_deg(spark, sf)).select("series_id", "pos", "value"), dp)


_register("impute_mean", rp.impute_mean, _filled_sql("avg(value) OVER (PARTITION BY series_id)", DEG, "deg"))
_register("impute_knn", rp.impute_knn, _filled_sql("avg(value) OVER (PARTITION BY series_id)", DEG, "deg"))
_register("impute_median", rp.impute_median, _filled_sql("median(value) OVER (PARTITION BY series_id)", DEG, "deg"))
_register(
    "impute_mode", rp.impute_mode,
    _filled_sql("m.mode", f"""{DEG}, cnt AS (SELECT series_id, value, count(*) AS c FROM deg WHERE value IS NOT NULL GROUP BY ALL),
  md AS (SELECT series_id AS sid, value AS mode FROM cnt QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY c DESC, value) = 1)""",
                "deg LEFT JOIN md m ON m.sid = deg.series_id"),
)
_register("impute_ffill", rp.impute_ffill, _filled_sql("l1v"))
_register("impute_bfill", rp.impute_bfill, _filled_sql("r1v"))


def _line(axis: str) -> str:
    h = "x" if axis == "x" else "pos"
    k = "x" if axis == "x" else "p"
    return (f"CASE WHEN l1v IS NULL THEN NULL WHEN r1v IS NULL THEN l1v "
            f"ELSE l1v + (r1v - l1v) / CAST(r1{k} - l1{k} AS DOUBLE) * ({h} - l1{k}) END")


_register("interpolate_linear", rp.interpolate_linear, _filled_sql(_line("pos")))
_register("interpolate_linear_both", rp.interpolate_linear_both, _filled_sql(f"coalesce({_line('pos')}, r1v, 0)"))
_register("interpolate_index", rp.interpolate_index, _filled_sql(_line("x")))
_register(
    "interpolate_nearest", rp.interpolate_nearest,
    _filled_sql("CASE WHEN l1v IS NOT NULL AND r1v IS NOT NULL THEN CASE WHEN x - l1x <= r1x - x THEN l1v ELSE r1v END END"),
)


def _sec(a: str, b: str, k: str = "x") -> str:
    return f"(({b}v - {a}v) / CAST({b}{k} - {a}{k} AS DOUBLE))"


def _herm(a, b, da, db):
    h = f"({b}x - {a}x)"
    t = f"((x - {a}x) / {h})"
    return (f"((1 + 2 * {t}) * (1 - {t}) * (1 - {t}) * {a}v + {t} * (1 - {t}) * (1 - {t}) * {h} * ({da}) "
            f"+ {t} * {t} * (3 - 2 * {t}) * {b}v + {t} * {t} * ({t} - 1) * {h} * ({db}))")


def _pin(p, k, n):
    h0, h1 = f"({k}x - {p}x)", f"({n}x - {k}x)"
    d0, d1 = _sec(p, k), _sec(k, n)
    return (f"CASE WHEN {d0} * {d1} <= 0 THEN 0 ELSE (3 * {h0} + 3 * {h1}) / ((2 * {h1} + {h0}) / {d0} "
            f"+ ({h1} + 2 * {h0}) / {d1}) END")


def _pend(k, a, b):
    h0, h1 = f"abs({a}x - {k}x)", f"abs({b}x - {a}x)"
    d0, d1 = _sec(k, a), _sec(a, b)
    m = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
    return (f"CASE WHEN {b}v IS NULL THEN {d0} WHEN sign({m}) <> sign({d0}) THEN 0 "
            f"WHEN sign({d0}) <> sign({d1}) AND abs({m}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {m} END")


_pchip_inner = _herm(
    "l1", "r1",
    f"CASE WHEN l2v IS NULL THEN {_pend('l1', 'r1', 'r2')} ELSE {_pin('l2', 'l1', 'r1')} END",
    f"CASE WHEN r2v IS NULL THEN {_pend('r1', 'l1', 'l2')} ELSE {_pin('l1', 'r1', 'r2')} END",
)
_pchip_tail = _herm("l2", "l1", f"CASE WHEN l3v IS NULL THEN {_sec('l2', 'l1')} ELSE {_pin('l3', 'l2', 'l1')} END",
                    _pend("l1", "l2", "l3"))
# extrapolated tails reach large magnitudes, hence fewer decimals
_register(
    "interpolate_pchip", rp.interpolate_pchip,
    _filled_sql(f"CASE WHEN l1v IS NULL THEN NULL WHEN r1v IS NOT NULL THEN {_pchip_inner} "
                f"WHEN l2v IS NULL THEN l1v ELSE {_pchip_tail} END", dp=4), 4,
)

_AK = """ak0 AS (SELECT *, (r1v - l1v) / (r1x - l1x) AS s0, (l1v - l2v) / (l1x - l2x) AS a1, (l2v - l3v) / (l2x - l3x) AS a2,
  (r2v - r1v) / (r2x - r1x) AS b1, (r3v - r2v) / (r3x - r2x) AS b2 FROM kn),
ak1 AS (SELECT *, coalesce(a1, 2 * s0 - b1, s0) AS c1, coalesce(b1, 2 * s0 - a1, s0) AS d1 FROM ak0),
ak AS (SELECT *, coalesce(a2, 2 * c1 - s0) AS c2, coalesce(b2, 2 * d1 - s0) AS d2 FROM ak1)"""


def _aslope(m1, m2, m3, m4):
    return (f"CASE WHEN abs({m4} - {m3}) + abs({m2} - {m1}) > 0 THEN (abs({m4} - {m3}) * {m2} + abs({m2} - {m1}) * {m3}) "
            f"/ (abs({m4} - {m3}) + abs({m2} - {m1})) ELSE ({m2} + {m3}) / 2 END")


_register(
    "interpolate_akima", rp.interpolate_akima,
    _filled_sql(
        "CASE WHEN l1v IS NOT NULL AND r1v IS NOT NULL THEN "
        + _herm("l1", "r1", _aslope("c2", "c1", "s0", "d1"), _aslope("c1", "s0", "d1", "d2")) + " END",
        f"{DEG}, {KNOTS}, {_AK}", "ak",
    ),
)


def _lagr(left: int, total: int) -> str:
    """List-based Lagrange by position over ``left`` knots before and the rest after, shifted at the edges."""
    kl = ("list_filter([{'p': l3p, 'v': l3v}, {'p': l2p, 'v': l2v}, {'p': l1p, 'v': l1v}], lambda k: k.v IS NOT NULL)")
    kr = ("list_filter([{'p': r1p, 'v': r1v}, {'p': r2p, 'v': r2v}, {'p': r3p, 'v': r3v}], lambda k: k.v IS NOT NULL)")
    return f"""{DEG}, {KNOTS}, lr0 AS (SELECT *, {kl} AS kl, {kr} AS kr FROM kn),
lr1 AS (SELECT *, least(len(kl), greatest({left}, {total} - len(kr))) AS tl FROM lr0),
lr AS (SELECT *, list_concat(kl[len(kl) - tl + 1:], kr[:least(len(kr), {total} - tl)]) AS ks FROM lr1)"""


_LAGR = """CASE WHEN l1v IS NOT NULL AND r1v IS NOT NULL THEN list_sum(list_transform(ks, lambda k: k.v *
  list_product(list_transform(ks, lambda j: CASE WHEN j.p = k.p THEN CAST(1 AS DOUBLE)
    ELSE CAST(pos - j.p AS DOUBLE) / CAST(k.p - j.p AS DOUBLE) END)))) END"""

_register("interpolate_quadratic", lambda d: rp.interpolate_quadratic(d, "pos"), _filled_sql(_LAGR, _lagr(2, 3), "lr"))
_register("interpolate_polynomial", lambda d: rp.interpolate_polynomial(d, "pos"), _filled_sql(_LAGR, _lagr(2, 3), "lr"))
_register("interpolate_cubic", lambda d: rp.interpolate_cubic(d, "pos"), _filled_sql(_LAGR, _lagr(2, 4), "lr"))
_register("interpolate_krogh", lambda d: rp.interpolate_krogh(d, "pos"), _filled_sql(_LAGR, _lagr(3, 6), "lr"))

_SPLINE = f"""{DEG}, {KNOTS}, sp0 AS (SELECT *, list(CASE WHEN value IS NOT NULL THEN {{'p': pos, 'v': value}} END)
  OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS raw FROM kn),
sp1 AS (SELECT *, list_filter(raw, lambda k: k IS NOT NULL) AS ks FROM sp0),
sp2 AS (SELECT *, len(ks) AS m, list_max(list_transform(ks, lambda k: abs(k.p - pos))) AS sc FROM sp1),
sp3 AS (SELECT *, CAST(m AS DOUBLE) AS s0,
  list_sum(list_transform(ks, lambda k: (k.p - pos) / CAST(sc AS DOUBLE))) AS s1,
  list_sum(list_transform(ks, lambda k: pow((k.p - pos) / CAST(sc AS DOUBLE), 2))) AS s2,
  list_sum(list_transform(ks, lambda k: pow((k.p - pos) / CAST(sc AS DOUBLE), 3))) AS s3,
  list_sum(list_transform(ks, lambda k: pow((k.p - pos) / CAST(sc AS DOUBLE), 4))) AS s4,
  list_sum(list_transform(ks, lambda k: k.v)) AS t0,
  list_sum(list_transform(ks, lambda k: k.v * (k.p - pos) / CAST(sc AS DOUBLE))) AS t1,
  list_sum(list_transform(ks, lambda k: k.v * pow((k.p - pos) / CAST(sc AS DOUBLE), 2))) AS t2 FROM sp2)"""
_register(
    "interpolate_spline", lambda d: rp.interpolate_spline(d, "pos", h=5),
    _filled_sql(
        """coalesce(CASE WHEN m >= 3 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
  / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))
  WHEN m = 2 THEN (t0 * s2 - s1 * t1) / (s0 * s2 - s1 * s1) WHEN m = 1 THEN t0 END, """ + _line("pos") + ")",
        _SPLINE, "sp3"),
)

_register(
    "impute_knn_temporal", rp.impute_knn_temporal,
    _filled_sql(
        "list_avg(list_transform(list_sort(list_filter([{'d': pos - l3p, 'p': l3p, 'v': l3v}, {'d': pos - l2p, 'p': l2p, 'v': l2v}, "
        "{'d': pos - l1p, 'p': l1p, 'v': l1v}, {'d': r1p - pos, 'p': r1p, 'v': r1v}, {'d': r2p - pos, 'p': r2p, 'v': r2v}, "
        "{'d': r3p - pos, 'p': r3p, 'v': r3v}], lambda k: k.v IS NOT NULL))[:3], lambda k: k.v))"),
)

_AR = f"""{DEG}, {KNOTS}, pr AS (SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS pv FROM deg),
fit AS (SELECT series_id AS sid, avg(value) AS mu, count(value) AS n,
  coalesce(greatest(least(CASE WHEN NOT isnan(regr_slope(value, pv)) THEN regr_slope(value, pv) END, 0.99), -0.99), 0) AS phi
  FROM pr GROUP BY series_id),
ar AS (SELECT *, CAST(pos - l1p AS DOUBLE) AS k, CAST(r1p - pos AS DOUBLE) AS m FROM kn JOIN fit ON sid = series_id)"""
_register(
    "impute_ar1_smoother", rp.impute_ar1_smoother,
    _filled_sql(
        """CASE WHEN n >= 3 THEN CASE WHEN l1v IS NOT NULL AND r1v IS NOT NULL THEN
  mu + (pow(phi, k) * (1 - pow(phi, 2 * m)) * (l1v - mu) + pow(phi, m) * (1 - pow(phi, 2 * k)) * (r1v - mu)) / (1 - pow(phi, 2 * (k + m)))
  WHEN l1v IS NOT NULL THEN mu + pow(phi, k) * (l1v - mu) ELSE mu + pow(phi, m) * (r1v - mu) END END""", _AR, "ar"),
)


@query("nearest_observed", rsql(f"WITH {DEG}, {KNOTS} SELECT {OUT}, l1p AS prev_pos, l1v AS prev_value, "
                                "r1p AS next_pos, r1v AS next_value FROM kn", "prev_value next_value"))
def nearest_observed(spark, sf):
    df = with_neighbours(ev_deg(spark, sf))
    return rounded(df.select(
        "series_id", "pos", F.col("prev.pos").alias("prev_pos"), F.col("prev.value").alias("prev_value"),
        F.col("next.pos").alias("next_pos"), F.col("next.value").alias("next_value"),
    ))


_NATURAL = EVH + ", " + KNOTS.replace("FROM deg WHERE", "FROM evh WHERE").replace("AS rp FROM deg)", "AS rp FROM evh)")


@query("repair_natural_gaps", rsql(f"WITH {_NATURAL} SELECT {OUT}, coalesce(value, {_line('x')}) AS value FROM kn", "value"))
def repair_natural_gaps(spark, sf):
    """Hourly series with real gaps, cut into small blocks so that gaps cross block edges."""
    return rounded(rp.interpolate_index(ev_hour(spark, sf), block=64).select("series_id", "pos", "value"))


REPAIR_SET = ("mean", "median", "mode", "ffill", "bfill", "linear", "index", "nearest")

_FILLS = {
    "mean": "avg(value) OVER (PARTITION BY series_id)", "median": "median(value) OVER (PARTITION BY series_id)",
    "ffill": "l1v", "bfill": "r1v", "linear": _line("pos"), "index": _line("x"),
    "nearest": "CASE WHEN l1v IS NOT NULL AND r1v IS NOT NULL THEN CASE WHEN x - l1x <= r1x - x THEN l1v ELSE r1v END END",
}
REP = DEG + ", " + KNOTS + ", rep AS (" + " UNION ALL ".join(
    f"SELECT series_id, technique, rate_percent, iteration, '{m}' AS model, pos, ts, x, value IS NULL AS masked, truth, "
    f"coalesce(value, {e}) AS value FROM kn" for m, e in _FILLS.items()
) + ")"
REP_MODELS = tuple(_FILLS)


@query("reconstruct_models", rsql(f"WITH {REP} SELECT series_id, model, pos, value FROM rep", "value", 8))
def reconstruct_models(spark, sf):
    return rounded(rp.reconstruct(ev_deg(spark, sf), REP_MODELS).select("series_id", "model", "pos", "value"), 8)


@query("unfilled_points", f"WITH {REP} SELECT {DEG_KEYS}, model, count(*) FILTER (value IS NULL) AS n_unfilled, "
                          "count(*) AS n_total FROM rep GROUP BY ALL")
def unfilled_points(spark, sf):
    return rp.unfilled_report(rp.reconstruct(ev_deg(spark, sf), REP_MODELS))


@query("merge_keep_observed", rsql(f"WITH {DEG} SELECT {OUT}, coalesce(value, 0) AS value FROM deg", "value"))
def merge_keep_observed(spark, sf):
    df = ev_deg(spark, sf)
    return rounded(df.select("series_id", "pos", rp.merge_keep_observed("value", F.lit(0.0)).alias("value")))
