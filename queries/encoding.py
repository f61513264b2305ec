"""Series as matrices: user series resampled to 64 values, spectrograms with the library's own window."""

from pyspark.sql import functions as F

from mendcast.operators import encode as en, repair as rp
from queries import query
from queries.repairing import KNOTS, _line
from queries.fixtures import DEG, EV, ev_deg, ev_user, li_day, rounded, rsql, stored, LI

N = 64
RES = f"""{EV}, cn AS (SELECT series_id, count(*) AS n FROM ev GROUP BY ALL),
tg AS (SELECT series_id, n, CAST(i AS INTEGER) AS i, i * ((n - 1) / CAST({N - 1} AS DOUBLE)) AS s FROM cn, range(0, {N}) g(i)),
tf AS (SELECT *, least(CAST(floor(s) AS BIGINT), greatest(n - 2, 0)) AS b FROM tg),
res AS (SELECT tf.series_id, tf.i, l.value * (1 - (s - b)) + coalesce(h.value * (s - b), 0) AS value FROM tf
  JOIN ev l ON l.series_id = tf.series_id AND l.pos = b LEFT JOIN ev h ON h.series_id = tf.series_id AND h.pos = b + 1),
mm AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM res GROUP BY ALL)"""
CELLS = "a.series_id, a.i AS i, b.i AS j"
PAIRED = "u a JOIN u b ON a.series_id = b.series_id"


@query("resample_linear", rsql(f"WITH {RES} SELECT series_id, i, value FROM res", "value", 8))
def resample_linear(spark, sf):
    return rounded(en.resample_linear(ev_user(spark, sf), N).select("series_id", "i", "value"), 8)


GAF = f"{RES}, u AS (SELECT series_id, i, CASE WHEN hi > lo THEN greatest(least((value - lo) / (hi - lo) * 2 - 1, 1), -1) ELSE 0 END AS v FROM res JOIN mm USING (series_id))"
_GAF = "a.v * b.v - sqrt(greatest(1 - a.v * a.v, 0)) * sqrt(greatest(1 - b.v * b.v, 0))"


@query("encode_gaf", rsql(f"WITH {GAF} SELECT {CELLS}, {_GAF} AS v FROM {PAIRED}", "v"))
def encode_gaf(spark, sf):
    return rounded(en.encode_gaf(ev_user(spark, sf), N))


@query("encode_mtf", f"""WITH {RES}, u AS (SELECT series_id, i, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 8), 7) ELSE 0 END AS v FROM res JOIN mm USING (series_id))
SELECT {CELLS}, CAST(CASE WHEN a.v = b.v THEN 1 ELSE 0 END AS DOUBLE) AS v FROM {PAIRED}""")
def encode_mtf(spark, sf):
    return en.encode_mtf(ev_user(spark, sf), N)


RP = f"""{RES}, u0 AS (SELECT series_id, i, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END AS v FROM res JOIN mm USING (series_id)),
u AS (SELECT *, CAST(0.1 AS DOUBLE) * stddev_pop(v) OVER (PARTITION BY series_id) AS eps FROM u0),
rp AS (SELECT {CELLS}, CAST(CASE WHEN abs(a.v - b.v) < a.eps THEN 1 ELSE 0 END AS DOUBLE) AS v FROM {PAIRED})"""


@query("encode_rp", f"WITH {RP} SELECT * FROM rp")
def encode_rp(spark, sf):
    return en.encode_rp(ev_user(spark, sf), N)


M = 256  # the default window of these series: min(256, a quarter of the length)
HOP = M - M // 8
SPEC = f"""{LI}, ln AS (SELECT series_id, count(*) AS n FROM li GROUP BY ALL),
wd AS (SELECT li.series_id, CAST(j AS INTEGER) AS j, li.pos - j * {HOP} AS k, li.value FROM li JOIN ln USING (series_id), range(0, 100000) g(j)
  WHERE li.pos >= j * {HOP} AND li.pos < j * {HOP} + {M} AND j * {HOP} + {M} <= n),
wm AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id, j) AS c, 0.5 - 0.5 * cos(2 * pi() * k / {M}) AS h FROM wd),
fq AS (SELECT series_id, CAST(f AS INTEGER) AS i, j, sum(c * h * cos(2 * pi() * ((k * f) % {M}) / {M})) AS re, sum(c * h * sin(2 * pi() * ((k * f) % {M}) / {M})) AS im,
  sum(h * h) AS e FROM wm, range(0, {M // 2 + 1}) q(f) GROUP BY ALL),
spec AS (SELECT series_id, i, j, 10 * log10((re * re + im * im) * CASE WHEN i = 0 OR i = {M // 2} THEN 1 ELSE 2 END / e + CAST(1e-10 AS DOUBLE)) AS v FROM fq)"""


@query("encode_spectrogram", rsql(f"WITH {SPEC} SELECT * FROM spec", "v", 5))
def encode_spectrogram(spark, sf):
    return rounded(en.encode_spectrogram(li_day(spark, sf)), 5)


@query("encode_mask", f"""WITH {DEG}, c AS (SELECT series_id, count(*) AS n FROM deg GROUP BY ALL),
sp AS (SELECT DISTINCT deg.series_id, CAST(floor(pos * {N} / n) AS INTEGER) AS s FROM deg JOIN c USING (series_id) WHERE value IS NULL)
SELECT c.series_id, CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, CAST(CASE WHEN EXISTS (SELECT 1 FROM sp WHERE sp.series_id = c.series_id AND (sp.s = a OR sp.s = b)) THEN 1 ELSE 0 END AS DOUBLE) AS v
FROM c, range(0, {N}) x(a), range(0, {N}) y(b)""")
def encode_mask(spark, sf):
    return en.encode_mask(ev_deg(spark, sf), N).select("series_id", "i", "j", "v")


@query("scale_to_uint8", f"""WITH {GAF}, m AS (SELECT {CELLS}, {_GAF} AS v FROM {PAIRED}), r AS (SELECT *, min(v) OVER (PARTITION BY series_id) AS lo, max(v) OVER (PARTITION BY series_id) AS hi FROM m)
SELECT series_id, i, j, CAST(CASE WHEN hi > lo THEN floor(round((v - lo) / (hi - lo) * 255, 6)) ELSE 0 END AS INTEGER) AS v FROM r""")
def scale_to_uint8(spark, sf):
    return en.scale_to_uint8(stored(spark, sf, "gaf", lambda: en.encode_gaf(ev_user(spark, sf), N)))


def _stretch_sql(profile: str, low: str, span: str) -> str:
    """Profile (series_id, i, v) stretched over the positions of ev."""
    return f"""rg AS (SELECT series_id, count(*) AS n, min(value) AS lo, max(value) AS hi FROM ev GROUP BY ALL), pf AS ({profile}), pn AS (SELECT series_id, count(*) AS m FROM pf GROUP BY ALL),
att AS (SELECT ev.series_id, ev.pos, lo, hi, ev.pos * (m - 1) / CAST(n - 1 AS DOUBLE) AS s FROM ev JOIN rg USING (series_id) JOIN pn USING (series_id)),
ab AS (SELECT att.*, a.v AS a, coalesce(b.v, a.v) AS b FROM att JOIN pf a ON a.series_id = att.series_id AND a.i = CAST(floor(s) AS INTEGER)
  LEFT JOIN pf b ON b.series_id = att.series_id AND b.i = CAST(floor(s) AS INTEGER) + 1)
SELECT series_id, pos, CASE WHEN hi > lo THEN (a + (b - a) * (s - floor(s)) - {low}) / {span} * (hi - lo) + lo ELSE lo END AS value FROM ab"""


@query("decode_diagonal", rsql(f"WITH {GAF}, " + _stretch_sql("SELECT series_id, i, cos(v * v - sqrt(greatest(1 - v * v, 0)) * sqrt(greatest(1 - v * v, 0))) AS v FROM u", "(-1)", "2"), "value"))
def decode_diagonal(spark, sf):
    matrix = stored(spark, sf, "gaf", lambda: en.encode_gaf(ev_user(spark, sf), N))
    return rounded(en.decode_diagonal(matrix, ev_user(spark, sf), cosine=True).select("series_id", "pos", "value"))


@query("decode_row_mean", rsql(f"WITH {RP}, " + _stretch_sql("SELECT series_id, i, avg(v) AS v FROM rp GROUP BY ALL", "0", "1"), "value"))
def decode_row_mean(spark, sf):
    matrix = en.encode_rp(ev_user(spark, sf), N)
    return rounded(en.decode_row_mean(matrix, ev_user(spark, sf)).select("series_id", "pos", "value"))


@query("decode_column_mean", rsql(f"WITH {SPEC}, " + _stretch_sql(
    "SELECT series_id, j AS i, (c - min(c) OVER (PARTITION BY series_id)) / (max(c) OVER (PARTITION BY series_id) - min(c) OVER (PARTITION BY series_id)) AS v "
    "FROM (SELECT series_id, j, avg(v) AS c FROM spec GROUP BY ALL)", "0", "1").replace("FROM ev GROUP", "FROM li GROUP").replace("FROM ev JOIN", "FROM li ev JOIN"), "value", 5))
def decode_column_mean(spark, sf):
    matrix = en.encode_spectrogram(li_day(spark, sf))
    return rounded(en.decode_column_mean(matrix, li_day(spark, sf)).select("series_id", "pos", "value"), 5)


FILLED = f"""{DEG}, {KNOTS}, fl AS (SELECT series_id, pos, coalesce(value, {_line('pos')}, r1v, 0) AS value FROM kn)"""
_FILLED = FILLED + GAF[len(EV):].replace("FROM ev GROUP", "FROM fl GROUP").replace("JOIN ev ", "JOIN fl ")


@query("encode_degraded_gaf", f"""WITH {_FILLED}, m AS (SELECT {CELLS}, {_GAF} AS v FROM {PAIRED}),
r AS (SELECT *, min(v) OVER (PARTITION BY series_id) AS lo, max(v) OVER (PARTITION BY series_id) AS hi FROM m)
SELECT series_id, i, j, CAST(CASE WHEN hi > lo THEN floor(round((v - lo) / (hi - lo) * 255, 6)) ELSE 0 END AS INTEGER) AS v FROM r""")
def encode_degraded_gaf(spark, sf):
    """Data preparation of the image methods: both-sided linear fill, encoding, 8-bit scaling."""
    filled = rp.interpolate_linear_both(ev_deg(spark, sf))
    return en.scale_to_uint8(en.encode_gaf(filled, N)).select("series_id", "i", "j", "v")
