"""Grid and masking queries on the user series."""

from pyspark.sql import functions as F

from mendcast.functions.draws import uniform_draw
from mendcast.operators import grid as gr, mask
from queries import query
from queries.fixtures import DEG_GRID, EV, SEED, ev_grid, ev_user, grid_for, masked_sql, rounded, rsql, table

IDS = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_id FROM events"
GRID = f"""grid AS (SELECT series_id, t.technique, r.rate, CAST(round(r.rate * 100) AS INTEGER) AS rate_percent, i.iteration,
  CAST({SEED} AS BIGINT) AS seed FROM ({IDS}), (VALUES ('MCAR'), ('MAR'), ('MNAR')) t(technique),
  (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.29 AS DOUBLE)), (CAST(0.57 AS DOUBLE))) r(rate), (VALUES (1), (2)) i(iteration))"""


def _grid(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("series_id"))
    return gr.experiment_grid(ids, ("MCAR", "MAR", "MNAR"), (0.1, 0.29, 0.57), 2, SEED)


@query("experiment_grid", f"WITH {GRID} SELECT * FROM grid")
def experiment_grid(spark, sf):
    return _grid(spark, sf)


@query("pending_tasks", f"WITH {GRID} SELECT * FROM grid WHERE NOT (rate_percent = 10 AND iteration = 1)")
def pending_tasks(spark, sf):
    """Cells already present in the stored degraded table are dropped."""
    done = ev_grid(spark, sf).select("series_id", "technique", "rate_percent", "iteration")
    return gr.pending_tasks(_grid(spark, sf), done, ["series_id", "technique", "rate_percent", "iteration"])


@query("model_fanout", f"WITH {GRID} SELECT grid.*, m.model FROM grid, (VALUES ('mean'), ('ffill'), ('linear')) m(model)")
def model_fanout(spark, sf):
    return gr.model_fanout(_grid(spark, sf), ["mean", "ffill", "linear"])


@query("seed_replicates", """SELECT model, deterministic, i AS iteration, CAST(42 AS BIGINT) + i AS seed FROM
  (SELECT p_brand AS model, min(p_size) % 2 = 0 AS deterministic FROM part GROUP BY p_brand) m, range(1, 4) r(i)
  WHERE NOT deterministic OR i = 1""")
def seed_replicates(spark, sf):
    models = table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(
        (F.min("p_size") % 2 == 0).alias("deterministic"))
    out = gr.replicate_models(models, 3, 42)
    return out.select("model", "deterministic", F.col("iteration").cast("long").alias("iteration"),
                      F.col("seed").cast("long").alias("seed"))


@query("uniform_draw", rsql("""SELECT o_orderkey AS key, CAST(('0x' || substr(md5(concat_ws(':', o_orderkey, 1, 42)), 1, 13)) AS UBIGINT)
  / CAST(4503599627370496 AS DOUBLE) AS u FROM orders""", "u", 12))
def draws(spark, sf):
    df = table(spark, sf, "orders")
    return rounded(df.select(F.col("o_orderkey").alias("key"), uniform_draw("o_orderkey", F.lit(1), F.lit(42)).alias("u")), 12)


def _single(name, fn, technique):
    @query(name, f"WITH {EV}, {masked_sql('ev', 'm', (technique,))} SELECT series_id, pos, value FROM m")
    def run(spark, sf):
        # smallest blocks, so that the cut-off is found across buckets
        return fn(ev_user(spark, sf), 0.2, SEED, block=1).select("series_id", "pos", "value")


_single("mask_mcar", mask.mask_mcar, "MCAR")
_single("mask_mar", mask.mask_mar, "MAR")
_single("mask_mnar", mask.mask_mnar, "MNAR")


@query("degrade", f"WITH {DEG_GRID} SELECT series_id, technique, rate_percent, iteration, pos, value FROM deg")
def degrade(spark, sf):
    out = mask.degrade(ev_user(spark, sf), grid_for(ev_user(spark, sf), ("MCAR", "MAR", "MNAR"), (0.1, 0.3)))
    return out.select("series_id", "technique", "rate_percent", "iteration", "pos", "value")


@query("missing_report", rsql(f"""WITH {DEG_GRID} SELECT series_id, technique, rate_percent, iteration,
  count(*) FILTER (value IS NULL) AS n_missing, count(*) AS n_total,
  count(*) FILTER (value IS NULL) / CAST(count(*) AS DOUBLE) AS missing_share FROM deg GROUP BY ALL""", "missing_share"))
def missing_report(spark, sf):
    return rounded(mask.missing_report(ev_grid(spark, sf)))
