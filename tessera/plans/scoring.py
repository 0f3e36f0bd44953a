"""Registered scoring queries (M10, A12-A20, P13, P14) over the scored table
F3: two rule-made forecasts of the hourly target (``persistence``: the
previous row's value; ``mean24``: mean of the 24 rows before), so every
metric has an exact SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config as C
from tessera.operators import clean, features as ft, metrics as mt, stats as st
from tessera.plans.cleaning import f4_split_sql
from tessera.plans.common import PANEL_SQL, finish, q, r6
from tessera.sources import fixtures as fx

SPEC = fx.EVENTS_SPEC
BASELINE, CANDIDATE = "mean24", "persistence"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 scored table ``(station, datetime, split, model, y, p)``: both models
    over the same rows, those that both can forecast."""
    p = clean.temporal_split(fx.hourly_panel(spark, sf_dir), SPEC)
    p = ft.window_features(p, SPEC, [ft.Lag(SPEC.target, 1, "_p1")],
                           [ft.Roll(SPEC.target, 24, "mean", 1, "_p24")], leak_safe=True)
    base = p.dropna(subset=[SPEC.target, "split", "_p1", "_p24"])
    one = base.select(
        "station", "datetime", "split", F.lit(CANDIDATE).alias("model"), F.col(SPEC.target).alias("y"),
        F.col("_p1").alias("p"))
    two = base.select(
        "station", "datetime", "split", F.lit(BASELINE).alias("model"), F.col(SPEC.target).alias("y"),
        F.col("_p24").alias("p"))
    return one.unionByName(two)


def residuals(spark, sf_dir):
    """Residual and absolute residual per scored row."""
    return finish(mt.residuals(scored(spark, sf_dir)))


def forecast_metrics(spark, sf_dir):
    """RMSE, MAE, R², MAPE, within 10 per model and split."""
    return finish(mt.metrics(scored(spark, sf_dir), ["model", "split"]))


def forecast_metrics_full(spark, sf_dir):
    """Full metric set per model and split."""
    return finish(mt.metrics(scored(spark, sf_dir), ["model", "split"], full=True))


def model_comparison(spark, sf_dir):
    """Test metrics of baseline and candidate with improvement percent."""
    return finish(mt.compare_two(scored(spark, sf_dir), BASELINE, CANDIDATE))


def model_table(spark, sf_dir):
    """Comparison table of every model on test."""
    return finish(mt.model_table(scored(spark, sf_dir)))


def improvement_summary(spark, sf_dir):
    """RMSE, R², MAE improvement and RMSE drop."""
    return finish(mt.improvement_summary(scored(spark, sf_dir), BASELINE, CANDIDATE))


def overfit_check(spark, sf_dir):
    """Val - test RMSE gap per model."""
    return finish(mt.overfit_check(scored(spark, sf_dir)))


def guideline_ratio(spark, sf_dir):
    """Test mean of the target and RMSE as percent of the guideline."""
    return finish(mt.guideline_ratio(scored(spark, sf_dir)))


def large_errors(spark, sf_dir):
    """Rows with |residual| > 50 per model and split."""
    return finish(mt.large_errors(scored(spark, sf_dir)))


def negative_values(spark, sf_dir):
    """Negative values per pollutant of the panel."""
    return finish(mt.negative_values(fx.hourly_panel(spark, sf_dir), SPEC.pollutants))


def residual_histogram(spark, sf_dir):
    """50-bin residual counts per model."""
    return finish(st.histogram(mt.residuals(scored(spark, sf_dir)), "residual", 50, by=["model"]))


def target_histogram(spark, sf_dir):
    """50-bin target density per split."""
    p = clean.temporal_split(fx.hourly_panel(spark, sf_dir), SPEC).where(F.col("split").isNotNull())
    return finish(st.histogram(p, SPEC.target, 50, by=["split"]))


def residual_qq(spark, sf_dir):
    """100-point normal Q-Q of the persistence residuals (exact quantiles)."""
    r = mt.residuals(scored(spark, sf_dir)).where(F.col("model") == CANDIDATE)
    return finish(st.qq_points(r, "residual", 100))


QUERIES = {
    "residuals": residuals,
    "forecast_metrics": forecast_metrics,
    "forecast_metrics_full": forecast_metrics_full,
    "model_comparison": model_comparison,
    "model_table": model_table,
    "improvement_summary": improvement_summary,
    "overfit_check": overfit_check,
    "guideline_ratio": guideline_ratio,
    "large_errors": large_errors,
    "negative_values": negative_values,
    "residual_histogram": residual_histogram,
    "target_histogram": target_histogram,
    "residual_qq": residual_qq,
}


# ------------------------------------------------------------------ SQL side

SCORED_SQL = f"""
  SELECT station, datetime, split, model, y, p FROM (
    SELECT station, datetime, split, '{CANDIDATE}' AS model, PM2_5 AS y, p1 AS p FROM s WHERE p1 IS NOT NULL
    UNION ALL
    SELECT station, datetime, split, '{BASELINE}' AS model, PM2_5 AS y, p24 AS p FROM s WHERE p24 IS NOT NULL)
"""
WITH_SCORED = f"""
  WITH s AS (
    SELECT * FROM (
      SELECT *, lag(PM2_5, 1) OVER (PARTITION BY station ORDER BY datetime) AS p1,
             avg(PM2_5) OVER (PARTITION BY station ORDER BY datetime ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS p24
      FROM ({f4_split_sql(PANEL_SQL)}))
    WHERE PM2_5 IS NOT NULL AND split IS NOT NULL AND p1 IS NOT NULL AND p24 IS NOT NULL),
  scored AS ({SCORED_SQL})
"""


def _metric_sql(full: bool) -> str:
    e = "(y - p)"
    items = [f"{r6(f'sqrt(avg({e} * {e}))')} AS rmse", f"{r6(f'avg(abs({e}))')} AS mae",
             f"{r6(f'1.0 - sum({e} * {e}) / (var_pop(y) * count(y))')} AS r2",
             f"{r6(f'avg(abs({e} / NULLIF(y, 0))) * 100')} AS mape",
             "count(*) FILTER (WHERE y = 0)::BIGINT AS mape_skipped", "count(*)::BIGINT AS n"]
    if full:
        items += [f"{r6('avg(y)')} AS mean_actual", f"{r6('avg(p)')} AS mean_predicted",
                  f"{r6('stddev_pop(y)')} AS std_actual", f"{r6('stddev_pop(p)')} AS std_predicted",
                  f"{r6(f'avg({e})')} AS mean_residual", f"{r6(f'stddev_pop({e})')} AS std_residual"]
        items += [f"{r6(f'avg((abs({e}) <= {t})::DOUBLE) * 100')} AS pct_within_{t}" for t in C.WITHIN_THRESHOLDS]
    else:
        items.append(f"{r6(f'avg((abs({e}) <= 10)::DOUBLE) * 100')} AS pct_within_10")
    return ", ".join(items)


def _raw_metrics(by: str) -> str:
    e = "(y - p)"
    return (f"SELECT {by}, sqrt(avg({e} * {e})) AS rmse, avg(abs({e})) AS mae, "
            f"1.0 - sum({e} * {e}) / (var_pop(y) * count(y)) AS r2, avg(abs({e} / NULLIF(y, 0))) * 100 AS mape, "
            f"avg((abs({e}) <= 10)::DOUBLE) * 100 AS pct_within_10 FROM scored WHERE split = 'test' GROUP BY {by}")


def _compare_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, max({m}) FILTER (WHERE model = '{BASELINE}') AS b, "
        f"max({m}) FILTER (WHERE model = '{CANDIDATE}') AS c FROM m" for m in mt.METRIC_NAMES)
    lower = ", ".join(f"'{x}'" for x in C.LOWER_IS_BETTER)
    return (f"m AS ({_raw_metrics('model')}), cmp AS (SELECT metric, b, c, CASE WHEN metric IN ({lower}) "
            f"THEN (b - c) * 100 / NULLIF(b, 0) ELSE (c - b) * 100 / NULLIF(b, 0) END AS imp FROM ({rows}))")


def _hist_sql(src: str, col: str, by: str, bins: int = 50) -> str:
    return f"""
      WITH d AS ({src}),
      r AS (SELECT {by}, min({col}) AS lo, max({col}) AS hi, count({col}) AS n FROM d GROUP BY {by}),
      b AS (SELECT d.{by}, r.lo, r.hi, r.n,
                   least(coalesce(floor((d.{col} - r.lo) * {float(bins)}::DOUBLE / (r.hi - r.lo)), 0), {bins - 1})::BIGINT AS bin
            FROM d JOIN r ON d.{by} = r.{by} WHERE d.{col} IS NOT NULL)
      SELECT {by}, bin, {r6(f'lo + bin * ((hi - lo) / {float(bins)}::DOUBLE)')} AS bin_lo,
             {r6(f'lo + (bin + 1) * ((hi - lo) / {float(bins)}::DOUBLE)')} AS bin_hi, count(*)::BIGINT AS count,
             {r6(f'count(*)::DOUBLE / NULLIF(n * ((hi - lo) / {float(bins)}::DOUBLE), 0)')} AS density
      FROM b GROUP BY {by}, bin, lo, hi, n"""


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["residuals"] = (f"{WITH_SCORED} SELECT station, datetime, split, model, {r6('y')} AS y, {r6('p')} AS p, "
                      f"{r6('y - p')} AS residual, {r6('abs(y - p)')} AS abs_residual FROM scored")
    s["forecast_metrics"] = f"{WITH_SCORED} SELECT model, split, {_metric_sql(False)} FROM scored GROUP BY model, split"
    s["forecast_metrics_full"] = (f"{WITH_SCORED} SELECT model, split, {_metric_sql(True)} FROM scored "
                                  f"GROUP BY model, split")
    s["model_comparison"] = (f"{WITH_SCORED}, {_compare_sql()} SELECT metric, {r6('b')} AS baseline, "
                             f"{r6('c')} AS candidate, {r6('imp')} AS improvement_pct FROM cmp")
    e = "(y - p)"
    s["model_table"] = (f"{WITH_SCORED} SELECT model, {r6(f'sqrt(avg({e} * {e}))')} AS rmse, "
                        f"{r6(f'avg(abs({e}))')} AS mae, {r6(f'1.0 - sum({e} * {e}) / (var_pop(y) * count(y))')} AS r2, "
                        f"{r6(f'avg((abs({e}) <= 10)::DOUBLE) * 100')} AS pct_within_10, "
                        f"{r6(f'avg((abs({e}) <= 25)::DOUBLE) * 100')} AS pct_within_25 "
                        f"FROM scored WHERE split = 'test' GROUP BY model")
    g = lambda m, c: f"max({c}) FILTER (WHERE metric = '{m}')"
    s["improvement_summary"] = (
        f"{WITH_SCORED}, {_compare_sql()} SELECT {r6(g('rmse', 'imp'))} AS rmse_improvement_pct, "
        f"{r6(g('r2', 'imp'))} AS r2_improvement_pct, {r6(g('mae', 'imp'))} AS mae_improvement_pct, "
        f"{r6(g('rmse', 'b') + ' - ' + g('rmse', 'c'))} AS rmse_drop FROM cmp")
    s["overfit_check"] = f"""{WITH_SCORED},
      g AS (SELECT model, sqrt(avg({e} * {e}) FILTER (WHERE split = 'val')) AS v,
                   sqrt(avg({e} * {e}) FILTER (WHERE split = 'test')) AS t FROM scored GROUP BY model)
      SELECT model, {r6('v')} AS val_rmse, {r6('t')} AS test_rmse, {r6('v - t')} AS gap,
             (abs(v - t) = (SELECT min(abs(v - t)) FROM g))::BIGINT AS smallest_gap FROM g"""
    s["guideline_ratio"] = (f"{WITH_SCORED} SELECT model, {r6('avg(y)')} AS mean_actual, "
                            f"{r6(f'sqrt(avg({e} * {e})) / {C.GUIDELINE} * 100')} AS rmse_pct_of_guideline "
                            f"FROM scored WHERE split = 'test' GROUP BY model")
    s["large_errors"] = (f"{WITH_SCORED} SELECT model, split, count(*) FILTER (WHERE abs({e}) > {C.LARGE_ERROR})::BIGINT "
                         f"AS large_errors, {r6(f'avg((abs({e}) > {C.LARGE_ERROR})::DOUBLE) * 100')} AS large_error_pct "
                         f"FROM scored GROUP BY model, split")
    s["negative_values"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {q(c)} < 0)::BIGINT AS negatives FROM ({PANEL_SQL})"
        for c in ("PM2_5", "PM10", "SO2", "NO2"))
    s["residual_histogram"] = (f"{WITH_SCORED} SELECT * FROM ("
                               + _hist_sql("SELECT model, y - p AS residual FROM scored", "residual", "model") + ")")
    s["target_histogram"] = _hist_sql(f"SELECT * FROM ({f4_split_sql(PANEL_SQL)}) WHERE split IS NOT NULL",
                                      "PM2_5", "split")
    ps = st.filliben_positions(100)
    import statistics
    nd = statistics.NormalDist()
    vals = ", ".join(f"({i + 1}, {p!r}::DOUBLE, {nd.inv_cdf(p)!r}::DOUBLE)" for i, p in enumerate(ps))
    plist = ", ".join(f"{p!r}::DOUBLE" for p in ps)
    s["residual_qq"] = f"""{WITH_SCORED},
      t(point, prob, theoretical) AS (VALUES {vals}),
      qs AS (SELECT quantile_cont(y - p, [{plist}]) AS v FROM scored WHERE model = '{CANDIDATE}')
      SELECT point::BIGINT AS point, {r6('prob')} AS prob, {r6('theoretical')} AS theoretical,
             {r6('qs.v[point]')} AS sample
      FROM t, qs"""
    return s


SQL = _sql()
