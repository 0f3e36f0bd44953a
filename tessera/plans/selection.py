"""Registered statistics / selection / sampling queries (A7, A9-A11, A21,
A22, T2-T7, P5-P10, M2, W11) and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config as C
from tessera.ml.validation import fold_summary
from tessera.operators import clean, features as ft, reports, stats as st
from tessera.plans import scoring
from tessera.plans.cleaning import f4_split_sql
from tessera.plans.common import DAILY_SQL, PANEL_EXTRA_SQL, PANEL_SQL, finish, q, r6, sql_cols, sql_round
from tessera.plans.featuring import BASE_EXTRA, basic_sql, full_sql, optimized_sql
from tessera.sources import fixtures as fx

SPEC = fx.EVENTS_SPEC
MATRIX_COLS = ("PM2_5", "PM10", "SO2", "NO2", "TEMP", "WSPM", "PRES", "hh")
X_RAW = ("PM10", "SO2", "NO2", "TEMP")


def _split_panel(spark, sf_dir):
    return clean.temporal_split(fx.hourly_panel(spark, sf_dir), SPEC)


def monthly_mean(spark, sf_dir):
    """Mean target per calendar month of the daily panel."""
    return finish(st.monthly_mean(fx.daily_panel(spark, sf_dir), fx.ORDERS_SPEC))


def median_fill(spark, sf_dir):
    """NULL target and TEMP filled with the train split's exact medians."""
    p = _split_panel(spark, sf_dir)
    return finish(st.median_fill(p, ["PM2_5", "TEMP"], fit=p.where(F.col("split") == "train")))


def mode_fill(spark, sf_dir):
    """A10: previous-hour wind label (NULL on each station's first row)
    filled with the train split's most frequent label."""
    p = _split_panel(spark, sf_dir)
    p = ft.window_features(p, SPEC, [ft.Lag("wd", 1, "wd_prev")])
    return finish(st.mode_fill(p, ["wd_prev"], fit=p.where(F.col("split") == "train")))


def label_encoding(spark, sf_dir):
    """M2: wind label -> alphabetical code fitted on train, unseen -> next code."""
    p = _split_panel(spark, sf_dir)
    return finish(st.label_encode(p, "wd", fit=p.where(F.col("split") == "train")))


def _basic(spark, sf_dir):
    return ft.engineer_basic(fx.hourly_panel(spark, sf_dir, extra=True), SPEC)


def target_correlation(spark, sf_dir):
    """|corr| of every numeric feature of the C4 frame with the target."""
    return finish(st.target_correlation(_basic(spark, sf_dir), SPEC.target))


def selected_features(spark, sf_dir):
    """Domain features first, then the most correlated, up to 50."""
    return finish(st.select_features(_basic(spark, sf_dir), SPEC))


def top_correlations(spark, sf_dir):
    """T3 + T4: the 15 features most correlated with the target."""
    return finish(st.top_k(st.target_correlation(_basic(spark, sf_dir), SPEC.target), "abs_corr", C.TOP_FEATURES))


def systematic_sample(spark, sf_dir):
    """T5: every 100th row of each station in time order."""
    return finish(st.systematic_sample(fx.hourly_panel(spark, sf_dir), SPEC, 100))


def hash_sample(spark, sf_dir):
    """500 scored rows chosen by a seeded hash of their key."""
    return finish(st.hash_sample(scoring.scored(spark, sf_dir), ["model", "station", "datetime"], 500))


def first_rows(spark, sf_dir):
    """First 100 scored test rows by time, station, model."""
    s = scoring.scored(spark, sf_dir).where(F.col("split") == "test")
    return finish(st.first_rows(s, ["datetime", "station", "model"], 100))


def complete_cases(spark, sf_dir):
    """P5: rows with every raw feature and the target present."""
    p = fx.hourly_panel(spark, sf_dir)
    return finish(st.complete_cases(p, X_RAW, SPEC.target))


def complete_case_report(spark, sf_dir):
    """NULL cells in X and y, rows kept and retention per split."""
    p = _split_panel(spark, sf_dir).where(F.col("split").isNotNull())
    return finish(st.complete_case_report(p, X_RAW, SPEC.target, by="split"))


def raw_model_features(spark, sf_dir):
    """P7 + A9: raw measurement columns present, NULLs filled by the frame's
    own medians, with the target."""
    p = fx.hourly_panel(spark, sf_dir)
    cols = st.raw_model_columns(p)
    return finish(st.median_fill(p.select("station", "datetime", *cols, SPEC.target), cols))


def common_features(spark, sf_dir):
    """P9 + P10: numeric columns common to the three C3 splits, minus target and
    keys: rows and values there in each split."""
    e = clean.temporal_split(ft.engineer_optimized(fx.hourly_panel(spark, sf_dir, extra=True), SPEC), SPEC)
    frames = [e.where(F.col("split") == s) for s in ("train", "val", "test")]
    names = st.common_numeric(frames, exclude=[SPEC.target, SPEC.key, SPEC.time, "split"])
    return finish(reports.feature_coverage(e.where(F.col("split").isNotNull()), names))


def feature_counts(spark, sf_dir):
    """Columns and rows of the base panel and of the C2, C3, C4 outputs."""
    base = fx.hourly_panel(spark, sf_dir, extra=True)
    frames = {"base": base, "full": ft.engineer_full(base, SPEC), "optimized": ft.engineer_optimized(base, SPEC),
              "basic": ft.engineer_basic(base, SPEC)}
    return finish(reports.shape_table(frames))


def feature_report(spark, sf_dir):
    """Features of the C2 output by name category (groups overlap), their
    cells and values."""
    base = fx.hourly_panel(spark, sf_dir, extra=True)
    full = ft.engineer_full(base, SPEC)
    return finish(reports.feature_categories(full, [c for c in full.columns if c not in base.columns]))


def selected_engineered(spark, sf_dir):
    """T2 on the C2 features: of more than a hundred candidates 50 are left."""
    full = ft.engineer_full(fx.hourly_panel(spark, sf_dir, extra=True), SPEC)
    return finish(st.select_features(full, SPEC))


def correlation_matrix(spark, sf_dir):
    """A11, full form: every two measurements over the hours that have both."""
    p = fx.hourly_panel(spark, sf_dir, extra=True)
    return finish(st.correlation_matrix(p, MATRIX_COLS))


def time_folds(spark, sf_dir):
    """5 expanding time folds over the distinct hours: rows and span per fold and role."""
    return finish(fold_summary(fx.hourly_panel(spark, sf_dir), SPEC, C.CV_SPLITS))


QUERIES = {
    "monthly_mean": monthly_mean,
    "median_fill": median_fill,
    "mode_fill": mode_fill,
    "label_encoding": label_encoding,
    "target_correlation": target_correlation,
    "selected_features": selected_features,
    "top_correlations": top_correlations,
    "systematic_sample": systematic_sample,
    "hash_sample": hash_sample,
    "first_rows": first_rows,
    "complete_cases": complete_cases,
    "complete_case_report": complete_case_report,
    "raw_model_features": raw_model_features,
    "common_features": common_features,
    "feature_counts": feature_counts,
    "feature_report": feature_report,
    "selected_engineered": selected_engineered,
    "correlation_matrix": correlation_matrix,
    "time_folds": time_folds,
}


# ------------------------------------------------------------------ SQL side

F4_COLS = ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd")
OUT_F4 = f"station, datetime, hh::BIGINT AS hh, {sql_round(('PM2_5', 'PM10', 'SO2', 'NO2', 'TEMP'))}, wd"


NOT_NUMERIC = ("station", "datetime", "wd", "season", "time_of_day", "PM2_5")


def _numeric(frame_sql) -> tuple[str, list[str]]:
    sql, names = frame_sql(PANEL_EXTRA_SQL)
    return sql, [n for n in names if n not in NOT_NUMERIC]


def _corr_sql(frame_sql=basic_sql) -> str:
    sql, numeric = _numeric(frame_sql)
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(corr({q(c)}::DOUBLE, PM2_5)) AS v FROM b" for c in numeric)
    return f"b AS MATERIALIZED ({sql}), c AS (SELECT feature, CASE WHEN isnan(v) THEN NULL ELSE v END AS abs_corr FROM ({rows}))"


def _selected_sql(frame_sql=basic_sql) -> str:
    _, numeric = _numeric(frame_sql)
    present = [n for n in dict.fromkeys(st.domain_features(SPEC)) if n in numeric or n in BASE_EXTRA]
    domain = ", ".join(f"('{n}', {i})" for i, n in enumerate(n for n in present if n != "PM2_5"))
    return f"""
      WITH {_corr_sql(frame_sql)}, d(feature, priority) AS (VALUES {domain}),
      r AS (SELECT coalesce(c.feature, d.feature) AS feature, c.abs_corr, d.priority
            FROM c FULL JOIN d ON c.feature = d.feature
            ORDER BY d.priority ASC NULLS LAST, round(c.abs_corr, 10) DESC NULLS LAST, 1 LIMIT {C.MAX_SELECTED_FEATURES})
      SELECT row_number() OVER (ORDER BY priority ASC NULLS LAST, round(abs_corr, 10) DESC NULLS LAST, feature)::BIGINT AS rank,
             feature, {r6('abs_corr')} AS abs_corr,
             CASE WHEN priority IS NOT NULL THEN 'domain' ELSE 'correlation' END AS source FROM r"""


def _matrix_sql() -> str:
    both = lambda a, b: f"FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    rows = [f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*)::BIGINT AS n, {r6(f'corr({a}, {b})')} AS corr {both(a, b)}"
            for j, a in enumerate(MATRIX_COLS) for b in MATRIX_COLS[j + 1:]]
    return f"WITH p AS MATERIALIZED ({PANEL_EXTRA_SQL}) " + " UNION ALL ".join(rows)


def _coverage_sql(sql: str, names: list[str], by: str) -> str:
    """(by, feature, rows, non_null) of a frame that holds ``by``."""
    counts = ", ".join(f"count({q(n)}) AS {q(n)}" for n in names)
    return f"""SELECT "{by}", feature, n_rows AS rows, non_null FROM (
      UNPIVOT (SELECT "{by}", count(*) AS n_rows, {counts} FROM ({sql}) GROUP BY ALL)
      ON {', '.join(q(n) for n in names)} INTO NAME feature VALUE non_null)"""


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["monthly_mean"] = (f"SELECT month(datetime)::BIGINT AS month, {r6('avg(PM2_5)')} AS mean_PM2_5 "
                         f"FROM ({DAILY_SQL}) GROUP BY 1")
    sp = f4_split_sql(PANEL_SQL)
    s["median_fill"] = f"""
      WITH p AS ({sp}), m AS (SELECT quantile_cont(PM2_5, 0.5) AS mp, quantile_cont(TEMP, 0.5) AS mt
                              FROM p WHERE split = 'train')
      SELECT station, datetime, hh::BIGINT AS hh, {r6('coalesce(PM2_5, m.mp)')} AS PM2_5,
             {sql_round(('PM10', 'SO2', 'NO2'))}, {r6('coalesce(TEMP, m.mt)')} AS TEMP, wd, split FROM p, m"""
    s["mode_fill"] = f"""
      WITH p AS (SELECT *, lag(wd, 1) OVER (PARTITION BY station ORDER BY datetime) AS wd_prev FROM ({sp})),
      m AS (SELECT wd_prev AS mv FROM p WHERE split = 'train' AND wd_prev IS NOT NULL
            GROUP BY wd_prev ORDER BY count(*) DESC, wd_prev LIMIT 1)
      SELECT {OUT_F4}, split, coalesce(wd_prev, (SELECT mv FROM m), 'unknown') AS wd_prev FROM p"""
    s["label_encoding"] = f"""
      WITH p AS ({sp}),
      lv AS (SELECT wd AS lwd, (row_number() OVER (ORDER BY wd) - 1)::DOUBLE AS code
             FROM (SELECT DISTINCT wd FROM p WHERE split = 'train' AND wd IS NOT NULL))
      SELECT {OUT_F4}, split, coalesce(lv.code, (SELECT count(*) FROM lv)::DOUBLE) AS wd_index
      FROM p LEFT JOIN lv ON p.wd = lv.lwd"""
    s["target_correlation"] = f"WITH {_corr_sql()} SELECT feature, {r6('abs_corr')} AS abs_corr FROM c"
    s["selected_features"] = _selected_sql()
    s["selected_engineered"] = _selected_sql(full_sql)
    s["correlation_matrix"] = _matrix_sql()
    s["top_correlations"] = (f"WITH {_corr_sql()} SELECT feature, {r6('abs_corr')} AS abs_corr FROM c "
                             f"ORDER BY abs_corr DESC NULLS LAST, feature LIMIT {C.TOP_FEATURES}")
    s["systematic_sample"] = (f"SELECT {OUT_F4} FROM (SELECT *, row_number() OVER (PARTITION BY station "
                              f"ORDER BY datetime) - 1 AS rn FROM ({PANEL_SQL})) WHERE rn % 100 = 0")
    s["hash_sample"] = (f"{scoring.WITH_SCORED} SELECT station, datetime, split, model, {r6('y')} AS y, {r6('p')} AS p FROM scored "
                        f"ORDER BY md5(concat_ws('|', '{C.RANDOM_STATE}', model, station, datetime::VARCHAR)), model, station, datetime "
                        f"LIMIT 500")
    s["first_rows"] = (f"{scoring.WITH_SCORED} SELECT station, datetime, split, model, {r6('y')} AS y, {r6('p')} AS p "
                       f"FROM scored WHERE split = 'test' ORDER BY datetime, station, model LIMIT 100")
    xs = " AND ".join(f"{q(c)} IS NOT NULL" for c in X_RAW + ("PM2_5",))
    s["complete_cases"] = f"SELECT {OUT_F4} FROM ({PANEL_SQL}) WHERE {xs}"
    xnull = " + ".join(f"({q(c)} IS NULL)::BIGINT" for c in X_RAW)
    s["complete_case_report"] = f"""
      SELECT split AS dataset, sum({xnull})::BIGINT AS nulls_x, count(*) FILTER (WHERE PM2_5 IS NULL)::BIGINT AS nulls_y,
             count(*)::BIGINT AS rows, count(*) FILTER (WHERE {xs})::BIGINT AS rows_kept,
             {r6(f'count(*) FILTER (WHERE {xs}) * 100.0 / count(*)')} AS retention_pct
      FROM ({sp}) WHERE split IS NOT NULL GROUP BY split"""
    meds = ", ".join(f"quantile_cont({q(c)}, 0.5) AS {q('m_' + c)}" for c in X_RAW)
    filled = ", ".join(f"{r6('coalesce(' + q(c) + ', m.' + q('m_' + c) + ')')} AS {q(c)}" for c in X_RAW)
    s["raw_model_features"] = (f"WITH p AS ({PANEL_SQL}), m AS (SELECT {meds} FROM p) "
                               f"SELECT station, datetime, {filled}, {r6('PM2_5')} AS PM2_5 FROM p, m")
    opt, opt_names = optimized_sql(PANEL_EXTRA_SQL)
    common = [n for n in opt_names if n not in NOT_NUMERIC]
    s["common_features"] = _coverage_sql(f"SELECT * FROM ({f4_split_sql(opt)}) WHERE split IS NOT NULL", common, "split")
    full, full_names = full_sql(PANEL_EXTRA_SQL)
    basic, _ = basic_sql(PANEL_EXTRA_SQL)
    parts = []
    for name, sql in (("base", PANEL_EXTRA_SQL), ("full", full), ("optimized", opt), ("basic", basic)):
        parts.append(f"SELECT '{name}' AS stage, (SELECT count(*) FROM (DESCRIBE {sql}))::BIGINT AS n_columns, "
                     f"(SELECT count(*) FROM ({sql}))::BIGINT AS n_rows")
    s["feature_counts"] = " UNION ALL ".join(parts)
    cats = reports.CATEGORY_PATTERNS
    made = [n for n in full_names if n not in BASE_EXTRA]
    coverage = _coverage_sql(f"SELECT 0 AS everything, * FROM ({full})", made, "everything")
    per = [("total", "true"), *((cat, " OR ".join(f"contains(feature, '{p}')" for p in pats)) for cat, pats in cats)]
    s["feature_report"] = f"WITH v AS ({coverage}) " + " UNION ALL ".join(
        f"SELECT '{cat}' AS category, count(*)::BIGINT AS features, coalesce(sum(rows), 0)::BIGINT AS cells, "
        f"coalesce(sum(non_null), 0)::BIGINT AS non_null FROM v WHERE {cond}" for cat, cond in per)
    s["time_folds"] = f"""
      WITH p AS ({PANEL_SQL}),
      t AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS step FROM (SELECT DISTINCT datetime FROM p)),
      n AS (SELECT count(*) AS n FROM t),
      b AS (SELECT f AS fold, n - ({C.CV_SPLITS} - f) * (n // {C.CV_SPLITS + 1}) AS ts, n // {C.CV_SPLITS + 1} AS sz
            FROM n, range({C.CV_SPLITS}) r(f)),
      a AS (SELECT t.datetime, b.fold, CASE WHEN t.step < b.ts THEN 'train' WHEN t.step < b.ts + b.sz THEN 'test' END AS role
            FROM t, b)
      SELECT fold::BIGINT AS fold, role, count(*)::BIGINT AS rows, min(p.datetime) AS first, max(p.datetime) AS last
      FROM p JOIN a ON p.datetime = a.datetime WHERE role IS NOT NULL GROUP BY fold, role"""
    return s


SQL = _sql()
