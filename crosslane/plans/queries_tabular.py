"""Registered queries of the weighted multi-horizon table, read from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosslane.operators import tabular_features as tf
from crosslane.operators import tabular_quality as tq
from crosslane.operators.ranking import add_position
from crosslane.plans import binding as b
from crosslane.plans.catalog import query, rounded
from crosslane.plans.oracle import BLOCKS, average_rank, r, with_blocks

K, O = b.KEY_COLUMNS, b.KEY_ORDER
W = "(PARTITION BY code, sub_code ORDER BY ts_index, id)"


def _rows(n: int, first: int = 0) -> str:
    return f"(PARTITION BY code, sub_code ORDER BY ts_index, id ROWS BETWEEN {n} PRECEDING AND {first} {'PRECEDING' if first else ''}".replace(
        "AND 0 ", "AND CURRENT ROW"
    ) + ")"


@query(
    "tabular_lags",
    with_blocks(
        ("tabular",),
        "SELECT id, "
        + ", ".join(f"{r(f'lag({c}, {k}) OVER {W}')} AS {c}_lag{k}" for c in ("feature_a", "feature_b") for k in (1, 3, 5))
        + " FROM tabular",
    ),
)
def tabular_lags(spark, sf):
    out = tf.add_lags(b.tabular(spark, sf), ["feature_a", "feature_b"], [1, 3, 5], K, O)
    return rounded(out.select("id", *[f"{c}_lag{k}" for c in ("feature_a", "feature_b") for k in (1, 3, 5)]))


@query(
    "tabular_changes",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {r('abs(feature_a)')} AS feature_a_abs, {r(f'feature_a - lag(feature_a) OVER {W}')} AS feature_a_diff,
  {r(f'coalesce(feature_a / nullif(lag(feature_a) OVER {W}, 0) - 1, 0)')} AS feature_a_pct FROM tabular""",
    ),
)
def tabular_changes(spark, sf):
    out = tf.add_changes(b.tabular(spark, sf), ["feature_a"], K, O)
    return rounded(out.select("id", "feature_a_abs", "feature_a_diff", "feature_a_pct"))


@query(
    "tabular_moving",
    with_blocks(
        ("tabular",),
        "SELECT id, "
        + ", ".join(f"{r(f'avg(feature_a) OVER {_rows(n - 1)}')} AS feature_a_roll{n}, {r(f'stddev_samp(feature_a) OVER {_rows(n - 1)}')} AS feature_a_rollstd{n}" for n in (5, 10))
        + " FROM tabular",
    ),
)
def tabular_moving(spark, sf):
    out = tf.add_moving(b.tabular(spark, sf), ["feature_a"], [5, 10], K, O)
    return rounded(out.select("id", *[f"feature_a_{s}{n}" for n in (5, 10) for s in ("roll", "rollstd")]))


def _past(agg: str, n: int) -> str:
    return f"{agg}(feature_a) OVER {_rows(n, 1)}"


@query(
    "tabular_past_moving",
    with_blocks(
        ("tabular",),
        "SELECT id, " + ", ".join(f"{r(_past('avg', n))} AS roll_mean_{n}, {r(_past('stddev_samp', n))} AS roll_std_{n}" for n in (3, 7, 14)) + " FROM tabular",
    ),
)
def tabular_past_moving(spark, sf):
    out = tf.add_past_moving(b.tabular(spark, sf), "feature_a", [3, 7, 14], K, O)
    return rounded(out.select("id", *[f"roll_{s}_{n}" for n in (3, 7, 14) for s in ("mean", "std")]))


@query(
    "tabular_strict_moving",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {r('CASE WHEN count(feature_a) OVER w = 3 THEN avg(feature_a) OVER w END')} AS feature_a_roll_mean3 FROM tabular
WINDOW w AS (PARTITION BY code ORDER BY ts_index, id ROWS 2 PRECEDING)""",
    ),
)
def tabular_strict_moving(spark, sf):
    out = tf.add_strict_moving(b.tabular(spark, sf), ["feature_a"], 3, ["code"], O)
    return rounded(out.select("id", "feature_a_roll_mean3"))


@query(
    "tabular_ewm",
    with_blocks(
        ("tabular",),
        f"""SELECT a.id, {', '.join(r(f'sum(z.feature_a * CASE WHEN z.i = 1 THEN 1.0 ELSE 2.0 / {s + 1} END * pow(1.0 - 2.0 / {s + 1}, a.i - z.i))') + f' AS feature_a_ewm{s}' for s in (3, 5))}
FROM n a JOIN n z ON a.code = z.code AND a.sub_code = z.sub_code AND z.i <= a.i GROUP BY 1""",
        {"n": f"SELECT *, row_number() OVER {W} AS i FROM tabular"},
    ),
)
def tabular_ewm(spark, sf):
    out = tf.add_ewm(b.tabular(spark, sf), ["feature_a"], [3, 5], K, O)
    return rounded(out.select("id", "feature_a_ewm3", "feature_a_ewm5"))


@query(
    "tabular_pairs",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {r('feature_a - feature_b')} AS spread_feature_a_feature_b, {r('feature_a / (feature_b + 1e-7)')} AS ratio_feature_a_feature_b,
  {r('feature_a * feature_b')} AS feature_a_x_feature_b, {r('feature_a / (abs(feature_b) + 1e-3)')} AS feature_a_over_feature_b FROM tabular""",
    ),
)
def tabular_pairs(spark, sf):
    out = tf.add_pair_features(b.tabular(spark, sf), [("feature_a", "feature_b")])
    return rounded(out.select("id", *[c for c in out.columns if "feature_a" in c and "feature_b" in c]))


@query(
    "tabular_level_means",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {r('avg(feature_a) OVER (PARTITION BY sub_category, ts_index)')} AS feature_a_sub_category_mean,
  {r('feature_a - avg(feature_a) OVER (PARTITION BY sub_category, ts_index)')} AS feature_a_vs_sub_category FROM tabular""",
    ),
)
def tabular_level_means(spark, sf):
    out = tf.add_level_means(b.tabular(spark, sf), ["feature_a"], ["sub_category"])
    return rounded(out.select("id", "feature_a_sub_category_mean", "feature_a_vs_sub_category"))


_TS = "(PARTITION BY ts_index)"


@query(
    "tabular_time_stats",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {r('s')} AS feature_a_ts_std, {r('mx - mn')} AS feature_a_ts_range, {r('feature_a - mn')} AS feature_a_dist_min,
  {r('mx - feature_a')} AS feature_a_dist_max, {r('feature_a / (s + 1e-7)')} AS feature_a_norm_vol, {r('(feature_a - m) / (s + 1e-7)')} AS feature_a_z,
  {r('rk / n')} AS feature_a_rank FROM (SELECT *, stddev_samp(feature_a) OVER {_TS} AS s, avg(feature_a) OVER {_TS} AS m, min(feature_a) OVER {_TS} AS mn,
  max(feature_a) OVER {_TS} AS mx, {average_rank('feature_a', 'ts_index')} AS rk, count(*) OVER {_TS} AS n FROM tabular)""",
    ),
)
def tabular_time_stats(spark, sf):
    out = tf.add_time_stats(b.tabular(spark, sf), ["feature_a"])
    names = ("ts_std", "ts_range", "dist_min", "dist_max", "norm_vol", "z", "rank")
    return rounded(out.select("id", *[f"feature_a_{n}" for n in names]))


@query(
    "tabular_calendar",
    with_blocks(
        ("tabular",),
        f"""SELECT id, ts_index % 7 AS ts_mod_7, ts_index % 30 AS ts_mod_30, ts_index % 90 AS ts_mod_90, {r('sin(2 * pi() * ts_index / 365)')} AS ts_sin,
  {r('cos(2 * pi() * ts_index / 365)')} AS ts_cos, {r('sin(2 * pi() * ts_index / 100)')} AS ts_sin_100, {r('cos(2 * pi() * ts_index / 100)')} AS ts_cos_100,
  {r('ln(1 + ts_index)')} AS ts_log, ts_index * ts_index AS ts_sq, horizon * horizon AS horizon_sq, ts_index * horizon AS ts_horizon,
  {r('(ts_index - lo) / (hi - lo + 1e-6)')} AS ts_norm FROM tabular, (SELECT min(ts_index) AS lo, max(ts_index) AS hi FROM tabular)""",
    ),
)
def tabular_calendar(spark, sf):
    out = tf.add_calendar(b.tabular(spark, sf))
    return rounded(out.select("id", *[c for c in out.columns if c.startswith(("ts_", "horizon_")) and c != "ts_index"]))


@query(
    "tabular_trend",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {', '.join(r(f'coalesce(l{x} / nullif(l{y} + 1e-6, 0), 0)') + f' AS lag_ratio_{x}_{y}' for x, y in ((1, 7), (3, 14), (1, 3)))},
  {r('coalesce(m3 - m14, 0)')} AS trend_strength, {r('coalesce(s7 / nullif(m7 + 1e-6, 0), 0)')} AS volatility_strength
FROM (SELECT id, {', '.join(f'lag(feature_a, {k}) OVER {W} AS l{k}' for k in (1, 3, 7, 14))}, {_past('avg', 3)} AS m3, {_past('avg', 7)} AS m7,
  {_past('avg', 14)} AS m14, {_past('stddev_samp', 7)} AS s7 FROM tabular)""",
    ),
)
def tabular_trend(spark, sf):
    df = tf.add_lags(b.tabular(spark, sf), ["feature_a"], [1, 3, 7, 14], K, O)
    out = tf.add_trend(tf.add_past_moving(df, "feature_a", [3, 7, 14], K, O))
    return rounded(out.select("id", "lag_ratio_1_7", "lag_ratio_3_14", "lag_ratio_1_3", "trend_strength", "volatility_strength"))


# ---- encodings --------------------------------------------------------------------

_SPLIT = 500


def _train(spark, sf):
    return b.tabular(spark, sf).where(F.col("ts_index") <= _SPLIT)


@query(
    "target_encoding",
    with_blocks(
        ("tabular",),
        f"""SELECT t.id, {r('coalesce(a.m, g.m)')} AS code_mean, {r('coalesce(a.s, 0)')} AS code_std, {r('coalesce(z.m, g.m)')} AS sub_code_mean, {r('coalesce(z.s, 0)')} AS sub_code_std
FROM tabular t LEFT JOIN (SELECT code, avg(y_target) AS m, stddev_samp(y_target) AS s FROM tr GROUP BY 1) a USING (code)
LEFT JOIN (SELECT sub_code, avg(y_target) AS m, stddev_samp(y_target) AS s FROM tr GROUP BY 1) z USING (sub_code), (SELECT avg(y_target) AS m FROM tr) g""",
        {"tr": f"SELECT * FROM tabular WHERE ts_index <= {_SPLIT}"},
    ),
)
def target_encoding(spark, sf):
    out = tf.add_target_encoding(b.tabular(spark, sf), _train(spark, sf), ["code", "sub_code"])
    return rounded(out.select("id", "code_mean", "code_std", "sub_code_mean", "sub_code_std"))


@query(
    "frequency_encoding",
    with_blocks(
        ("tabular",),
        f"""SELECT t.id, coalesce(f, 1) AS sub_code_freq, {r('ln(1 + coalesce(f, 1))')} AS sub_code_log_freq,
  CAST(coalesce(k, (SELECT count(DISTINCT sub_code) FROM tabular)) AS INT) AS sub_code_freq_rank,
  count(*) OVER (PARTITION BY ts_index, t.sub_code) AS sub_code_ts_freq, {r('count(*) OVER (PARTITION BY ts_index, t.sub_code) / (coalesce(f, 1) + 1.0)')} AS sub_code_rel_freq
FROM tabular t LEFT JOIN (SELECT *, dense_rank() OVER (ORDER BY f DESC) AS k FROM (SELECT sub_code, count(*) AS f FROM tabular WHERE ts_index <= {_SPLIT} GROUP BY 1)) USING (sub_code)""",
    ),
)
def frequency_encoding(spark, sf):
    out = tf.add_frequency(b.tabular(spark, sf), _train(spark, sf))
    out = out.withColumn("sub_code_freq_rank", F.col("sub_code_freq_rank").cast("int"))
    return rounded(out.select("id", *[f"sub_code_{n}" for n in ("freq", "log_freq", "freq_rank", "ts_freq", "rel_freq")]))


@query(
    "pair_frequency",
    with_blocks(
        ("tabular",),
        f"""SELECT t.id, coalesce(f, 1) AS code_horizon_freq FROM tabular t
LEFT JOIN (SELECT code, horizon, count(*) AS f FROM tabular WHERE ts_index <= {_SPLIT} GROUP BY 1, 2) USING (code, horizon)""",
    ),
)
def pair_frequency(spark, sf):
    return tf.add_pair_frequency(b.tabular(spark, sf), _train(spark, sf)).select("id", "code_horizon_freq")


@query(
    "one_hot",
    with_blocks(
        ("tabular",),
        "SELECT id, " + ", ".join(f"CASE WHEN sub_category = 'c{n}' THEN 1 ELSE 0 END AS subcat_c{n}" for n in (4, 5, 6, 8)) + " FROM tabular",
    ),
)
def one_hot(spark, sf):
    return tf.add_one_hot(b.tabular(spark, sf), "sub_category", ["c4", "c5", "c6", "c8"], "subcat").select(
        "id", "subcat_c4", "subcat_c5", "subcat_c6", "subcat_c8"
    )


@query(
    "label_codes",
    with_blocks(
        ("tabular",),
        "SELECT t.id, code_code FROM tabular t JOIN (SELECT code, row_number() OVER (ORDER BY code) - 1 AS code_code FROM (SELECT DISTINCT code FROM tabular)) USING (code)",
    ),
)
def label_codes(spark, sf):
    df = b.tabular(spark, sf)
    train, test = df.where(F.col("ts_index") <= _SPLIT), df.where(F.col("ts_index") > _SPLIT)
    return tf.add_label_codes(df, tf.label_codes([train, test], "code"), "code").select("id", "code_code")


# ---- weights and targets -------------------------------------------------------------


@query(
    "soften_weights",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {r('c / (avg(c) OVER () + 1e-12)')} AS soft_weight FROM (SELECT id, least(greatest(sqrt(greatest(weight, 0)), lo), hi) AS c FROM tabular,
  (SELECT quantile_cont(sqrt(weight), 0.05) AS lo, quantile_cont(sqrt(weight), 0.95) AS hi FROM tabular))""",
    ),
)
def soften_weights(spark, sf):
    return rounded(tf.soften_weights(b.tabular(spark, sf), "sqrt_clip").select("id", "soft_weight"))


@query(
    "clip_target",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {r('least(greatest(y_target, lo), hi)')} AS y_target FROM tabular, (
  SELECT quantile_cont(y_target, 0.01) AS lo, quantile_cont(y_target, 0.99) AS hi FROM tabular WHERE ts_index <= {_SPLIT})""",
    ),
)
def clip_target(spark, sf):
    return rounded(tf.clip_to_quantiles(b.tabular(spark, sf), _train(spark, sf), "y_target").select("id", "y_target"))


@query(
    "clip_predictions",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {r('least(greatest(y_target * 2, lo), hi)')} AS prediction FROM tabular, (
  SELECT min(y_target) AS lo, max(y_target) AS hi FROM tabular WHERE ts_index <= {_SPLIT})""",
    ),
)
def clip_predictions(spark, sf):
    df = b.tabular(spark, sf).withColumn("prediction", F.col("y_target") * 2)
    return rounded(tf.clip_to_range(df, "prediction", _train(spark, sf), "y_target").select("id", "prediction"))


@query(
    "recency_weights",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {r('weight * (0.6 + 40.0 * ((ts_index - lo) / (hi - lo + 1e-6)))')} AS recency_weight FROM tabular,
  (SELECT min(ts_index) AS lo, max(ts_index) AS hi FROM tabular)""",
    ),
)
def recency_weights(spark, sf):
    return rounded(tf.recency_weights(b.tabular(spark, sf)).select("id", "recency_weight"))


@query(
    "impute_medians",
    with_blocks(
        ("tabular",),
        f"""SELECT id, {r(f'coalesce(feature_b, (SELECT median(feature_b) FROM tabular WHERE ts_index <= {_SPLIT}))')} AS feature_b FROM tabular""",
    ),
)
def impute_medians(spark, sf):
    return rounded(tf.impute_medians(b.tabular(spark, sf), _train(spark, sf), ["feature_b", "feature_c"]).select("id", "feature_b"))


# ---- scores ---------------------------------------------------------------------------

BLOCKS["scored_rows"] = (("tabular",), "SELECT *, feature_a / 10.0 - 2.0 AS prediction FROM tabular")


def _predicted(spark, sf):
    return b.tabular(spark, sf).withColumn("prediction", F.col("feature_a") / 10.0 - 2.0)


@query(
    "weighted_score",
    with_blocks(
        ("scored_rows",),
        f"""SELECT horizon, {r('sqrt(1 - least(greatest(sum(weight * (y_target - prediction) * (y_target - prediction)) / sum(weight * y_target * y_target), 0), 1))')} AS score
FROM scored_rows GROUP BY 1""",
    ),
)
def weighted_score(spark, sf):
    return rounded(tq.weighted_score(_predicted(spark, sf), ["horizon"]))


@query(
    "error_metrics",
    with_blocks(
        ("scored_rows",),
        f"""SELECT horizon, {r('sqrt(sum(weight * e * e) / (sum(weight) + 1e-12))')} AS weighted_rmse, {r('sum(weight * abs(e)) / (sum(weight) + 1e-12)')} AS weighted_mae,
  {r('avg(e * e)')} AS mse, {r('sqrt(avg(e * e))')} AS rmse, {r('avg(abs(e))')} AS mae FROM (SELECT *, y_target - prediction AS e FROM scored_rows) GROUP BY 1""",
    ),
)
def error_metrics(spark, sf):
    return rounded(tq.error_metrics(_predicted(spark, sf), ["horizon"]))


@query(
    "prediction_summary",
    with_blocks(
        ("scored_rows",),
        f"SELECT horizon, {r('min(prediction)')} AS min, {r('max(prediction)')} AS max, {r('avg(prediction)')} AS mean, {r('stddev_samp(prediction)')} AS std FROM scored_rows GROUP BY 1",
    ),
)
def prediction_summary(spark, sf):
    return rounded(tq.prediction_summary(_predicted(spark, sf)))


# ---- profiles ---------------------------------------------------------------------------

_NUM = ("feature_a", "feature_b", "weight", "y_target")


def _describe_sql() -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max,
  {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50, {r(f'quantile_cont({c}, 0.75)')} AS q75,
  {r(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)')} AS iqr FROM tabular"""
        for c in _NUM
    ]
    return with_blocks(("tabular",), " UNION ALL ".join(parts))


@query("describe_numeric", _describe_sql())
def describe_numeric(spark, sf):
    return rounded(tq.describe_numeric(b.tabular(spark, sf), _NUM))


@query(
    "describe_categorical",
    with_blocks(
        ("tabular",),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS n_unique,
  (SELECT {c} FROM tabular GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS top, (SELECT count(*) FROM tabular GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS freq FROM tabular"""
            for c in ("code", "sub_code", "sub_category")
        ),
    ),
)
def describe_categorical(spark, sf):
    return tq.describe_categorical(b.tabular(spark, sf), ["code", "sub_code", "sub_category"])


@query(
    "missing_summary",
    with_blocks(
        ("tabular",),
        f"""SELECT 'feature_b' AS "column", count(*) - count(feature_b) AS missing, {r('(count(*) - count(feature_b)) * 100.0 / count(*)')} AS percent FROM tabular""",
    ),
)
def missing_summary(spark, sf):
    return rounded(tq.missing_summary(b.tabular(spark, sf)))


@query(
    "duplicate_rows",
    "SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2)",
)
def duplicate_rows(spark, sf):
    return tq.duplicate_rows(b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "missing_over_time",
    with_blocks(("tabular",), f"SELECT ts_index, {r('avg(CASE WHEN feature_b IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_rate FROM tabular GROUP BY 1"),
)
def missing_over_time(spark, sf):
    return rounded(tq.missing_over_time(b.tabular(spark, sf), "feature_b"))


@query(
    "missing_drift",
    with_blocks(("tabular",), f"SELECT ts_index, {r('avg(CASE WHEN feature_b IS NULL THEN 1.0 ELSE 0.0 END) / 11.0')} AS missing_rate FROM tabular GROUP BY 1"),
)
def missing_drift(spark, sf):
    return rounded(tq.missing_drift(b.tabular(spark, sf)))


def _outlier_sql(low: str, high: str) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", CAST(sum(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count,
  {r(f'avg(CASE WHEN {c} < lo OR {c} > hi THEN 100.0 ELSE 0.0 END)')} AS percent_outliers FROM tabular, (SELECT {low.format(c=c)} AS lo, {high.format(c=c)} AS hi FROM tabular)"""
        for c in _NUM
    ]
    return with_blocks(("tabular",), " UNION ALL ".join(parts))


@query(
    "outliers_iqr",
    _outlier_sql(
        "quantile_cont({c}, 0.25) - 2.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))",
        "quantile_cont({c}, 0.75) + 2.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))",
    ),
)
def outliers_iqr(spark, sf):
    return rounded(tq.outlier_summary(b.tabular(spark, sf), _NUM, "iqr"))


@query("outliers_zscore", _outlier_sql("avg({c}) - 3 * stddev_pop({c})", "avg({c}) + 3 * stddev_pop({c})"))
def outliers_zscore(spark, sf):
    return rounded(tq.outlier_summary(b.tabular(spark, sf), _NUM, "zscore"))


@query(
    "target_correlations",
    with_blocks(
        ("tabular",),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, (SELECT {r('corr(a, z)')} FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY y_target) + (count(*) OVER (PARTITION BY y_target) - 1) / 2.0 AS z FROM tabular WHERE {c} IS NOT NULL)) AS spearman,
  (SELECT {r(f'corr(coalesce({c}, 0), y_target)')} FROM tabular) AS pearson"""
            for c in ("feature_a", "feature_b", "feature_c")
        ),
    ),
)
def target_correlations(spark, sf):
    return rounded(tq.target_correlations(b.tabular(spark, sf), ["feature_a", "feature_b", "feature_c"]))


@query(
    "weight_profile",
    with_blocks(
        ("tabular",),
        f"""SELECT {r('avg(weight)')} AS mean, {r('stddev_samp(weight)')} AS std, {r('min(weight)')} AS min, {r('max(weight)')} AS max,
  {r('corr(weight, y_target)')} AS corr_target, {r('corr(weight, abs(y_target))')} AS corr_abs_target,
  {', '.join(f'{r(f"quantile_cont(weight, {q})")} AS {n}' for n, q in (('p50', 0.5), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99), ('p999', 0.999)))} FROM tabular""",
    ),
)
def weight_profile(spark, sf):
    return rounded(tq.weight_profile(b.tabular(spark, sf)))


@query(
    "top_weight_share",
    with_blocks(
        ("tabular",),
        f"""SELECT {r('sum(CASE WHEN i <= floor(n * 0.1) THEN weight ELSE 0 END) / sum(weight)')} AS top_share FROM (
  SELECT weight, row_number() OVER (ORDER BY weight DESC) AS i, count(*) OVER () AS n FROM tabular)""",
    ),
)
def top_weight_share(spark, sf):
    return rounded(tq.top_weight_share(b.tabular(spark, sf)))


@query(
    "heaviest_time",
    with_blocks(
        ("tabular",),
        f"""SELECT ts_index, {r('w / t')} AS share FROM (SELECT ts_index, sum(weight) AS w, (SELECT sum(weight) FROM tabular) AS t FROM tabular GROUP BY 1)
ORDER BY w DESC, ts_index LIMIT 1""",
    ),
)
def heaviest_time(spark, sf):
    return rounded(tq.heaviest_time(b.tabular(spark, sf)))


@query(
    "spread_over_time",
    with_blocks(("tabular",), f"SELECT ts_index, {r('stddev_samp(weight)')} AS weight_std, {r('stddev_samp(y_target)')} AS y_target_std FROM tabular GROUP BY 1"),
)
def spread_over_time(spark, sf):
    return rounded(tq.spread_over_time(b.tabular(spark, sf), ["weight", "y_target"]))


@query(
    "target_moments",
    with_blocks(
        ("tabular",),
        f"""SELECT horizon, count(*) AS n, {r('avg(y_target)')} AS mean, {r('stddev_samp(y_target)')} AS std, {r('skewness(y_target)')} AS skew,
  {r('kurtosis(y_target)')} AS kurt FROM tabular GROUP BY 1""",
    ),
)
def target_moments(spark, sf):
    return rounded(tq.target_moments(b.tabular(spark, sf)))


@query(
    "names_per_time",
    with_blocks(("tabular",), f"SELECT horizon, {r('avg(n)')} AS avg_names FROM (SELECT horizon, ts_index, count(sub_code) AS n FROM tabular GROUP BY 1, 2) GROUP BY 1"),
)
def names_per_time(spark, sf):
    return rounded(tq.names_per_time(b.tabular(spark, sf)))


def _range_sql(value: str) -> str:
    return with_blocks(
        ("tabular",),
        f"""SELECT code, n, {r(value)} AS range FROM tabular JOIN (SELECT code, count(*) AS n FROM tabular GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) USING (code) GROUP BY 1, 2""",
    )


@query("category_ranges_iqr", _range_sql("quantile_cont(y_target, 0.75) - quantile_cont(y_target, 0.25)"))
def category_ranges_iqr(spark, sf):
    return rounded(tq.category_ranges(b.tabular(spark, sf), "code", "y_target", 10, "iqr"))


@query("category_ranges_minmax", _range_sql("max(y_target) - min(y_target)"))
def category_ranges_minmax(spark, sf):
    return rounded(tq.category_ranges(b.tabular(spark, sf), "code", "y_target", 10, "minmax"))


# ---- training ------------------------------------------------------------------------


def _trained(spark, sf):
    # 500 rounds are the operator's default; see the README for what they take.
    return tq.train_by_horizon(
        b.tabular(spark, sf).fillna(0.0, ["feature_b"]),
        ["feature_a", "feature_b", "feature_c"],
        n_folds=2,
        params={"maxIter": 12},
        patience=4,
    )


@query("train_by_horizon")
def train_by_horizon(spark, sf):
    """Out-of-fold predictions of every horizon."""
    return rounded(_trained(spark, sf)["oof"])


@query("horizon_curves")
def horizon_curves(spark, sf):
    """Weighted score after every round of every horizon and fold, and the rounds that are kept."""
    return rounded(_trained(spark, sf)["curves"])


@query("importance_summary")
def importance_summary(spark, sf):
    return rounded(tq.importance_summary(_trained(spark, sf)["importances"], 3))


@query(
    "event_sequence",
    with_blocks(("tabular",), "SELECT id, row_number() OVER (PARTITION BY sub_category ORDER BY ts_index, id) AS place FROM tabular"),
)
def event_sequence(spark, sf):
    return add_position(b.tabular(spark, sf), ["sub_category"], list(O), "place").select("id", "place")
