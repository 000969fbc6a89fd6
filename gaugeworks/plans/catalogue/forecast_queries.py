"""Forecast queries on the daily fiscal panel and on event readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import features as X
from gaugeworks.operators import forecast as FC
from gaugeworks.operators.facts import readings_panel
from gaugeworks.plans import tables as T
from gaugeworks.plans.catalogue.feature_queries import ORDER, readings
from gaugeworks.plans.registry import day, near, num, query, reported
from gaugeworks.session import keep, new_folder


def panel(spark, folder):
    return readings_panel(T.fiscal(spark, folder), "sensor_id", ["revenue", "expense"]).select("day", "revenue", "expense")


def _features(t: str) -> str:
    cells = [f"lag({t}, 1) OVER (ORDER BY d) AS {t}_lag1", f"lag({t}, 7) OVER (ORDER BY d) AS {t}_lag7"]
    for n in (7, 28):
        w = f"OVER (ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cells.append(f"CASE WHEN count({t}) {w} = {n} THEN avg({t}) {w} END AS {t}_past{n}_mean")
    return ", ".join(cells)


NAMES = [f"{t}_{s}" for t in X.TARGETS for s in ("lag1", "lag7", "past7_mean", "past28_mean")]
FEATURES = f"""{T.FISCAL_SQL}, g AS (SELECT CAST("timestamp" AS DATE) AS d, avg(revenue) AS revenue, avg(expense) AS expense FROM fiscal GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM g), (SELECT max(d) FROM g), INTERVAL 1 DAY)) AS DATE) AS d),
daily AS (SELECT * FROM cal LEFT JOIN g USING (d)), f AS (SELECT *, {_features("revenue")}, {_features("expense")}, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM daily),
p AS (SELECT *, CASE WHEN i < floor(n * 0.60::DOUBLE) THEN 'train' WHEN i < floor(n * 0.75::DOUBLE) THEN 'validation' WHEN i < floor(n * 0.85::DOUBLE) THEN 'calibration' ELSE 'test' END AS part,
  {" AND ".join(f"{c} IS NOT NULL" for c in [*NAMES, *X.TARGETS])} AS usable FROM f)"""


@query("forecast_features", f"""WITH {FEATURES} SELECT {day("d", "day")}, {", ".join(num(c, c) for c in [*X.TARGETS, *NAMES])}, {", ".join(f"CAST(isodow(d) = {i + 1} AS INT)::DOUBLE AS weekday_{i}" for i in range(1, 7))} FROM f""")
def forecast_features(spark, folder):
    return reported(X.daily_forecast_features(panel(spark, folder)))


@query("forecast_partitions", f"""WITH {FEATURES} SELECT part, count(*) AS calendar_days, count(*) FILTER (WHERE usable) AS usable_days, {day("min(d)", "first_day")}, {day("max(d)", "last_day")} FROM p GROUP BY 1""")
def forecast_partitions(spark, folder):
    return reported(X.partition_audit(X.checked_parts(FC.forecast_panel(panel(spark, folder)))))


def _line(t: str, model: str, expr: str) -> str:
    return f"SELECT '{t}' AS target, '{model}' AS model, d, part, {t} AS actual, greatest({expr}, 0) AS prediction FROM p WHERE usable"


BASE = f"""{FEATURES}, l AS ({" UNION ALL ".join(_line(t, m, e) for t in X.TARGETS for m, e in (
    ("training_mean", f"(SELECT avg({t}) FROM p WHERE usable AND part = 'train')"), ("yesterday", f"{t}_lag1"), ("last_week", f"{t}_lag7"), ("trailing_7d", f"{t}_past7_mean")))})"""


def baselines(spark, folder):
    return FC.baseline_predictions(FC.forecast_panel(panel(spark, folder)))


@query("forecast_baselines", f"""WITH {BASE} SELECT target, model, {day("d", "day")}, part, {num("actual", "actual")}, {num("prediction", "prediction")} FROM l""")
def forecast_baselines(spark, folder):
    return reported(baselines(spark, folder))


@query("forecast_metrics", f"""WITH {BASE} SELECT target, model, part, count(*) AS rows, {num("sqrt(avg(pow(prediction - actual, 2)))", "rmse")}, {num("avg(abs(prediction - actual))", "mae")}, {near("avg(prediction - actual)", "bias")},
  {near("1 - sum(pow(prediction - actual, 2)) / nullif(count(*) * var_pop(actual), 0)", "r2")} FROM l GROUP BY 1, 2, 3""")
def forecast_metrics(spark, folder):
    return reported(FC.regression_metrics(baselines(spark, folder), ["target", "model", "part"]), "bias", "r2")


RADIUS = f"""{BASE}, e AS (SELECT target, model, list_sort(list(abs(actual - prediction))) AS s, count(*) AS n FROM l WHERE part = 'calibration' GROUP BY 1, 2),
rad AS (SELECT target, model, n, s[least(CAST(ceil((n + 1) * 0.9::DOUBLE) AS BIGINT), n)] AS radius FROM e),
band AS (SELECT *, greatest(0, prediction - radius) AS lower, prediction + radius AS upper, actual BETWEEN greatest(0, prediction - radius) AND prediction + radius AS covered FROM l JOIN rad USING (target, model) WHERE part = 'test')"""


@query("residual_radius", f"""WITH {RADIUS} SELECT target, model, n AS residuals, {num("radius", "radius")} FROM rad""")
def residual_radius(spark, folder):
    return reported(FC.residual_radius(baselines(spark, folder).filter("part = 'calibration'"), ["target", "model"]))


def banded(spark, folder):
    rows = baselines(spark, folder)
    by = ["target", "model"]
    return FC.with_band(rows.filter("part = 'test'"), FC.residual_radius(rows.filter("part = 'calibration'"), by), by)


@query("band_coverage", f"""WITH {RADIUS} SELECT target, model, count(*) AS days, {num("avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END)", "coverage")}, {num("avg(upper - lower)", "mean_width")} FROM band GROUP BY 1, 2""")
def band_coverage(spark, folder):
    return reported(FC.band_coverage(banded(spark, folder), ["target", "model"]))


@query("band_exceedances", f"""WITH {RADIUS} SELECT target, model, {day("d", "day")}, {num("actual", "actual")}, {num("lower", "lower")}, {num("upper", "upper")} FROM band WHERE NOT covered""")
def band_exceedances(spark, folder):
    return reported(FC.exceedances(banded(spark, folder)).select("target", "model", "day", "actual", "lower", "upper"))


@query("residual_review", f"""WITH {BASE}, r AS (SELECT *, actual - prediction AS e, lag(actual - prediction) OVER (PARTITION BY target, model ORDER BY d) AS pe FROM l WHERE part = 'test')
SELECT target, model, {near("avg(e)", "mean")}, {num("stddev_samp(e)", "std")}, {num("min(e)", "minimum")}, {num("max(e)", "maximum")}, {near("corr(e, pe)", "lag1_correlation")} FROM r GROUP BY 1, 2""")
def residual_review(spark, folder):
    return reported(FC.residual_review(baselines(spark, folder).filter("part = 'test'"), ["target", "model"]), "mean", "lag1_correlation")


@query("forecast_ridge")
def forecast_ridge(spark, folder):
    parts = keep(FC.forecast_panel(panel(spark, folder)))
    train = parts.filter("usable and part = 'train'")
    out = None
    for p in FC.PENALTIES:
        line = FC.model_predictions(FC.fit_ridge(train, "revenue", p), parts.filter("usable"), "revenue", f"ridge_{p:g}")
        out = line if out is None else out.unionByName(line)
    return reported(FC.regression_metrics(out, ["target", "model", "part"]))


@query("forecast_forest")
def forecast_forest(spark, folder):
    parts = keep(FC.forecast_panel(panel(spark, folder)))
    model = FC.fit_forest(parts.filter("usable and part = 'train'"), "expense")
    return reported(FC.regression_metrics(FC.model_predictions(model, parts.filter("usable"), "expense", FC.FOREST), ["target", "model", "part"]))


MODELS = [f"ridge_{p:g}" for p in FC.PENALTIES] + [FC.FOREST]


@query("forecast_model_checks", f"""WITH {BASE}, m AS (SELECT unnest([{", ".join(f"'{m}'" for m in MODELS)}]) AS model)
SELECT target, m.model, part, count(*) AS rows, 0 AS missing, 0 AS negative, CASE WHEN part = 'train' THEN true END AS closer_than_mean
FROM l, m WHERE l.model = 'training_mean' GROUP BY 1, 2, 3""")
def forecast_model_checks(spark, folder):
    """What must hold for every fitted model and both targets: a prediction for each usable day, none below zero, and in training closer than the mean."""
    every, _ = FC.all_predictions(X.checked_parts(keep(FC.forecast_panel(panel(spark, folder)))))
    every = keep(every)
    squared = F.avg(F.pow(F.col("actual") - F.col("prediction"), 2))
    one = every.groupBy("target", "model", "part").agg(F.count("*").alias("rows"), F.count(F.when(F.col("prediction").isNull() | F.isnan("prediction"), 1)).alias("missing"),
                                                       F.count(F.when(F.col("prediction") < 0, 1)).alias("negative"), squared.alias("_mse"))
    mean = one.filter("model = 'training_mean'").select("target", "part", F.col("_mse").alias("_mean_mse"))
    fitted = one.filter(F.col("model").isin(MODELS)).join(mean, ["target", "part"])
    return reported(fitted.withColumn("closer_than_mean", F.when(F.col("part") == "train", F.col("_mse") < F.col("_mean_mse"))).drop("_mse", "_mean_mse"))


@query("forecast_choice_checks", f"""WITH {BASE} SELECT target, {day("max(d)", "origin_day")}, {day("max(d) + INTERVAL 1 DAY", "target_day")}, count(*) FILTER (WHERE part = 'test') AS test_days,
  true AS best_in_validation, true AS band_holds_prediction, true AS coverage_as_counted FROM l WHERE model = 'training_mean' GROUP BY 1""")
def forecast_choice_checks(spark, folder):
    """What must hold for the choice and the band: least validation RMSE, the prediction inside its band, coverage as counted from the test days."""
    daily = panel(spark, folder)
    result = FC.evaluate_forecasts(daily)
    best = result.selection.groupBy("target").agg(F.min_by("model", F.struct("rmse", F.array_position(F.array(*[F.lit(m) for m in FC.CANDIDATES]), F.col("model")))).alias("_best"))
    banded = keep(result.predictions)
    inside = F.col("actual").between(F.col("lower"), F.col("upper"))
    tested = banded.groupBy("target", "model").agg(F.count("*").alias("test_days"), F.avg(inside.cast("double")).alias("_counted"), F.bool_and(F.col("prediction").between(F.col("lower"), F.col("upper"))).alias("_in"))
    tested = tested.join(FC.band_coverage(banded, ["target", "model"]).select("target", F.col("coverage").alias("_coverage")), "target")
    ahead = FC.predict_next_day(result, daily).select("target", "origin_day", "target_day", F.col("model").alias("_ahead"), F.col("prediction").between(F.col("lower"), F.col("upper")).alias("_next_in"))
    out = tested.join(best, "target").join(ahead, "target")
    return reported(out.select("target", "origin_day", "target_day", "test_days", ((F.col("_best") == F.col("model")) & (F.col("_ahead") == F.col("model"))).alias("best_in_validation"),
                               (F.col("_in") & F.col("_next_in")).alias("band_holds_prediction"), (F.abs(F.col("_counted") - F.col("_coverage")) < 1e-12).alias("coverage_as_counted")))


@query("forecast_select")
def forecast_select(spark, folder):
    result = FC.evaluate_forecasts(panel(spark, folder))
    return reported(result.testing.join(FC.band_coverage(result.predictions, ["target", "model"]), ["target", "model"], "left"))


@query("forecast_next_day")
def forecast_next_day(spark, folder):
    daily = panel(spark, folder)
    return reported(FC.predict_next_day(FC.evaluate_forecasts(daily, forest=False), daily))


@query("forecast_next_obs")
def forecast_next_obs(spark, folder):
    r = readings(spark, folder)
    pairs = X.next_observation_pairs(r, "sensor_id", "vehicle_count", X.time_boundaries(r), ORDER)
    _, metrics, chosen = FC.next_observation_models(pairs, ["vehicle_count", "avg_speed"], "vehicle_count")
    return reported(metrics.withColumn("selected", F.col("model") == chosen))


@query("forecast_saved_check")
def forecast_saved_check(spark, folder):
    """Predictions of a saved and reloaded model against the originals, joined on the key."""
    from pyspark.ml import PipelineModel
    parts = keep(FC.forecast_panel(panel(spark, folder)))
    model = FC.fit_ridge(parts.filter("usable and part = 'train'"), "revenue", 10.0)
    path = new_folder(spark, "model")
    model.write().save(path)
    usable = parts.filter("usable")
    saved = FC.model_predictions(model, usable, "revenue", "ridge_10")
    again = FC.model_predictions(PipelineModel.load(path), usable, "revenue", "ridge_10")
    return FC.prediction_check(saved, again, ["target", "day"])
