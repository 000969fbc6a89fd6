"""Daily mean forecasts and next-observation models."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.calendar import add_calendar_features
from gaugeworks.functions.columns import flag, is_finite, pearson
from gaugeworks.operators.features import TARGETS, checked_parts, chronological_parts, daily_forecast_features, feature_names
from gaugeworks.session import keep

BASELINES = ("training_mean", "yesterday", "last_week", "trailing_7d")
PENALTIES = (1.0, 10.0, 100.0)
FOREST = "spark_random_forest"
CANDIDATES = (*BASELINES, *[f"ridge_{p:g}" for p in PENALTIES], FOREST)


def clip_negative(prediction: Column) -> Column:
    return F.greatest(prediction, F.lit(0.0))


def forecast_panel(daily: DataFrame) -> DataFrame:
    """Features and parts for each calendar day; usable days only carry complete features and targets."""
    return chronological_parts(daily_forecast_features(daily))


def usable_long(parts: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """One line per usable day and target: part, actual and the day's own baseline predictions."""
    cells = [F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("actual"), F.col(f"{t}_lag1").alias("yesterday"),
                      F.col(f"{t}_lag7").alias("last_week"), F.col(f"{t}_past7_mean").alias("trailing_7d")) for t in targets]
    return parts.filter("usable").select("day", "part", F.explode(F.array(*cells)).alias("c")).select("day", "part", "c.*")


def baseline_predictions(parts: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """(target, model, day, part, actual, prediction) for the four baselines."""
    rows = usable_long(parts, targets)
    mean = F.avg(F.when(F.col("part") == "train", F.col("actual"))).over(Window.partitionBy("target"))  # one row per day
    rows = rows.withColumn("training_mean", mean)
    out = rows.unpivot(["target", "day", "part", "actual"], list(BASELINES), "model", "prediction")
    return out.withColumn("prediction", clip_negative(F.col("prediction")))


def regression_metrics(rows: DataFrame, by: Sequence[str] = (), actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """rows, rmse, mae, bias and r2 (NULL for a constant actual) in one aggregate."""
    a, e = F.col(actual).cast("double"), F.col(prediction).cast("double") - F.col(actual)
    spread = F.nullif(F.count(a) * F.var_pop(a), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count(a).alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        (1 - F.try_divide(F.sum(e * e), spread)).alias("r2"))


def residual_radius(rows: DataFrame, by: Sequence[str], level: float = .90, minimum: int = 20) -> DataFrame:
    """The ceil((n+1)*level)-th smallest absolute residual per group, the largest one at most."""
    if not 0 < level < 1:
        raise ValueError("the level must lie between zero and one")
    error = F.abs(F.col("actual") - F.col("prediction"))
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_e"))
    ranked = rows.withColumn("_e", error).withColumns({"_n": n, "_k": place})
    wanted = F.least(F.ceil((F.col("_n") + 1) * F.lit(level)), F.col("_n"))
    out = ranked.groupBy(*by).agg(F.max("_n").alias("residuals"), F.max(F.when(F.col("_k") == wanted, F.col("_e"))).alias("radius"))
    short = F.when(F.col("residuals") < minimum, F.raise_error(F.lit(f"at least {minimum} calibration residuals are needed")).cast("double"))
    return out.withColumn("radius", F.coalesce(short, F.col("radius")))


def with_band(rows: DataFrame, radius: DataFrame, by: Sequence[str]) -> DataFrame:
    """Prediction band cut at zero, and whether it covers the actual."""
    out = rows.join(F.broadcast(radius.select(*by, "radius")), list(by))  # one row per target and model
    low = F.greatest(F.lit(0.0), F.col("prediction") - F.col("radius"))
    return out.withColumns({"lower": low, "upper": F.col("prediction") + F.col("radius")}).withColumn(
        "covered", F.col("actual").between(F.col("lower"), F.col("upper"))).drop("radius")


def band_coverage(banded: DataFrame, by: Sequence[str]) -> DataFrame:
    return banded.groupBy(*by).agg(F.count("*").alias("days"), F.avg(F.col("covered").cast("double")).alias("coverage"),
                                   F.avg(F.col("upper") - F.col("lower")).alias("mean_width"))


def exceedances(banded: DataFrame) -> DataFrame:
    return banded.filter(~flag(F.col("covered")))


def residual_review(rows: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    """Residual moments and their lag-1 correlation; the rows are days."""
    e = F.col("actual") - F.col("prediction")
    w = Window.partitionBy(*by).orderBy(day)
    lagged = rows.withColumn("_e", e).withColumn("_p", F.lag("_e").over(w))
    return lagged.groupBy(*by).agg(F.avg("_e").alias("mean"), F.stddev_samp("_e").alias("std"), F.min("_e").alias("minimum"),
                                   F.max("_e").alias("maximum"), pearson("_e", "_p").alias("lag1_correlation"))


def _assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features")


def fit_ridge(train: DataFrame, target: str, penalty: float, columns: Sequence[str] | None = None, stats: tuple[int, float] | None = None) -> Model:
    """Ridge on population-standardised features with a free intercept.

    The sum-of-squares penalty maps to the regParam of the normal-equation solver through the row count and the
    label's population standard deviation (``stats``, looked up unless given).
    """
    n, spread = stats or train.agg(F.count(target), F.stddev_pop(target)).first()
    model = LinearRegression(featuresCol="features", labelCol=target, solver="normal", standardization=True, elasticNetParam=0.0,
                             regParam=penalty / n * (spread or 0.0))
    return Pipeline(stages=[_assembler(columns or feature_names()), model]).fit(train)


def fit_forest(train: DataFrame, target: str, columns: Sequence[str] | None = None, trees: int = 30, depth: int = 3, minimum: int = 10, seed: int = 42) -> Model:
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=minimum, seed=seed)
    # one ordered partition: the panel is a calendar, and the seed then gives the same trees every time
    return Pipeline(stages=[_assembler(columns or feature_names()), forest]).fit(train.coalesce(1).sortWithinPartitions("day"))


def model_predictions(model: Model, rows: DataFrame, target: str, name: str) -> DataFrame:
    scored = model.transform(rows)
    return scored.select(F.lit(target).alias("target"), F.lit(name).alias("model"), "day", "part", F.col(target).cast("double").alias("actual"),
                         clip_negative(F.col("prediction")).alias("prediction"))


@dataclass
class Forecasts:
    """Everything one evaluation produces; ``chosen`` and ``models`` are what a later run needs."""

    selection: DataFrame
    testing: DataFrame
    predictions: DataFrame
    chosen: dict[str, str]
    radius: dict[str, float]
    means: dict[str, float]
    models: dict[tuple[str, str], Model] = field(default_factory=dict)


def all_predictions(parts: DataFrame, targets: Sequence[str] = TARGETS, forest: bool = True, parallel: int = 4) -> tuple[DataFrame, dict[tuple[str, str], Model]]:
    """Predictions of every candidate for every usable day. The fits are independent jobs and run side by side."""
    usable = parts.filter("usable")
    train = usable.filter(F.col("part") == "train")
    row = train.agg(*[e for t in targets for e in (F.count(t), F.stddev_pop(t))]).first()
    stats = {t: (row[2 * i], row[2 * i + 1]) for i, t in enumerate(targets)}
    tasks = {(t, f"ridge_{p:g}"): (lambda t=t, p=p: fit_ridge(train, t, p, stats=stats[t])) for t in targets for p in PENALTIES}
    if forest:
        tasks |= {(t, FOREST): (lambda t=t: fit_forest(train, t)) for t in targets}
    with ThreadPoolExecutor(parallel) as pool:
        fits = {k: pool.submit(inheritable_thread_target(train.sparkSession)(fit)) for k, fit in tasks.items()}
        models = {k: f.result() for k, f in fits.items()}
    tables = [baseline_predictions(parts, targets)] + [model_predictions(m, usable, t, name) for (t, name), m in models.items()]
    return reduce(DataFrame.unionByName, tables), models


def evaluate_forecasts(daily: DataFrame, targets: Sequence[str] = TARGETS, forest: bool = True) -> Forecasts:
    """Fit on train, choose by validation RMSE, calibrate the band, and test once.

    Only the choice per target, its radius and the training means reach the driver.
    """
    parts = checked_parts(keep(forecast_panel(daily)))
    every, models = all_predictions(parts, targets, forest)
    every = keep(every)
    order = {m: i for i, m in enumerate(CANDIDATES)}
    selection = regression_metrics(every.filter(F.col("part") == "validation"), ["target", "model"])
    scores = selection.select("target", "model", "rmse").collect()  # targets x candidates lines
    chosen = {t: min((r for r in scores if r["target"] == t), key=lambda r: (r["rmse"], order[r["model"]]))["model"] for t in targets}
    picked = reduce(lambda a, b: a | b, [(F.col("target") == t) & (F.col("model") == m) for t, m in chosen.items()])
    radii = residual_radius(every.filter(picked & (F.col("part") == "calibration")), ["target", "model"])
    test = every.filter(F.col("part") == "test")
    testing = regression_metrics(test.filter(picked | F.col("model").isin(*BASELINES)), ["target", "model"]).withColumn("selected", picked)
    predictions = with_band(test.filter(picked), radii, ["target", "model"]).withColumn("origin_day", F.date_sub("day", 1))
    means = parts.filter("usable").filter(F.col("part") == "train").agg(*[F.avg(t).alias(t) for t in targets]).first().asDict()
    return Forecasts(selection, testing, predictions, chosen, {r["target"]: r["radius"] for r in radii.collect()}, means, models)


def predict_next_day(result: Forecasts, daily: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """One line per target for the day after the last, from the chosen models."""
    last = daily.agg(F.max("day").alias("day")).select(F.date_add("day", 1).alias("day"))
    tomorrow = daily_forecast_features(daily.select("day", *targets).unionByName(last, allowMissingColumns=True))
    tomorrow = tomorrow.join(F.broadcast(last), "day", "left_semi").withColumn("part", F.lit("next_day"))  # one row
    lines = []
    for t in targets:
        name = result.chosen[t]
        if (t, name) in result.models:
            line = model_predictions(result.models[(t, name)], tomorrow, t, name)
        else:
            value = {"training_mean": F.lit(result.means[t]), "yesterday": F.col(f"{t}_lag1"), "last_week": F.col(f"{t}_lag7"),
                     "trailing_7d": F.col(f"{t}_past7_mean")}[name]
            line = tomorrow.select(F.lit(t).alias("target"), F.lit(name).alias("model"), "day", "part", F.lit(None).cast("double").alias("actual"),
                                   clip_negative(value).alias("prediction"))
        r = F.lit(result.radius[t])
        lines.append(line.withColumns({"lower": F.greatest(F.lit(0.0), F.col("prediction") - r), "upper": F.col("prediction") + r}))
    out = reduce(DataFrame.unionByName, lines)
    return out.select("target", F.date_sub("day", 1).alias("origin_day"), F.col("day").alias("target_day"), F.lit(1).alias("horizon_days"), "model",
                      "prediction", "lower", "upper")


def next_observation_models(pairs: DataFrame, predictors: Sequence[str], target: str, time: str = "timestamp", forest: bool = True) -> tuple[dict[str, Model], DataFrame, str]:
    """Training mean, persistence, linear and forest models of the next reading; the best by validation RMSE.

    Returns the fitted models, the metrics per part and model, and the chosen name.
    """
    cyclic = ["hour_sin", "hour_cos", "weekday_sin", "weekday_cos"]
    features = [*predictors, *cyclic]
    rows = keep(add_calendar_features(pairs.filter(F.col("label").isNotNull()), time).select(
        "part", "label", target, *dict.fromkeys(c for c in features if c != target)).dropna())
    train = rows.filter(F.col("part") == "train")
    models: dict[str, Model] = {"linear": Pipeline(stages=[_assembler(features), LinearRegression(labelCol="label", regParam=0.1, maxIter=30)]).fit(train)}
    if forest:
        models["random_forest"] = Pipeline(stages=[_assembler(features), RandomForestRegressor(
            labelCol="label", numTrees=20, maxDepth=5, minInstancesPerNode=10, seed=42)]).fit(train)
    mean = float(train.agg(F.avg("label")).first()[0])
    held = rows.filter(F.col("part").isin("validation", "test"))
    base = held.select("part", F.col("label").alias("actual"), F.col(target).cast("double").alias("persistence"), F.lit(mean).alias("training_mean"))
    tables = [base.unpivot(["part", "actual"], ["training_mean", "persistence"], "model", "prediction")]
    tables += [m.transform(held).select("part", F.col("label").alias("actual"), F.lit(n).alias("model"), "prediction") for n, m in models.items()]
    metrics = keep(regression_metrics(reduce(DataFrame.unionByName, tables), ["part", "model"]))
    order = ["training_mean", "persistence", "linear", "random_forest"]
    scores = {r["model"]: r["rmse"] for r in metrics.filter("part = 'validation'").collect()}  # one line per model
    if not all(math.isfinite(v) for v in scores.values()):
        raise ValueError("invalid validation RMSE")
    return models, metrics, min(scores, key=lambda m: (scores[m], order.index(m)))


def prediction_check(saved: DataFrame, again: DataFrame, key: Sequence[str]) -> DataFrame:
    """Largest difference between two prediction tables joined on their key."""
    both = saved.select(*key, F.col("prediction").alias("_a")).join(again.select(*key, F.col("prediction").alias("_b")), list(key))
    return both.agg(F.count("*").alias("rows"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"))


def publication_rules(targets: Sequence[str] = TARGETS) -> list[Column]:
    """Counts of prediction lines that may not be published. Columns: kind, target, target_day, origin_day, actual,
    prediction, lower, upper."""
    def count(c: Column, name: str) -> Column:
        return F.count(F.when(c, 1)).alias(name)
    finite = is_finite("prediction") & is_finite("lower") & is_finite("upper")
    ordered = (F.col("lower") >= 0) & (F.col("lower") <= F.col("prediction")) & (F.col("prediction") <= F.col("upper"))
    test = F.col("kind") == "test"
    ahead = F.count(F.when(F.col("kind") == "next_day", 1))
    return [
        count(~flag(F.datediff("target_day", "origin_day") == 1), "horizon"), count(~finite, "nonfinite"), count(finite & ~ordered, "bounds"),
        count(test & ~(is_finite("actual") & flag(F.col("actual") >= 0)), "actual"),
        (F.count("*") - F.count_distinct("kind", "target", "target_day")).alias("duplicate_keys"),
        (F.lit(2 * len(targets)) - F.count_distinct("kind", "target")).alias("missing_targets"),
        F.abs(ahead - F.lit(len(targets))).alias("next_day_lines")]
