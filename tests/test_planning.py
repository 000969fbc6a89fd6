import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from gaugeworks.operators import features as X
from gaugeworks.operators import fiscal as FS
from gaugeworks.operators import forecast as FC
from gaugeworks.operators import scenarios as SC
from gaugeworks.plans import environment as E
from gaugeworks.plans import planner as PL


def fiscal_rows(spark, days=30, start=dt.date(2025, 4, 1), extra=()):
    data = [("s", dt.datetime.combine(start + dt.timedelta(i), dt.time()), 100.0 + i, 25.0) for i in range(days)]
    data += [("t", dt.datetime.combine(start + dt.timedelta(i), dt.time(1)), r, 25.0) for i, r in extra]
    return FS.with_net(spark.createDataFrame(data, "sensor_id string, timestamp timestamp, revenue double, expense double"))


EVENT = (dt.date(2026, 4, 3), dt.date(2026, 4, 5), dt.date(2026, 4, 1), dt.date(2026, 4, 7))


def test_daily_and_monthly(spark):
    base = fiscal_rows(spark)
    d = FS.daily_summary(base.filter(F.col("day") != dt.date(2025, 4, 10))).orderBy("day").collect()
    assert len(d) == 30 and d[9]["revenue"] is None and d[9]["observations"] is None
    assert d[0]["net_per_observation"] == 75 and d[6]["revenue_rolling_7d"] == 103 and d[12]["revenue_rolling_7d"] is None and d[5]["revenue_rolling_7d"] is None
    m = FS.monthly_summary(base).first()
    assert m["complete_month"] and m["calendar_days"] == 30
    assert not FS.monthly_summary(base.filter(F.dayofmonth("day") > 1)).first()["complete_month"]


def test_analogues(spark):
    panel = FS.daily_summary(fiscal_rows(spark))
    w = FS.analogue_windows(panel, 2025, *EVENT)
    s = FS.analogue_summary(w)
    assert w.count() == 20 and s.count() == 15 and s.filter("analogue_windows <> 4").count() == 0
    assert w.filter("selected").select("candidate_start").distinct().count() == 1
    gap = FS.analogue_windows(FS.daily_summary(fiscal_rows(spark).filter(F.col("day") != dt.date(2025, 4, 9))), 2025, *EVENT)
    assert gap.groupBy("candidate_start").count().filter("count = 3").count() > 0
    heavy = FS.analogue_windows(FS.daily_summary(fiscal_rows(spark, extra=[(1, 1000.0)])), 2025, *EVENT).filter("historical_start = '2025-04-02'").first()
    assert heavy["revenue"] == pytest.approx((101 + 1000 + 102 + 103) / 4) and heavy["observations"] == 4
    with pytest.raises(ValueError):
        FS.require_windows(FS.analogue_windows(panel, 2024, *EVENT), "April 2024")


def test_complete_weeks(spark):
    panel = FS.daily_summary(fiscal_rows(spark))
    weeks = FS.complete_weeks(panel).filter("metric = 'revenue'")
    assert weeks.count() == 3 and set(rows(weeks, "weekend_minus_weekday")) == {(3.5,)}
    holed = FS.daily_summary(fiscal_rows(spark).filter(F.col("day") != dt.date(2025, 4, 9)))
    assert FS.complete_weeks(holed).filter("metric = 'revenue'").count() == 2


def test_event_impact(spark):
    p = spark.createDataFrame([(15000, 3, 1.1)], "attendees int, duration int, fiscal_index double")
    r = {x["scenario"]: x for x in FS.event_impact(p).collect()}["Planning"]
    assert r["overnight_visitors"] == 9750 and r["rooms_per_night"] == 5417 and r["room_nights"] == 16251
    assert r["hotel_spending"] == pytest.approx(16251 * 333.71) and r["organizer_cost"] == 500_000 + 15000 * 3 * 35
    assert r["visitor_activity"] == pytest.approx(16251 * 333.71 + 9750 * 3 * 90 * 1.1)


def forecast_days(spark, n=375, change_from=None):
    rng = np.random.default_rng(42)
    base = [(dt.date(2025, 1, 1) + dt.timedelta(i), float(100 + rng.normal()), float(25 + rng.normal())) for i in range(n)]
    if change_from is not None:
        base = [(d, r + 1000 * (i >= change_from), e) for i, (d, r, e) in enumerate(base)]
    return spark.createDataFrame(base, "day date, revenue double, expense double"), base


def test_forecast_features_use_the_past_only(spark):
    df, base = forecast_days(spark)
    f = X.daily_forecast_features(df).orderBy("day").collect()
    assert f[40]["revenue_past28_mean"] == pytest.approx(np.mean([r for _, r, _ in base[12:40]])) and f[27]["revenue_past28_mean"] is None
    changed = X.daily_forecast_features(forecast_days(spark, change_from=101)[0]).orderBy("day").collect()
    names = [n for n in X.feature_names()]
    assert all(f[i][n] == changed[i][n] for i in range(102) for n in names)


def test_partitions(spark):
    df, _ = forecast_days(spark)
    audit = {r["part"]: r["usable_days"] for r in X.partition_audit(X.checked_parts(FC.forecast_panel(df))).collect()}
    assert audit == {"train": 197, "validation": 56, "calibration": 37, "test": 57}
    with pytest.raises(ValueError):
        X.checked_parts(FC.forecast_panel(df.limit(150)))


def test_ridge_is_the_closed_form(spark):
    df, _ = forecast_days(spark)
    train = FC.forecast_panel(df).filter("usable and part = 'train'").orderBy("day")
    pdf = train.toPandas()
    x, y = pdf[X.feature_names()].to_numpy(float), pdf["revenue"].to_numpy(float)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 10 * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    got = FC.fit_ridge(train, "revenue", 10.0).stages[-1].coefficients.toArray() * x.std(0)
    assert np.allclose(got, want, atol=1e-8)


def test_evaluation_and_next_day(spark):
    df, base = forecast_days(spark)
    result = FC.evaluate_forecasts(df, forest=False)
    assert set(result.chosen) == {"revenue", "expense"} and all(r > 0 for r in result.radius.values())
    assert result.predictions.count() == 114 and result.predictions.filter("lower < 0 or lower > prediction or upper < prediction").count() == 0
    ahead = FC.predict_next_day(result, df).collect()
    assert len(ahead) == 2 and all(r["target_day"] == base[-1][0] + dt.timedelta(1) and 0 <= r["lower"] <= r["prediction"] <= r["upper"] for r in ahead)


def test_metrics_and_radius(spark):
    m = FC.regression_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "actual double, prediction double")).first()
    assert m["rmse"] == 0 and m["r2"] == 1
    assert FC.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "actual double, prediction double")).first()["r2"] is None
    errors = spark.range(30).select(F.lit("m").alias("m"), F.col("id").cast("double").alias("actual"), F.lit(0.0).alias("prediction"))
    assert FC.residual_radius(errors, ["m"]).first()["radius"] == 27  # the 28th smallest of 0..29
    with pytest.raises(Exception, match="calibration residuals"):
        FC.residual_radius(errors.limit(10), ["m"]).collect()


def draws(spark, n=400):
    rng = np.random.default_rng(1)
    low = dict(zip(SC.INPUTS, (.40, 1.3, 1.3, .35, 1, 3, 8, 80, 40, .5, 1e5, 20, .8)))
    high = dict(zip(SC.INPUTS, (.85, 2.3, 2.5, .75, 3, 12, 30, 250, 160, .9, 5e5, 70, 1.2)))
    data = [(i, *[float(rng.uniform(low[c], high[c])) for c in SC.INPUTS]) for i in range(n)]
    return spark.createDataFrame(data, "draw long, " + ", ".join(f"{c} double" for c in SC.INPUTS))


def test_scenario_invariants(spark):
    d = draws(spark)
    s = SC.simulate(d, 15000, {"NOx": None})
    assert s.count() == 400 * 27 and all(v == 0 for v in SC.invariant_violations(s, 15000).first())
    assert s.filter("NOx_private_vehicle_kg is not null").count() == 0
    nobody = SC.simulate(d, 0).agg(F.max("rooms_per_night"), F.max("private_vehicle_km"), F.max("potential_gross_visitor_receipts"), F.min("organizer_cost")).first()
    assert tuple(nobody[:3]) == (0, 0, 0) and nobody[3] > 0
    with pytest.raises(ValueError):
        SC.simulate(d.withColumn("people_per_car", F.lit(0.0)), 15000)
    with pytest.raises(ValueError):
        SC.simulate(d, -1)


def test_scenario_tables(spark):
    d = draws(spark)
    assert SC.interventions(d, 15000).count() == 81 and SC.extra_day(d, 15000).count() == 18 and SC.access_tradeoff(d, 15000).count() == 18
    spread = SC.interventions(d, 15000).filter("intervention like 'Spread%'").first()
    assert spread["peak_arriving_vehicles_per_hour_pct_median"] == pytest.approx(-100 / 3) and spread["private_vehicle_km_delta_p90"] == 0
    env = SC.stress_envelope(d, 15000)
    assert env.count() == 9 and env.filter("joint_empirical_coverage < .9").count() == 0
    assert SC.fiscal_scenarios(d, 15000).count() == 9
    plain, cut = (rows(SC.scenario_quantiles(SC.simulate(d, 15000), ["rooms_per_night", "organizer_cost"], b)) for b in (None, 100))
    assert [r[:5] for r in plain] == [r[:5] for r in cut] and np.allclose([r[5:] for r in plain], [r[5:] for r in cut])
    known = SC.capacity_screen(SC.simulate(d, 15000), {"rooms_per_night": 1})
    assert known.filter("joint_pass_fraction is not null or not rooms_per_night_exceedance_fraction = 1").count() == 0


def test_projection(spark):
    s = spark.createDataFrame([(y, 3, "hall", float(50 + i), float(i)) for i, y in enumerate((2021, 2022, 2023))], "year int, day int, location string, temperature_f double, precipitation_mm double")
    r = E.project_points(s, (2021, 2022, 2023)).first()
    assert (r["temperature_f_mean"], r["temperature_f_min"], r["temperature_f_max"], r["history_years"]) == (51, 50, 52, 3)
    for bad in (s.filter("year <> 2022"), s.unionByName(s.limit(1))):
        with pytest.raises(Exception, match="incomplete historical coverage"):
            E.project_points(bad, (2021, 2022, 2023)).collect()
    with pytest.raises(ValueError):
        E.year_range(1800)


def test_reweighting(spark):
    s = spark.createDataFrame([("2025-01", 50.0, 60.0, 70.0, 80.0, 90.0, 65.5), ("2025-02", None, 60.0, 70.0, 80.0, 90.0, None)], "month string, capacity double, fiscal double, air_quality double, weather double, energy double, suitability double")
    same = {r["month"]: r["adjusted_score"] for r in PL.reweight(s, 0).collect()}
    assert same == {"2025-01": 65.5, "2025-02": None}
    moved = {r["month"]: r["adjusted_score"] for r in PL.reweight(s, 70).collect()}
    assert moved["2025-01"] == pytest.approx(50) and moved["2025-02"] is None
    assert sum(PL.adjusted_weights(12.5).values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        PL.adjusted_weights(71)
