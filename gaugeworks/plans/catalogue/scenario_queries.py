"""Scenario queries; parts serve as assumption draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import scenarios as S
from gaugeworks.plans import tables as T
from gaugeworks.plans.registry import near, num, query, reported

PEOPLE = 15000
RECIPES = {
    "visitor_fraction": (.4, .45, "u1"), "people_per_room": (1.3, 1.0, "u2"), "people_per_car": (1.3, 1.2, "u3"), "peak_arrival_fraction": (.35, .4, "u2"),
    "arrival_window_hours": (1.0, 2.0, "u1"), "venue_kwh_per_attendee_day": (3.0, 9.0, "u3"), "hotel_incremental_kwh_per_room_night": (8.0, 22.0, "u1"),
    "room_price": (80.0, 170.0, "u2"), "nonhotel_visitor_spend_per_day": (40.0, 120.0, "u3"), "local_retention_fraction": (.5, .4, "u1"),
    "event_fixed_cost": (100000.0, 400000.0, "u2"), "event_cost_per_attendee_day": (20.0, 50.0, "u3"), "access_uncertainty_multiplier": (.8, .4, "u1"),
}


def draws(spark, folder):
    u = T.table(spark, folder, "part").select(
        F.col("p_partkey").alias("draw"), ((F.col("p_retailprice") - 900) / 100).alias("u1"), (F.col("p_size") / 50).alias("u2"), (F.col("p_partkey") * 7 % 101 / 101).alias("u3"))
    return u.select("draw", *[(F.lit(a) + F.lit(b) * F.col(u)).alias(n) for n, (a, b, u) in RECIPES.items()])


def _dbl(v) -> str:
    return f"{v}::DOUBLE"


DRAWS = f"""u AS (SELECT p_partkey AS draw, (p_retailprice - 900) / 100 AS u1, p_size / 50::DOUBLE AS u2, (p_partkey * 7 % 101) / 101::DOUBLE AS u3 FROM part),
draws AS (SELECT draw, {", ".join(f"{_dbl(a)} + {_dbl(b)} * {u} AS {n}" for n, (a, b, u) in RECIPES.items())} FROM u),
grid AS (SELECT * FROM (VALUES {", ".join(f"('{i}', '{v}', '{w}', {d})" for i, v, w, d in S.catalog())}) g(scenario_id, venue, weather, days)),
venues AS (SELECT * FROM (VALUES {", ".join("('" + n + "', " + ", ".join(_dbl(x) for x in v.values()) + ")" for n, v in S.VENUES.items())}) v(venue, cs, ws, one_way, ve, fc)),
weathers AS (SELECT * FROM (VALUES {", ".join("('" + n + "', " + ", ".join(_dbl(x) for x in v.values()) + ")" for n, v in S.WEATHER.items())}) w(weather, cool, w2c))"""


def _sim(name: str, source: str, changes: dict[str, str] | None = None) -> str:
    """Outputs of ``source`` rows (draw inputs joined with the grid) as CTE ``name``."""
    x = {c: (changes or {}).get(c, c) for c in S.INPUTS}
    return f"""{name}_a AS (SELECT *, 15000 * {x["visitor_fraction"]} AS visitors, ws * (1 - w2c) AS walk_share FROM {source}),
{name}_b AS (SELECT *, ceil(visitors / {x["people_per_room"]}) AS rooms_per_night, greatest(0, least(cs * {x["access_uncertainty_multiplier"]} + ws * w2c, 1 - walk_share)) AS car_share FROM {name}_a),
{name}_c AS (SELECT *, 1 - car_share - walk_share AS transit_share, ceil(15000 * car_share / {x["people_per_car"]}) AS arriving_cars_per_day FROM {name}_b),
{name}_d AS (SELECT *, (15000 * days * {x["venue_kwh_per_attendee_day"]} * ve + rooms_per_night * days * {x["hotel_incremental_kwh_per_room_night"]}) * cool AS incremental_energy_kwh,
  rooms_per_night * days * {x["room_price"]} + visitors * days * {x["nonhotel_visitor_spend_per_day"]} AS potential_gross_visitor_receipts FROM {name}_c),
{name} AS (SELECT *, 2 * arriving_cars_per_day * one_way * days AS private_vehicle_km, arriving_cars_per_day * {x["peak_arrival_fraction"]} / {x["arrival_window_hours"]} AS peak_arriving_vehicles_per_hour,
  15000 * transit_share * {x["peak_arrival_fraction"]} / {x["arrival_window_hours"]} AS peak_transit_passengers_per_hour, rooms_per_night * days AS room_nights, incremental_energy_kwh / days AS incremental_energy_kwh_per_day,
  potential_gross_visitor_receipts * {x["local_retention_fraction"]} AS potential_retained_gross_spending, {x["event_fixed_cost"]} * fc + 15000 * days * {x["event_cost_per_attendee_day"]} AS organizer_cost FROM {name}_d)"""


ROWS = "rows AS (SELECT * FROM draws, grid JOIN venues USING (venue) JOIN weathers USING (weather))"
SIM = f"""{DRAWS}, {ROWS}, {_sim("sim", "rows")}"""
QUANT = {"p10": .1, "median": .5, "p90": .9}


@query("scenario_grid", f"""WITH {SIM} SELECT scenario_id, venue, weather, CAST(days AS BIGINT) AS duration_days, count(*) AS draws, {", ".join(num(f"avg({m})", m) for m in S.METRICS)}, {num("avg(private_vehicle_km * 0.4::DOUBLE / 1000)", "nox_kg")} FROM sim GROUP BY 1, 2, 3, 4""")
def scenario_grid(spark, folder):
    s = S.simulate(draws(spark, folder), PEOPLE, {"NOx": 0.4, "PM2.5": None})
    return reported(s.groupBy(*S.SCENARIO).agg(F.count("*").alias("draws"), *[F.avg(m).alias(m) for m in S.METRICS], F.avg("NOx_private_vehicle_kg").alias("nox_kg")))


@query("scenario_quantiles", f"""WITH {SIM}, l AS (SELECT scenario_id, venue, weather, days, metric, v FROM (SELECT scenario_id, venue, weather, days, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in S.METRICS)} FROM sim) UNPIVOT (v FOR metric IN ({", ".join(S.METRICS)})))
SELECT scenario_id, venue, weather, CAST(days AS BIGINT) AS duration_days, metric, {num("quantile_cont(v, 0.1)", "p10")}, {num("quantile_cont(v, 0.5)", "p50")}, {num("quantile_cont(v, 0.9)", "p90")} FROM l GROUP BY 1, 2, 3, 4, 5""")
def scenario_quantiles(spark, folder):
    return reported(S.scenario_quantiles(S.simulate(draws(spark, folder), PEOPLE)))


LIMITS = {"rooms_per_night": 5500, "vehicles_per_hour": 1200, "energy_kwh_per_day": 180000, "transit_passengers_per_hour": 3000}


@query("capacity_screen", f"""WITH {SIM} SELECT scenario_id, venue, weather, CAST(days AS BIGINT) AS duration_days, {", ".join(num(f"avg(CASE WHEN {S.RESOURCES[r]} > {v} THEN 1.0 ELSE 0.0 END)", f"{r}_exceedance_fraction") for r, v in LIMITS.items())},
  true AS all_constraints_assessed, {num("avg(CASE WHEN " + " AND ".join(f"{S.RESOURCES[r]} <= {v}" for r, v in LIMITS.items()) + " THEN 1.0 ELSE 0.0 END)", "joint_pass_fraction")} FROM sim GROUP BY 1, 2, 3, 4""")
def capacity_screen(spark, folder):
    return reported(S.capacity_screen(S.simulate(draws(spark, folder), PEOPLE), LIMITS))


@query("capacity_screen_unknown", f"""WITH {SIM} SELECT scenario_id, venue, weather, CAST(days AS BIGINT) AS duration_days, {num("avg(CASE WHEN rooms_per_night > 5500 THEN 1.0 ELSE 0.0 END)", "rooms_per_night_exceedance_fraction")},
  CAST(NULL AS DOUBLE) AS vehicles_per_hour_exceedance_fraction, CAST(NULL AS DOUBLE) AS energy_kwh_per_day_exceedance_fraction, CAST(NULL AS DOUBLE) AS transit_passengers_per_hour_exceedance_fraction,
  false AS all_constraints_assessed, CAST(NULL AS DOUBLE) AS joint_pass_fraction FROM sim GROUP BY 1, 2, 3, 4""")
def capacity_screen_unknown(spark, folder):
    return reported(S.capacity_screen(S.simulate(draws(spark, folder), PEOPLE), {"rooms_per_night": 5500}))


PAIR_METRICS = ("private_vehicle_km", "incremental_energy_kwh", "organizer_cost")


def _paired(m: str) -> str:
    v = f"100 * (a.{m} / b.{m} - 1)"
    return f"""SELECT a.venue, a.weather, '{m}' AS metric, {", ".join(near(f"quantile_cont({v}, {p})", f"change_{q}_pct") for q, p in QUANT.items())} FROM sim a JOIN ref b USING (draw) WHERE a.days = 3 GROUP BY 1, 2"""


@query("paired_change", f"""WITH {SIM}, ref AS (SELECT * FROM sim WHERE venue = 'Transit-focused' AND weather = 'Comfortable/dry' AND days = 3) {" UNION ALL ".join(map(_paired, PAIR_METRICS))}""")
def paired_change(spark, folder):
    return reported(S.paired_change(draws(spark, folder), PEOPLE), "change_p10_pct", "change_median_pct", "change_p90_pct")


OUTPUTS = ("private_vehicle_km", "rooms_per_night", "incremental_energy_kwh", "potential_gross_visitor_receipts", "organizer_cost")


def _ranks(columns) -> str:
    return ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in columns)


SENSITIVITY_SQL = f"""WITH {SIM}, ref AS (SELECT * FROM sim WHERE venue = 'Transit-focused' AND weather = 'Comfortable/dry' AND days = 3),
k AS (SELECT {_ranks([*S.INPUTS, *OUTPUTS])} FROM ref) {" UNION ALL ".join(f"SELECT '{o}' AS output, '{c}' AS assumption, {near(f'corr(r_{o}, r_{c})', 'rank_correlation')} FROM k" for o in OUTPUTS for c in S.INPUTS)}"""


@query("sensitivity", SENSITIVITY_SQL)
def sensitivity(spark, folder):
    return reported(S.sensitivity(draws(spark, folder), PEOPLE), "rank_correlation")


STEPS = {"rooms_per_night": "1", "peak_arriving_vehicles_per_hour": "1", "peak_transit_passengers_per_hour": "1", "incremental_energy_kwh_per_day": "1000"}
ENVELOPE_SQL = f"""WITH {SIM}, worst AS (SELECT venue, days, draw, {", ".join(f"max({m}) AS {m}" for m in STEPS)} FROM sim GROUP BY 1, 2, 3),
o AS (SELECT venue, days, count(*) AS n, {", ".join(f"list_sort(list({m})) AS l_{m}" for m in STEPS)} FROM worst GROUP BY 1, 2),
lim AS (SELECT venue, days, n, {", ".join(f"ceil(l_{m}[CAST(ceil(0.975::DOUBLE * (n - 1)) AS BIGINT) + 1] / {s}::DOUBLE) * {s} AS t_{m}" for m, s in STEPS.items())} FROM o)
SELECT venue, CAST(days AS BIGINT) AS duration_days, {", ".join(num(f"max(t_{m})", m) for m in STEPS)}, {num("avg(CASE WHEN " + " AND ".join(f"{m} <= t_{m}" for m in STEPS) + " THEN 1.0 ELSE 0.0 END)", "joint_empirical_coverage")}, count(*) AS draws
FROM worst JOIN lim USING (venue, days) GROUP BY 1, 2"""


@query("stress_envelope", ENVELOPE_SQL)
def stress_envelope(spark, folder):
    return reported(S.stress_envelope(draws(spark, folder), PEOPLE, coverage=.85))


CHANGES = {"Spread arrivals over 50% longer window": {"arrival_window_hours": "(arrival_window_hours * 1.5::DOUBLE)"}, "Increase car occupancy by 0.5 people": {"people_per_car": "(people_per_car + 0.5::DOUBLE)"},
           "Reduce venue electricity intensity by 20%": {"venue_kwh_per_attendee_day": "(venue_kwh_per_attendee_day * 0.8::DOUBLE)"}}


def _effects(i: int, name: str) -> str:
    cells = []
    for m in S.CHANGED:
        for q, p in QUANT.items():
            cells += [near(f"quantile_cont(n.{m} - b.{m}, {p})", f"{m}_delta_{q}"), near(f"quantile_cont(100 * (n.{m} - b.{m}) / nullif(b.{m}, 0), {p})", f"{m}_pct_{q}")]
    return f"""SELECT b.scenario_id, b.venue, b.weather, CAST(b.days AS BIGINT) AS duration_days, '{name}' AS intervention, {", ".join(cells)} FROM sim b JOIN n{i} n USING (scenario_id, draw) GROUP BY 1, 2, 3, 4"""


@query("interventions", f"""WITH {SIM}, {", ".join(_sim(f"n{i}", "rows", c) for i, c in enumerate(CHANGES.values()))} {" UNION ALL ".join(_effects(i, n) for i, n in enumerate(CHANGES))}""")
def interventions(spark, folder):
    out = S.interventions(draws(spark, folder), PEOPLE)
    return reported(out, *[c for c in out.columns if "_delta_" in c or "_pct_" in c])


EXTRA = ("organizer_cost", "potential_gross_visitor_receipts", "room_nights", "incremental_energy_kwh", "private_vehicle_km")


@query("extra_day", f"""WITH {SIM} SELECT a.venue, a.weather, CAST(a.days AS BIGINT) AS from_days, CAST(b.days AS BIGINT) AS to_days, {", ".join(num(f"quantile_cont(b.{m} - a.{m}, {p})", f"{m}_{q}") for m in EXTRA for q, p in QUANT.items())}
FROM sim a JOIN sim b ON a.draw = b.draw AND a.venue = b.venue AND a.weather = b.weather AND b.days = a.days + 1 GROUP BY 1, 2, 3, 4""")
def extra_day(spark, folder):
    return reported(S.extra_day(draws(spark, folder), PEOPLE))


ACCESS = ("private_vehicle_km", "peak_arriving_vehicles_per_hour", "peak_transit_passengers_per_hour", "organizer_cost")


@query("access_tradeoff", f"""WITH {SIM} SELECT a.venue, a.weather, CAST(a.days AS BIGINT) AS duration_days, 'Car-oriented' AS reference,
  {", ".join(num(f"quantile_cont(a.{m} - b.{m}, 0.5)", f"{m}_median_delta") + ", " + num(f"quantile_cont(100 * (a.{m} - b.{m}) / b.{m}, 0.5)", f"{m}_median_pct_change") for m in ACCESS)}
FROM sim a JOIN sim b ON a.draw = b.draw AND b.venue = 'Car-oriented' AND a.weather = b.weather AND a.days = b.days WHERE a.venue <> 'Car-oriented' GROUP BY 1, 2, 3""")
def access_tradeoff(spark, folder):
    return reported(S.access_tradeoff(draws(spark, folder), PEOPLE))


@query("fiscal_scenarios", f"""WITH {SIM}, s AS (SELECT * FROM sim WHERE weather = 'Comfortable/dry' AND days = 3) {" UNION ALL ".join(f"SELECT venue, '{m}' AS metric, " + num(f"quantile_cont({m}, 0.1)", "p10") + ", " + num(f"quantile_cont({m}, 0.5)", "p50") + ", " + num(f"quantile_cont({m}, 0.9)", "p90") + ", count(*) AS draws FROM s GROUP BY 1" for m in S.FISCAL)}""")
def fiscal_scenarios(spark, folder):
    return reported(S.fiscal_scenarios(draws(spark, folder), PEOPLE))


@query("invariants", f"""WITH {SIM} SELECT count(*) FILTER (WHERE abs(car_share + walk_share + transit_share - 1) > 1e-9) AS mode_shares, CAST(0 AS BIGINT) AS attendee_days,
  count(*) FILTER (WHERE room_nights <> rooms_per_night * days) AS room_nights, count(*) FILTER (WHERE private_vehicle_km < 0) AS vehicle_km,
  (SELECT count(*) FROM (SELECT max(rooms_per_night) - min(rooms_per_night) AS d FROM sim GROUP BY draw, weather, days) WHERE d > 0) AS rooms_by_venue FROM sim""")
def invariants(spark, folder):
    return reported(S.invariant_violations(S.simulate(draws(spark, folder), PEOPLE), PEOPLE))
