"""Registered queries on what follows from a plan: allocation, receipts, calendars, scenarios, rules; each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules, timegrid
from ..operators import actions, forecast, mrp, netting, quality
from ..operators import bom as bills
from ..sources import planning as p
from ..sources.written import folder
from ..streaming import events as streams
from . import projection as stock
from .registry import DEMAND, EXCESS, LOAD, ORACLE_SQL, QUERIES, SERIES36, STAGED, capacity_load, costed, flows, gross_inputs, monthly, planned, projected, query, staged

__all__ = ["ORACLE_SQL", "QUERIES"]
DAY = f"DATE '{p.AS_OF}'"


@query(f"""SELECT item_id, location_id, demand_id, qty, allocated, CASE WHEN allocated >= qty THEN 'full' WHEN allocated > 0 THEN 'partial' ELSE 'none' END AS status FROM (
  SELECT item_id, location_id, order_id * 10 + line_id AS demand_id, f.qty, greatest(0.0, least(f.qty, coalesce(on_hand, 0.0) - coalesce(sum(f.qty) OVER (PARTITION BY item_id, location_id ORDER BY order_id % 3, due, order_id * 10 + line_id, f.qty ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))) AS allocated
  FROM flows f LEFT JOIN on_hand USING (item_id, location_id) WHERE kind = 'order')""")
def allocation(spark, d):
    asked = p.flows(spark, d).where("kind = 'order'").select("item_id", "location_id", (F.col("order_id") * 10 + F.col("line_id")).alias("demand_id"), (F.col("order_id") % 3).alias("priority"), "due", "qty")
    return actions.allocate(asked, p.on_hand(spark, d).withColumnRenamed("on_hand", "supply"), ["item_id", "location_id"])


@query(f""", g AS (SELECT p_partkey AS item_id, b AS bucket, sum(coalesce(greatest(orders, forecast), 0.0)) OVER (PARTITION BY p_partkey ORDER BY b) AS upto FROM part CROSS JOIN range({p.WEEKS}) r(b) LEFT JOIN {DEMAND} x ON x.item_id = p_partkey AND x.bucket = b
), i AS (SELECT p_partkey AS item_id, coalesce(h, 0.0) - p_partkey % 4 * 5 AS free FROM part LEFT JOIN (SELECT item_id, sum(on_hand) AS h FROM on_hand GROUP BY 1) ON item_id = p_partkey
), r AS (SELECT item_id, order_id * 10 + line_id AS receipt_id, due, qty, coalesce(sum(qty) OVER (PARTITION BY item_id ORDER BY due, order_id * 10 + line_id, qty ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) + qty / 2 AS half, bucket FROM flows WHERE kind = 'supply'
), n AS (SELECT r.*, (SELECT min(g.bucket) FROM g WHERE g.item_id = r.item_id AND g.upto - free >= half - 1e-9) AS need FROM r JOIN i USING (item_id)
), a AS (SELECT *, {DAY} + CAST(need * 7 AS INT) AS proposed, ({DAY} + CAST(need * 7 AS INT)) - due AS late FROM n)
SELECT * FROM (SELECT item_id, receipt_id, qty, CASE WHEN need IS NULL THEN CASE WHEN qty > 0 AND bucket < {p.WEEKS - 1} THEN 'CANCEL' END WHEN need <> bucket AND abs(late) >= 7 THEN CASE WHEN late < 0 THEN 'RESCHEDULE_IN' ELSE 'RESCHEDULE_OUT' END END AS action, proposed FROM a) WHERE action IS NOT NULL""")
def reschedule_signals(spark, d):
    held = p.on_hand(spark, d).groupBy("item_id").agg(F.sum("on_hand").alias("on_hand"))
    items = p.items(spark, d).select("item_id", (F.col("item_id") % 4 * 5).alias("safety")).join(held, "item_id", "left")
    receipts = p.flows(spark, d).where("kind = 'supply'").select("item_id", (F.col("order_id") * 10 + F.col("line_id")).alias("receipt_id"), "due", "qty")
    return actions.reschedule(actions.needed_in(receipts, netting.consume(gross_inputs(spark, d)), items, p.WEEKS), p.AS_OF, p.WEEKS, 7)


@query("""SELECT o.order_id * 10 + o.line_id AS id, s.price FROM (SELECT * FROM lines WHERE kind = 'order') o ASOF LEFT JOIN (SELECT item_id, due, max(price) AS price FROM lines WHERE kind = 'supply' GROUP BY ALL) s ON o.item_id = s.item_id AND o.due >= s.due""")
def last_receipt_price(spark, d):
    rows = p.lines(spark, d)
    asked = rows.where("kind = 'order'").select((F.col("order_id") * 10 + F.col("line_id")).alias("id"), "item_id", "due")
    return actions.as_of(asked, rows.where("kind = 'supply'").select("item_id", "due", "price"), ["item_id"], "due", "price").select("id", "price")


def _plans(spark, d, ways):
    """Plans with more on hand and more demanded every week: (plan, item_id, standard_cost, bucket, outflows, closing)."""
    of = lambda name, on_hand, outflows: F.struct(F.lit(name).alias("plan"), F.lit(float(on_hand)).alias("more"), F.lit(float(outflows)).alias("asked"))
    each = costed(spark, d).select("*", F.explode(F.array(*(of(n, *w) for n, w in ways.items()))).alias("p")).select("*", "p.*")
    return stock.project_series(stock.more(each, F.col("on_hand") + F.col("more"), F.col("asked")), "plan", "standard_cost")


@query("""SELECT plan, count(*) FILTER (closing < 0) AS shortages, CAST(round(sum(CAST(greatest(-closing, 0) AS DECIMAL(12,3)) * u), 2) AS DOUBLE) AS shortage_value, (CAST(sum(CAST(CAST(greatest(closing, 0) AS DECIMAL(12,3)) * u * 100000 AS HUGEINT)) AS HUGEINT) + 13000) // 26000 / 100 AS stock_value, round(1 - sum(least(greatest(-closing, 0), outflows)) / sum(outflows), 6) AS fill_rate, count(*) FILTER (closing < 0) - (SELECT count(*) FROM projection WHERE closing < 0) AS more_shortages
FROM (SELECT item_id, 'base' AS plan, closing, outflows FROM projection UNION ALL SELECT item_id, 'scenario', closing + 30 - (bucket + 1), outflows + 1 FROM projection) JOIN (SELECT p_partkey AS item_id, CAST(p_retailprice AS DECIMAL(12,2)) AS u FROM part) USING (item_id) GROUP BY 1""")
def scenario_compare(spark, d):
    """The base plan, and one with 30 more on hand and one more demanded every week."""
    return actions.scenario_figures(_plans(spark, d, {"base": (0, 0), "scenario": (30, 1)}))


def _versions(spark, d):
    """Parts, a fork of them with overridden fields, and the parts as they are by now."""
    base = p.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    at = lambda where, field, value, t: base.where(where).select("p_partkey", F.lit(field).alias("field_name"), F.lit(value).alias("value"), F.lit(t).alias("at"))
    changes = at("p_partkey % 6 = 0", "p_size", "7", 1).unionByName(at("p_partkey % 12 = 0", "p_size", "9", 2)).unionByName(at("p_partkey % 10 = 0", "p_brand", "Brand#99", 1)).unionByName(at("p_partkey % 15 = 0", "p_size", "many", 1))
    now = base.withColumn("p_size", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return base, actions.override(base, changes, "p_partkey", ["p_brand", "p_size"]), now


VERSIONS = "(SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 10 = 0 THEN 'Brand#99' ELSE p_brand END AS brand, CASE WHEN p_partkey % 12 = 0 THEN 9 WHEN p_partkey % 6 = 0 AND p_partkey % 15 <> 0 THEN 7 ELSE p_size END AS size FROM part)"


@query(f"SELECT p_partkey, brand AS p_brand, size AS p_size FROM {VERSIONS}")
def scenario_override(spark, d):
    return _versions(spark, d)[1]


@query(f"SELECT p_partkey, 'p_brand' AS field_name, p_brand AS old, brand AS new FROM {VERSIONS} WHERE p_brand <> brand UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR), CAST(size AS VARCHAR) FROM {VERSIONS} WHERE p_size <> size")
def scenario_diff(spark, d):
    base, fork, _ = _versions(spark, d)
    return actions.changed_fields(base, fork, "p_partkey", ["p_brand", "p_size"])


@query(f"SELECT p_partkey, 'p_brand' AS field_name, p_brand AS old, brand AS new, false AS conflict FROM {VERSIONS} WHERE p_brand <> brand UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR), CAST(size AS VARCHAR), p_partkey % 4 = 0 AND p_size + 1 <> size FROM {VERSIONS} WHERE p_size <> size")
def scenario_promote(spark, d):
    base, fork, now = _versions(spark, d)
    return actions.mergeable(base, fork, now, "p_partkey", ["p_brand", "p_size"])


@query(LOAD + """, w AS (SELECT resource_id, CAST(day // 7 AS INT) AS week, CAST(sum(CAST(round(hours * 10000) AS BIGINT)) AS BIGINT) AS h FROM load GROUP BY ALL), u AS (SELECT *, (h * 20000 + 20000) // 40000 AS u FROM w)
SELECT resource_id, week, h / 10000 AS hours, u / 100 AS utilisation, CASE WHEN u > 20000 THEN 'critical' WHEN u > 15000 THEN 'high' WHEN u > 12000 THEN 'medium' ELSE 'low' END AS severity FROM u WHERE u > 10000""")
def capacity_overload(spark, d):
    return actions.overloads(capacity_load(spark, d), F.lit(20_000))


@query(f"""SELECT id, 'L3_QUANTITY_SUSPICIOUS' AS rule_code, 'qty' AS field_name, 'warning' AS severity FROM {STAGED} WHERE TRY_CAST(qty AS DOUBLE) > 45 UNION ALL SELECT id, 'L3_QUANTITY_NONPOSITIVE', 'qty', 'error' FROM {STAGED} WHERE TRY_CAST(qty AS DOUBLE) <= 0
UNION ALL SELECT id, 'L3_DATE_OUT_OF_RANGE', 'due', 'warning' FROM {STAGED} WHERE TRY_CAST(due AS DATE) < DATE '1993-01-01' OR TRY_CAST(due AS DATE) > DATE '1998-06-30' UNION ALL SELECT id, 'L3_ENUM', 'item', 'error' FROM {STAGED} WHERE item IN ('13', '17') UNION ALL SELECT id, 'L3_DATE_RANGE_INVERTED', 'due', 'error' FROM {STAGED} WHERE TRY_CAST(due AS DATE) < DATE '1992-06-01'""")
def dq_business(spark, d):
    found = [quality.amount("qty", 45), quality.dates_within("due", "1993-01-01", "1998-06-30"), [quality.issue("L3_ENUM", "item", F.col("item").isin("13", "17"))], quality.not_before("since", "due")]
    return quality.check_rows(staged(spark, d).withColumn("since", F.lit("1992-06-01")), "id", [r for rs in found for r in rs])


@query("""SELECT count(*) AS n, sum(CASE WHEN same THEN 1 ELSE 0 END) / count(*) AS similarity, sum(CASE WHEN same THEN 1 ELSE 0 END) / count(*) > 0.95 AS duplicate FROM (SELECT DISTINCT l_partkey, l_quantity, l_orderkey, l_linenumber, l_orderkey % 40 <> 0 AS same FROM lineitem)""")
def dq_duplicate_batch(spark, d):
    rows = p.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    before = rows.withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_orderkey") % 40 == 0, 1000).otherwise(0))
    return quality.batch_similarity(rows, before, rows.columns)


@query("SELECT count(*) FILTER (p_partkey % 13 = 0 AND p_partkey % 11 <> 0) AS inserts, count(*) FILTER (p_partkey % 7 = 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0) AS updates, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0) AS noops, count(*) FILTER (p_partkey % 11 = 0) AS deletes, round(count(*) FILTER (p_partkey % 11 = 0) / (count(*) - count(*) FILTER (p_partkey % 13 = 0 AND p_partkey % 11 <> 0)), 6) AS deletion_ratio, false AS needs_force FROM part")
def batch_diff_summary(spark, d):
    return quality.diff_summary(QUERIES["batch_diff"](spark, d))


@query(f"""SELECT item_id, unit_cost, n FROM (SELECT item_id, count(unit_cost) AS n, avg(unit_cost) AS mean, stddev_samp(unit_cost) AS sd FROM supplier_items GROUP BY 1) JOIN (SELECT p_partkey AS item_id, p_retailprice * 20 AS unit_cost FROM part) USING (item_id) WHERE n >= 3 AND CASE WHEN sd = 0 THEN unit_cost <> mean ELSE abs(unit_cost - mean) > 3 * sd END""")
def dq_price_drift(spark, d):
    now = p.items(spark, d).select("item_id", (F.col("standard_cost") * 20).alias("unit_cost"))
    return quality.drifted(now, p.supplier_items(spark, d), "item_id", "unit_cost").select("item_id", "unit_cost", "n")


@query(f"""SELECT item_id, shortages, round(2.0 * (1 + ln(1 + shortages)), 4) AS impact FROM (SELECT item_id, count(*) FILTER (has_shortage) AS shortages FROM projection GROUP BY 1)""")
def dq_impact(spark, d):
    short = F.size(F.filter("cells", lambda c: c["has_shortage"])).cast("long")
    return planned(spark, d).groupBy("item_id").agg(F.sum(short).alias("shortages")).select("item_id", "shortages", quality.impact(F.col("shortages"), 2.0).alias("impact"))


@query("""SELECT item_id, location_id, bucket, CASE WHEN closing < 0 THEN 'EXPEDITE_HIGH' WHEN closing = 0 AND outflows > 0 THEN 'RELEASE_MEDIUM' WHEN bucket * 7 <= 28 THEN 'RESCHEDULE' ELSE 'RELEASE_LOW' END AS action, CASE WHEN bucket * 7 <= 7 THEN 'FROZEN' WHEN bucket * 7 <= 28 THEN 'SLASHED' ELSE 'LIQUID' END AS zone FROM projection""")
def action_messages(spark, d):
    today = F.lit(p.AS_OF).cast("date")
    plan = projected(spark, d).withColumn("zone", timegrid.zone(F.date_add(today, F.col("bucket") * 7), today, 7, 28))
    return plan.select("item_id", "location_id", "bucket", mrp.action_class(F.col("closing"), F.col("outflows"), F.col("zone")).alias("action"), "zone")


@query(EXCESS.replace("SELECT item_id, on_hand, round(annual, 4) AS annual, CASE", "SELECT item_id, CASE", 1).replace("AS class, round(on_hand - annual / 2, 4) AS surplus", "AS class, CASE WHEN annual = 0 THEN 'STOP_BUY' ELSE 'REVIEW' END AS action", 1))
def excess_actions(spark, d):
    return QUERIES["excess_and_obsolete"](spark, d).select("item_id", "class", netting.eo_action("class").alias("action"))


@query("""SELECT order_id * 10 + line_id AS id, CASE WHEN line_id % 2 = 0 THEN 'NOT_APPLICABLE' WHEN line_id = 3 OR qty = 0 THEN 'INDETERMINATE' WHEN qty % 7 / qty <= 0.05 THEN 'AVOIDED' WHEN qty % 7 / qty >= 0.9 THEN 'MATERIALIZED' ELSE 'PARTIAL' END AS outcome FROM lines""")
def outcome_classes(spark, d):
    seen = F.when(F.col("line_id") != 3, F.col("qty") % 7)
    return p.lines(spark, d).select((F.col("order_id") * 10 + F.col("line_id")).alias("id"), quality.outcome(F.col("line_id") % 2 == 1, F.col("qty"), seen).alias("outcome"))


@query(f"""SELECT item_id, round(safety, 4) AS safety, round(CASE WHEN p_size > 0 THEN sqrt(2 * p_size * 52.0 * 50 / (p_retailprice * 0.2)) ELSE 1 END, 4) AS eoq, CAST(ceil(CASE WHEN item_id % 40 = 0 THEN 30 ELSE item_id % 40 END / 7.0) AS INT) AS lead_weeks, CASE WHEN w >= 1 THEN 0.2 WHEN w <= 0 THEN 1.0 ELSE round(1 + (0.2 - 1) * (3 * w * w - 2 * w * w * w), 6) END AS weight, CAST(greatest(0, floor((item_id % 60 - 10) / 7)) AS INT) AS week, round(70.0 / 10 * greatest(0, least(item_id % 30 + 10, 20) - greatest(item_id % 30, 10)), 6) AS prorated FROM (
  SELECT *, p_partkey AS item_id, (p_partkey % 50 - 10) / 20.0 AS w, CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.036 WHEN 2 THEN 1.282 + (0.92 - 0.9) / (0.95 - 0.9) * (1.645 - 1.282) ELSE 3.09 END * sqrt((1 + p_partkey % 6) * p_size / 4.0 * p_size / 4.0 + p_size * p_size * (p_partkey % 3 / 2.0) * (p_partkey % 3 / 2.0)) AS safety FROM part)""")
def planning_rules(spark, d):
    k, size, today = F.col("item_id"), F.col("p_size").cast("double"), F.lit(p.AS_OF).cast("date")
    level = F.element_at(F.array(*map(F.lit, (0.4, 0.85, 0.92, 0.9999))), (k % 4 + 1).cast("int"))
    at = lambda days: F.date_add(today, days.cast("int"))
    weight = timegrid.transition_weight(at(k % 50 - 10), today, F.date_add(today, 20), F.lit("sigmoid"), F.lit(1.0), F.lit(0.2))
    return p.table(spark, d, "part").withColumn("item_id", F.col("p_partkey")).select(
        "item_id",
        F.round(rules.safety_stock(size, size / 4, 1 + k % 6, k % 3 / 2, level), 4).alias("safety"),
        F.round(rules.economic_quantity(size * 52, F.lit(50.0), F.col("p_retailprice") * 0.2), 4).alias("eoq"),
        timegrid.lead_weeks((k % 40).cast("int")).alias("lead_weeks"),
        F.round(weight, 6).alias("weight"),
        timegrid.week_index(at(k % 60 - 10), today).alias("week"),
        F.round(timegrid.prorated(F.lit(70.0), at(k % 30), at(k % 30 + 10), F.date_add(today, 10), F.date_add(today, 20)), 6).alias("prorated"),
    )


@query(f"""{SERIES36}, r AS (SELECT item_id, v[i + 1] - (v[i] + v[i - 1] + v[i - 2]) / 3 AS r FROM (SELECT *, unnest(range(24, 36)) AS i FROM v)), s AS (SELECT item_id, list_sort(list(r)) AS r FROM r GROUP BY 1)
SELECT item_id, CAST(len(r) AS INT) AS n, round(r[1], 6) + 0.0 AS low, round(r[12], 6) + 0.0 AS high FROM s""")
def forecast_interval(spark, d):
    made = forecast.backtest(forecast.series(monthly(spark, d), 36), {"MA3": forecast.running_average(3)}, 24, 36)
    bounds = forecast.interval(made.select("item_id", (F.col("actual") - F.col("forecast")).alias("residual")), 0.2)
    return bounds.select("item_id", "n", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("low", "high")))


@query(f"""{SERIES36} SELECT item_id, round(list_sum(list_transform(range(1, 13), lambda i: abs(v[24 + i] - greatest(0, v[12 + i])))) / nullif(list_sum(v[25:36]), 0), 6) + 0.0 AS naive, round(1 - list_sum(list_transform(range(1, 13), lambda i: abs(v[24 + i] - list_sum(v[22:24]) / 3))) / nullif(list_sum(list_transform(range(1, 13), lambda i: abs(v[24 + i] - greatest(0, v[12 + i])))), 0), 6) + 0.0 AS value_added FROM v""")
def forecast_value_added(spark, d):
    return forecast.value_added(forecast.series(monthly(spark, d), 36), 12, 12, lambda v: forecast.moving_average(v, 3)).select("item_id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("naive", "value_added")))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS BIGINT) AS units FROM events GROUP BY ALL")
def event_stream(spark, d):
    """The event log read as a stream to its end."""
    log = p.table(spark, d, "events")
    return streams.drained(spark, streams.window_totals(spark.readStream.schema(log.schema).parquet(f"{d}/events.parque[t]")))  # a pattern: a file alone is no source of a stream


@query("SELECT * FROM projection")
def incremental_projection(spark, d):
    """A plan made before the lines of every tenth order came in, and then refreshed for the series that they touch."""
    new = F.col("l_orderkey") % 10 == 0
    before = stock.project_series(stock.series_flows(p.moves(spark, d, p.WEEKS, 7, ~new), p.WEEKS))
    return streams.refreshed(before, p.moves(spark, d, p.WEEKS, 7), p.moves(spark, d, p.WEEKS, 7, new), p.WEEKS, p.tasks(spark, d))


@query("""SELECT item_id, location_id, CAST(date_trunc('month', CAST(DATE '%s' AS DATE) + bucket * 7) AS DATE) AS period, arg_min(opening, bucket) AS opening, sum(inflows) AS inflows, sum(outflows) AS outflows, arg_max(closing, bucket) AS closing, bool_or(has_shortage) AS has_shortage, sum(shortage_qty) AS shortage_qty FROM projection GROUP BY ALL""" % p.AS_OF)
def projection_by_calendar_month(spark, d):
    return stock.roll_up(planned(spark, d), lambda bucket: timegrid.month_start(F.date_add(F.lit(p.AS_OF).cast("date"), bucket * 7)))


@query(f""", low AS (SELECT item_id, location_id, min(bucket) AS bucket, arg_min(10 - closing, bucket) AS deficit FROM projection WHERE closing < 10 GROUP BY ALL
), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY is_preferred DESC, unit_cost, supplier_id) AS n FROM supplier_items WHERE unit_cost > 0) WHERE n = 1)
SELECT item_id, location_id, supplier_id, ceil(deficit / 12) * 12 AS qty, CAST(round(CAST(ceil(deficit / 12) * 12 AS DECIMAL(12,3)) * CAST(unit_cost AS DECIMAL(12,4)), 2) AS DOUBLE) AS value, greatest({DAY}, {DAY} + bucket * 7 - lead_days) AS order_date, bucket * 7 < lead_days AS late FROM low JOIN s USING (item_id)""")
def purchase_recommendations(spark, d):
    short = stock.first_below(flows(spark, d), F.lit(10.0))
    return actions.purchases(short, p.supplier_items(spark, d), p.AS_OF, multiple=12)


@query("SELECT item_id, location_id, bucket, shortage_qty FROM projection LEFT JOIN (SELECT item_id, max(price) AS price FROM lines WHERE kind = 'transfer' GROUP BY 1) USING (item_id) WHERE has_shortage ORDER BY price DESC NULLS LAST, shortage_qty DESC, item_id, location_id, bucket LIMIT 50 OFFSET 100")
def shortage_page(spark, d):
    """A page of shortages, the dearest items first and those without a price last."""
    price = p.lines(spark, d).where("kind = 'transfer'").groupBy("item_id").agg(F.max("price").alias("price"))
    found = projected(spark, d).where("has_shortage").join(price, "item_id", "left")
    return found.orderBy(F.desc_nulls_last("price"), F.desc("shortage_qty"), "item_id", "location_id", "bucket").offset(100).limit(50).select("item_id", "location_id", "bucket", "shortage_qty")


ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)


@query(f"""{SERIES36}, f AS (SELECT item_id, a AS alpha, v[origin + 1] AS actual, list_reduce(v[1:origin], lambda s, x: a * x + (1 - a) * s) AS f FROM (SELECT *, unnest(range(24, 36)) AS origin FROM v), (SELECT unnest([{', '.join(f'CAST({a} AS DOUBLE)' for a in ALPHAS)}]) AS a)
), w AS (SELECT item_id, alpha, round(sum(abs(actual - f)) / nullif(sum(abs(actual)), 0), 6) + 0.0 AS wape FROM f GROUP BY ALL)
SELECT item_id, alpha, wape FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY wape, alpha) AS n FROM w WHERE wape IS NOT NULL) WHERE n = 1""")
def smoothing_calibration(spark, d):
    """The smoothing factor of each item that a rolling backtest finds best."""
    methods = {str(a): forecast.running_exponential(a) for a in ALPHAS}
    scored = forecast.accuracy(forecast.backtest(forecast.series(monthly(spark, d), 36), methods, 24, 36), ["item_id", "method"])
    return forecast.best_method(scored).select("item_id", F.col("method").cast("double").alias("alpha"), "wape")


@query(""", c AS (SELECT parent AS ancestor, component, 1 AS depth FROM bom UNION SELECT ancestor, bom.component, depth + 1 FROM c JOIN bom ON bom.parent = c.component
), short AS (SELECT item_id AS component, sum(shortage_qty) AS shortage FROM projection WHERE has_shortage GROUP BY 1), o AS (SELECT DISTINCT item_id AS ancestor FROM flows WHERE kind = 'order')
SELECT ancestor AS item_id, count(DISTINCT component) AS short_components, CAST(min(depth) AS INT) AS nearest FROM c JOIN short USING (component) JOIN o USING (ancestor) GROUP BY 1""")
def orders_at_risk(spark, d):
    """Ordered items that are made, at some level, of components that run short."""
    short = planned(spark, d).where(F.exists("cells", lambda c: c["has_shortage"])).select("item_id").distinct()
    ordered = p.flows(spark, d).where("kind = 'order'").select("item_id").distinct()
    return actions.affected(bills.closure(p.bom(spark, d)), short, ordered)


def _running_sql(horizon: int = 3) -> str:
    """Every candidate's forecast from every origin, its pooled error, and the best and the blend, in SQL."""
    ma = " ".join(f"UNION ALL SELECT item_id, o, v, 'MA(window={w})', CASE WHEN o >= {w} THEN list_sum(h[o - {w - 1}:o]) / {w} END FROM h" for w in (3, 6, 12))
    es = " ".join(f"UNION ALL SELECT item_id, o, v, 'EXP_SMOOTHING(alpha={a:.2f})', list_reduce(h, lambda s, x: CAST({a} AS DOUBLE) * x + (1 - CAST({a} AS DOUBLE)) * s) FROM h" for a in (0.2, 0.5, 0.8))
    return f"""{SERIES36}, h AS (SELECT item_id, v, o, v[1:o] AS h, list_filter(range(1, o + 1), lambda i: v[i] > 0) AS z FROM (SELECT *, unnest(range(1, 37)) AS o FROM v)
), f AS (SELECT item_id, o, v, 'CROSTON' AS label, CASE WHEN len(z) = 0 THEN 0 WHEN len(z) = 1 THEN list_sum(h) ELSE list_sum(h) / len(z) / ((z[len(z)] - z[1]) / (len(z) - 1)) END AS f FROM h WHERE len(list_filter(v, lambda x: x = 0)) / 36 >= 0.2 {ma} {es}
), e AS (SELECT item_id, o, label, f, list_sum(list_transform(range(0, least({horizon}, 36 - o)), lambda k: abs(v[o + k + 1] - f))) AS error, list_sum(v[o + 1 : least(o + {horizon}, 36)]) AS actual FROM f WHERE f IS NOT NULL
), c AS (SELECT item_id, label, round(sum(error) FILTER (o < 36) / nullif(sum(actual) FILTER (o < 36), 0), 9) AS wape, max(f) FILTER (o = 36) AS value FROM e GROUP BY ALL
), w AS (SELECT *, CASE WHEN wape IS NULL THEN 1.0 ELSE 1 / greatest(wape, 1e-4) END AS weight, row_number() OVER (PARTITION BY item_id ORDER BY wape NULLS LAST, label) AS n FROM c
), s AS (SELECT item_id, max(label) FILTER (n = 1) AS label, max(wape) FILTER (n = 1) AS wape, max(value) FILTER (n = 1) AS value, sum(value * weight) / sum(weight) AS ensemble FROM w GROUP BY 1)"""


def _selected(spark, d):
    return forecast.selected(forecast.evaluated(forecast.series(monthly(spark, d).where("period < 36"), 36), 3))


@query(f"{_running_sql()} SELECT item_id, label, round(wape, 6) AS wape, round(value, 6) AS value, round(ensemble, 6) AS ensemble FROM s WHERE len(label) > 0")
def forecast_auto_select(spark, d):
    """The best of seven candidates by a rolling backtest of three steps, and all of them blended."""
    r = lambda c: F.round(c, 6).alias(c)
    return _selected(spark, d).select("item_id", "label", r("wape"), r("value"), r("ensemble"))


@query(f"""{_running_sql()}, ages AS (SELECT item_id, date_diff('day', min(booked), {DAY}) AS depth, date_diff('day', max(booked), {DAY}) AS age FROM history WHERE booked < {DAY} GROUP BY 1
), parts AS (SELECT item_id, round_even(CAST(coalesce(1 / (1 + wape), 0.25) AS DECIMAL(20,10)), 4) AS accuracy, round_even(CAST(coalesce(least(1.0, depth / 365), 0.25) AS DECIMAL(20,10)), 4) AS depth, round_even(CAST(CASE WHEN age <= 7 THEN 1 ELSE 7 / age END AS DECIMAL(20,10)), 4) AS freshness, age > 7 AS stale FROM s JOIN ages USING (item_id))
SELECT item_id, CAST(round_even(CAST(accuracy * 0.5 + depth * 0.25 + freshness * 0.25 AS DECIMAL(20,10)), 4) AS DOUBLE) AS score, CAST(accuracy AS DOUBLE) AS accuracy, CAST(depth AS DOUBLE) AS depth, CAST(freshness AS DOUBLE) AS freshness, stale FROM parts""")
def forecast_confidence(spark, d):
    day = F.lit(p.AS_OF).cast("date")
    past = p.demand_history(spark, d).where(F.col("booked") < day)
    ages = past.groupBy("item_id").agg(F.datediff(day, F.min("booked")).alias("depth_days"), F.datediff(day, F.max("booked")).alias("age_days"))
    return _selected(spark, d).join(ages, "item_id").select("item_id", forecast.confidence(F.col("wape"), F.col("depth_days"), F.col("age_days")).alias("c")).select("item_id", "c.*")


@query(EXCESS.replace(f"(SELECT item_id, sum(greatest(orders, forecast)) AS g FROM {DEMAND} GROUP BY 1)", "(SELECT item_id, sum(gross) AS g FROM need GROUP BY 1)").replace("SELECT item_id, on_hand, round(annual, 4)", f", need AS (SELECT item_id, sum(greatest(orders, forecast)) AS gross FROM {DEMAND} GROUP BY 1 UNION ALL SELECT component, gross * qty_per * (1 + scrap) FROM need JOIN bom ON parent = item_id) SELECT item_id, on_hand, round(annual, 4)", 1))
def excess_with_dependents(spark, d):
    """Excess against all use: own demand and that of what an item goes into."""
    held = p.on_hand(spark, d).groupBy("item_id").agg(F.sum("on_hand").alias("on_hand"))
    own = netting.consume(gross_inputs(spark, d)).select("item_id", F.col("gross").alias("qty"))
    use = bills.explode(own, p.bom(spark, d)).withColumn("bucket", F.lit(0))
    return netting.excess(held, use, p.WEEKS)


RULES = ("LOTFORLOT", "FIXED_QTY", "EOQ", "POQ", "MIN_MAX", "MULTIPLE")


@query(f""", g AS (SELECT p_partkey AS item_id, b AS bucket, coalesce(greatest(orders, forecast), 0.0) AS net FROM part CROSS JOIN range({p.WEEKS}) r(b) LEFT JOIN {DEMAND} x ON x.item_id = p_partkey AND x.bucket = b
), a AS (SELECT g.*, list(net) OVER (PARTITION BY item_id ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead, coalesce(h, 0.0) AS stock, [{", ".join(f"'{r}'" for r in RULES)}][item_id % 6 + 1] AS rule, CAST(p_size % 8 AS DOUBLE) AS moq, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE 30.0 + p_size END AS most, CAST(p_size % 20 AS DOUBLE) AS eoq, CAST(p_size % 7 AS DOUBLE) AS multiple, CAST(1 + p_size % 4 AS INT) AS periods, CAST(p_size % 11 AS DOUBLE) AS reorder FROM g JOIN part ON p_partkey = g.item_id LEFT JOIN (SELECT item_id, sum(on_hand) AS h FROM on_hand GROUP BY 1) USING (item_id)
), l AS (SELECT *, CASE rule WHEN 'FIXED_QTY' THEN CASE WHEN moq > 0 THEN ceil(net / moq) * moq ELSE net END WHEN 'EOQ' THEN greatest(moq, CASE WHEN eoq > 0 THEN CASE WHEN net <= eoq THEN eoq ELSE ceil(net / eoq) * eoq END ELSE net END) WHEN 'POQ' THEN greatest(moq, net + coalesce(list_sum(ahead[1:periods - 1]), 0))
  WHEN 'MIN_MAX' THEN CASE WHEN most <= 0 THEN net WHEN stock < CASE WHEN reorder > 0 THEN reorder ELSE moq END THEN greatest(most - stock, 0) WHEN most - stock < net THEN net ELSE greatest(most - stock, 0) END WHEN 'MULTIPLE' THEN CASE WHEN multiple <= 0 THEN greatest(net, moq) WHEN ceil(net / multiple) * multiple < moq THEN ceil(moq / multiple) * multiple ELSE ceil(net / multiple) * multiple END ELSE greatest(net, moq) END AS lot FROM a WHERE net > 0)
SELECT item_id, CAST(bucket AS INT) AS bucket, rule, CASE WHEN most > 0 THEN least(lot, most) ELSE lot END AS lot FROM l""")
def lot_sizes(spark, d):
    """The second model's lots of all weeks with demand, by six rules."""
    nets = netting.consume(gross_inputs(spark, d)).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "gross"))).alias("found"))
    held = p.on_hand(spark, d).groupBy("item_id").agg(F.sum("on_hand").alias("stock"))
    parts = p.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("size"))
    rows = parts.join(nets, "item_id").join(held, "item_id", "left").na.fill(0.0, ["stock"])
    full = F.transform(F.sequence(F.lit(0), F.lit(p.WEEKS - 1)), lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0.0)))
    rows = rows.withColumn("nets", full).select("*", F.posexplode("nets").alias("bucket", "net")).where("net > 0")
    size = lambda n: (F.col("size") % n).cast("double")
    rule = F.element_at(F.array(*map(F.lit, RULES)), (F.col("item_id") % 6 + 1).cast("int"))
    most = F.when(F.col("size") % 3 == 0, 0.0).otherwise(30.0 + F.col("size"))
    ahead = F.slice("nets", F.col("bucket") + 2, F.lit(p.WEEKS))
    lot = mrp.lot_size(rule, F.col("net"), F.col("stock"), moq=size(8), most=most, eoq=size(20), multiple=size(7), periods=1 + F.col("size") % 4, reorder=size(11), ahead=ahead)
    return rows.select("item_id", "bucket", rule.alias("rule"), lot.alias("lot"))


@query("SELECT * FROM projection")
def streamed_projection(spark, d):
    """A written plan without the lines of every tenth order, which then come in as a stream: only partitions with series that they touch are written again."""
    new = F.col("l_orderkey") % 10 == 0
    place = f"{folder(spark)}/streams/{uuid.uuid4().hex}"
    streams.put_plan(stock.series_flows(p.moves(spark, d, p.WEEKS, 7, ~new), p.WEEKS), f"{place}/plan", 64)
    lines = spark.readStream.schema(p.table(spark, d, "lineitem").schema).parquet(f"{d}/lineitem.parque[t]")
    changes = lines.where(new).select(F.col("l_partkey").alias("item_id"), (F.col("l_suppkey") % p.LOCATIONS).alias("location_id"))
    return streams.replanned(spark, changes, p.moves(spark, d, p.WEEKS, 7), f"{place}/plan", f"{place}/state", p.WEEKS, parts=64, tasks=p.tasks(spark, d))
