"""Registered queries on calendars and resources: working days, rough-cut capacity, capable-to-promise, relief of overloads; each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capacity, supply
from ..sources import planning as p
from . import projection as stock
from .registry import LOAD, PROMISE, atp, capacity_load, query

DAY = f"DATE '{p.AS_OF}'"
RESOURCES, PER_DAY, FIRST, LAST = 7, 60.0, 3, 100
HOURS = 10.0

#: A location's days are those on which its customers' orders were booked, some at half their capacity; a resource's overrides are transfers of its items.
CALENDAR = f""", cal AS (SELECT location_id, day, n > 0 AS works, least(n, 2) / 2.0 AS factor FROM (SELECT l.location_id, {DAY} - 7 + CAST(t.i AS INT) AS day, count(o_orderkey) AS n FROM range({p.LOCATIONS}) l(location_id) CROSS JOIN range(210) t(i) LEFT JOIN orders ON o_custkey % {p.LOCATIONS} = l.location_id AND CAST(o_orderdate AS DATE) = {DAY} - 7 + CAST(t.i AS INT) GROUP BY ALL)
), overrides AS (SELECT item_id % {RESOURCES} AS resource_id, due AS day, sum(qty) AS capacity FROM lines WHERE kind = 'transfer' GROUP BY ALL
), jobs_load AS (SELECT item_id % {RESOURCES} AS resource_id, due AS day, sum(qty) AS load FROM lines WHERE kind = 'supply' AND item_id IN (SELECT parent FROM bom) GROUP BY ALL)"""


def today():
    return F.lit(p.AS_OF).cast("date")


def calendar(spark, d):
    grid = spark.range(p.LOCATIONS).select(F.col("id").alias("location_id"), F.explode(F.sequence(F.date_sub(today(), 7), F.date_add(today(), 202))).alias("day"))
    booked = p.table(spark, d, "orders").select((F.col("o_custkey") % p.LOCATIONS).alias("location_id"), F.col("o_orderdate").cast("date").alias("day")).groupBy("location_id", "day").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(booked, ["location_id", "day"], "left").select("location_id", "day", (n > 0).alias("works"), (F.least(n, F.lit(2)) / 2.0).alias("factor"))


def resources(spark):
    return spark.range(RESOURCES).select(F.col("id").alias("resource_id"), (F.col("id") % p.LOCATIONS).alias("location_id"), F.lit(PER_DAY).alias("per_day"))


def overrides(spark, d):
    moved = p.lines(spark, d, (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "N"))
    return moved.groupBy((F.col("item_id") % RESOURCES).alias("resource_id"), F.col("due").alias("day")).agg(F.sum("qty").alias("capacity"))


def work(spark, d):
    """resource_id, day, qty of what is to be made."""
    made = p.bom(spark, d).select(F.col("parent").alias("item_id")).distinct()
    due = p.lines(spark, d, F.col("l_returnflag") == "R").join(made, "item_id", "left_semi")
    return due.select((F.col("item_id") % RESOURCES).alias("resource_id"), F.col("due").alias("day"), "qty")


@query(f"""SELECT order_id * 10 + line_id AS id, list_filter(list_transform(range(1, 61), lambda i: due + CAST(i AS INT)), lambda x: isodow(x) < 6 AND NOT (location_id = 0 AND day(x) = 1))[line_id] AS moved FROM flows WHERE kind = 'order'""")
def working_days(spark, d):
    span = F.explode(F.sequence(today(), F.date_add(today(), 7 * p.WEEKS + 61))).alias("day")
    closed = spark.range(p.LOCATIONS).select(F.col("id").alias("location_id"), span).where("weekday(day) >= 5 or (location_id = 0 and dayofmonth(day) = 1)")
    rows = p.flows(spark, d).where("kind = 'order'").select((F.col("order_id") * 10 + F.col("line_id")).alias("id"), "location_id", "due", "line_id")
    return capacity.add_working_days(rows, closed, "due", "line_id").select("id", "moved")


@query(f"""{CALENDAR}, open AS (SELECT t.i AS i, l.location_id, {DAY} + CAST(t.i AS INT) AS day, sum(CASE WHEN works IS NOT FALSE THEN 1 ELSE 0 END) OVER (PARTITION BY l.location_id ORDER BY t.i) AS n, works IS NOT FALSE AS works FROM range({p.LOCATIONS}) l(location_id) CROSS JOIN range(800) t(i) LEFT JOIN cal ON cal.location_id = l.location_id AND cal.day = {DAY} + CAST(t.i AS INT))
SELECT id, o.day AS moved FROM (SELECT order_id * 10 + line_id AS id, f.location_id, n + CAST(qty AS INT) * 2 AS target FROM flows f JOIN open ON open.location_id = f.location_id AND day = due WHERE kind = 'order') x JOIN open o ON o.location_id = x.location_id AND o.n = target AND works""")
def long_lead_dates(spark, d):
    """Twice as many working days on as an order has units, past the calendar's end too."""
    closed = calendar(spark, d).where("not works").select("location_id", "day")
    rows = p.flows(spark, d).where("kind = 'order'").select((F.col("order_id") * 10 + F.col("line_id")).alias("id"), "location_id", "due", (F.col("qty").cast("int") * 2).alias("steps"))
    return capacity.add_working_days(rows, closed, "due", "steps").select("id", "moved")


@query(f"""{CALENDAR}, w AS (SELECT order_id * 10 + line_id AS id, location_id, {DAY} - 5 AS a, due - CAST(line_id AS INT) AS b FROM flows WHERE kind IN ('order', 'supply')), c AS (SELECT id, w.location_id, a, b, count(*) FILTER (works) AS n FROM w LEFT JOIN cal ON cal.location_id = w.location_id AND w.location_id <> 4 AND day BETWEEN a AND b GROUP BY ALL)
SELECT w.id, w.b, CASE WHEN n > 0 THEN n ELSE (SELECT count(*) FROM range(200) t(i) WHERE a + CAST(i AS INT) <= c.b AND isodow(a + CAST(i AS INT)) < 6) END AS working_days FROM w JOIN c USING (id, location_id, a, b)""")
def days_to_due(spark, d):
    """Working days from before the horizon to just before each line is due, one location without a calendar."""
    rows = p.flows(spark, d).where("kind in ('order', 'supply')").select((F.col("order_id") * 10 + F.col("line_id")).alias("id"), "location_id", F.date_sub(today(), 5).alias("a"), F.date_sub("due", F.col("line_id")).alias("b"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").cast("int").alias("lines"))  # an order's line may come several times: its days are all of those lines'
    counted = capacity.count_working_days(rows, calendar(spark, d).where("location_id <> 4"), "a", "b", "lines")
    return counted.select("id", "b", "working_days", F.explode(F.sequence(F.lit(1), F.col("lines")))).drop("col")


def _rough(grain: str) -> str:
    start = f"date_trunc('{grain}', {DAY} + {FIRST})"
    return f"""{CALENDAR}, days AS (SELECT r.i AS resource_id, CAST({start} AS DATE) + CAST(t.i AS INT) AS day FROM range({RESOURCES}) r(i), range(140) t(i) WHERE CAST({start} AS DATE) + CAST(t.i AS INT) <= {DAY} + {LAST}
), cap AS (SELECT resource_id, d.day, CASE WHEN o.capacity IS NOT NULL AND d.day >= {DAY} + {FIRST} THEN o.capacity WHEN isodow(d.day) > 5 THEN 0.0 WHEN works IS FALSE THEN 0.0 ELSE {PER_DAY} * coalesce(nullif(factor, 0), 1.0) END AS capacity, CASE WHEN d.day >= {DAY} + {FIRST} THEN coalesce(load, 0.0) ELSE 0.0 END AS load
  FROM days d LEFT JOIN overrides o USING (resource_id, day) LEFT JOIN cal ON cal.location_id = d.resource_id % {p.LOCATIONS} AND cal.day = d.day LEFT JOIN jobs_load j USING (resource_id, day)
), b AS (SELECT resource_id, CAST(date_trunc('{grain}', day) AS DATE) AS period, max(day) AS period_end, sum(load) AS load, sum(capacity) AS capacity FROM cap GROUP BY ALL)
SELECT resource_id, period, period_end, round(load, 4) AS load, round(capacity, 4) AS capacity, round(CASE WHEN capacity > 0 THEN load / capacity * 100 ELSE 0 END, 2) AS utilization_pct, CASE WHEN capacity > 0 THEN load / capacity * 100 ELSE 0 END > 100 AS overloaded FROM b"""


def rough_cut(spark, d, grain):
    """From a day within a bucket on: that whole bucket's capacity counts, but load and overrides only from the day on."""
    first, last = F.date_add(today(), FIRST), F.date_add(today(), LAST)
    within = F.col("day").between(first, last)
    days = capacity.daily(resources(spark), capacity.bucket_of(first, grain), last, overrides(spark, d).where(within), calendar(spark, d))
    return capacity.rough_cut(days, work(spark, d).where(within), last, grain)


@query(_rough("week"))
def rough_cut_weekly(spark, d):
    return rough_cut(spark, d, "week")


@query(_rough("month"))
def rough_cut_monthly(spark, d):
    return rough_cut(spark, d, "month")


CTP = f"""{PROMISE}{CALENDAR}, q AS (SELECT order_id || '-' || line_id || '-' || item_id || '-' || location_id AS request_id, item_id, location_id, sum(qty) AS qty, 3 AS request_day FROM flows WHERE kind = 'forecast' AND bucket < 3 GROUP BY order_id, line_id, item_id, location_id
), needs AS (SELECT p_partkey AS item_id, p_partkey % {RESOURCES} AS resource_id FROM part UNION SELECT parent, component % {RESOURCES} FROM bom
), free AS (SELECT r.i AS resource_id, CAST(t.i AS INT) AS day, coalesce(o.capacity, {PER_DAY}) AS capacity, coalesce(load, 0.0) AS load FROM range({RESOURCES}) r(i) CROSS JOIN range(28) t(i) LEFT JOIN overrides o ON o.resource_id = r.i AND o.day = {DAY} + CAST(t.i AS INT) LEFT JOIN jobs_load j ON j.resource_id = r.i AND j.day = {DAY} + CAST(t.i AS INT))"""


def _ctp_inputs(spark, d):
    asked = p.flows(spark, d).where("kind = 'forecast' and bucket < 3").groupBy("order_id", "line_id", "item_id", "location_id").agg(F.sum("qty").alias("qty"))
    asked = asked.select(F.concat_ws("-", "order_id", "line_id", "item_id", "location_id").alias("request_id"), "item_id", "location_id", "qty", F.lit(3).alias("request_day"))
    own = p.items(spark, d).select("item_id", (F.col("item_id") % RESOURCES).alias("resource_id"))
    needs = own.unionByName(p.bom(spark, d).select(F.col("parent").alias("item_id"), (F.col("component") % RESOURCES).alias("resource_id")))
    number = lambda rows: rows.withColumn("day", F.datediff("day", today()))
    days = capacity.daily(resources(spark), today(), F.date_add(today(), 27), overrides(spark, d))
    return asked, needs, number(days), number(work(spark, d))


@query(f"""{CTP}, x AS (SELECT request_id, q.item_id, q.location_id, q.qty, min(day) FILTER (closing >= q.qty) AS full_day, max(day) FILTER (closing > 0) AS last_day FROM q JOIN atp ON q.item_id = atp.item_id AND q.location_id = atp.location_id AND day >= request_day GROUP BY ALL
), y AS (SELECT request_id, x.item_id, qty, coalesce(full_day, last_day) AS day, CASE WHEN full_day IS NOT NULL THEN qty ELSE coalesce(closing, 0.0) END AS promised FROM x LEFT JOIN atp ON x.item_id = atp.item_id AND x.location_id = atp.location_id AND atp.day = last_day
), z AS (SELECT request_id, y.day, promised, CAST(count(*) AS INT) AS resources, CAST(count(*) FILTER (load + qty > capacity) AS INT) AS violations, max(round((load + qty) / capacity * 100, 4)) FILTER (load + qty > capacity) AS overload_pct FROM y JOIN needs USING (item_id) JOIN free ON free.resource_id = needs.resource_id AND free.day = coalesce(y.day, 3) GROUP BY ALL)
SELECT request_id, day, promised, CASE WHEN promised > 0 THEN resources END AS resources, CASE WHEN promised > 0 THEN violations END AS violations, CASE WHEN promised > 0 THEN overload_pct END AS overload_pct, promised > 0 AND violations = 0 AS feasible FROM z""")
def capable_to_promise(spark, d):
    asked, needs, days, load = _ctp_inputs(spark, d)
    promised = supply.promise(atp(spark, d), asked).withColumns({"qty": F.col("promised") + F.col("backorder"), "request_day": F.lit(3)})
    return capacity.capable(promised, needs, days, load).select("request_id", "day", "promised", "resources", "violations", "overload_pct", "feasible")


@query(f"""{CTP}, least AS (SELECT item_id, day, min(capacity - load) AS free FROM needs JOIN free USING (resource_id) GROUP BY ALL)
SELECT request_id, min(atp.day) FILTER (closing >= qty AND free >= qty) AS feasible_day FROM q LEFT JOIN atp ON atp.item_id = q.item_id AND atp.location_id = q.location_id AND atp.day BETWEEN request_day AND request_day + 20 LEFT JOIN least ON least.item_id = q.item_id AND least.day = atp.day GROUP BY 1""")
def first_feasible_day(spark, d):
    asked, needs, days, load = _ctp_inputs(spark, d)
    return capacity.first_feasible(asked, stock.promise_series(p.moves(spark, d, 28, 1), 28), needs, days, load, 21)


@query(f"""{LOAD}, over AS (SELECT resource_id, day, hours - {HOURS} AS excess FROM load WHERE hours > {HOURS}), s AS (SELECT resource_id, id AS order_id, CAST(due_day AS INT) AS due_day, h / 10000 / greatest(1, CAST(ceil(h / 10000 / 8.0) AS INT)) AS share, greatest(1, CAST(ceil(h / 10000 / 8.0) AS INT)) AS took FROM j
), c AS (SELECT o.resource_id, o.day, excess, order_id, sum(share) AS hours, max(due_day) AS due_day FROM over o JOIN s ON s.resource_id = o.resource_id AND due_day >= o.day AND due_day < o.day + took + 2 GROUP BY ALL
), freed AS (SELECT *, coalesce(sum(hours) OVER (PARTITION BY resource_id, day ORDER BY due_day DESC, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM c)
SELECT resource_id, day, order_id, round(hours, 6) AS hours, due_day, CASE WHEN excess <= 8.0 AND day + 1 <= least(day + 10, {7 * p.WEEKS}) THEN day + 1 ELSE least(day + 10, {7 * p.WEEKS}) END AS to_day FROM freed WHERE freed < excess""")
def overload_relief(spark, d):
    """Which orders to move off the days on which a resource has more than HOURS to do."""
    load = capacity_load(spark, d)
    over = load.where(F.col("hours") > HOURS).select("resource_id", "day", (F.col("hours") - HOURS).alias("excess"))
    ops = spark.createDataFrame([(0, 1, 0.5, 0.2), (0, 2, 1.0, 0.3), (1, 1, 0.25, 0.5)], "routing long, sequence int, setup double, run double")
    jobs = p.flows(spark, d).where("kind = 'order'").join(F.broadcast(ops), F.col("item_id") % 2 == F.col("routing"))
    hours = F.round((F.col("setup") + F.col("run") * F.col("qty")) * 10000) / 10000
    jobs = jobs.select((F.col("item_id") % 7).alias("resource_id"), (F.col("order_id") * 10 + F.col("line_id")).alias("order_id"), F.datediff("due", today()).alias("due_day"), hours.alias("hours"))
    return capacity.relief(over, jobs, 8.0, 7 * p.WEEKS, 10).withColumn("hours", F.round("hours", 6))
