"""Registered planning queries, each with DuckDB SQL for the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, timegrid
from ..operators import bom as bills
from ..operators import demand, forecast, mrp, netting, quality, supply
from ..sources import planning as p
from . import projection as stock

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The inputs of sources.planning, in SQL.
WITH = f"""WITH RECURSIVE lines AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_id, l_partkey AS item_id, l_suppkey % {p.LOCATIONS} AS location_id, l_suppkey AS supplier_id, l_quantity AS qty, l_extendedprice AS price,
    CASE WHEN l_returnflag = 'R' THEN 'supply' WHEN l_returnflag = 'A' THEN 'forecast' WHEN l_linenumber = 7 THEN 'transfer' ELSE 'order' END AS kind, CAST(l_shipdate AS DATE) AS due FROM lineitem
), on_hand AS (SELECT item_id, location_id, CAST(floor(sum(qty) / 5) AS DOUBLE) AS on_hand FROM lines WHERE kind = 'supply' AND due < DATE '{p.AS_OF}' - {p.LATE} GROUP BY ALL
), flows AS (SELECT *, greatest(0, CAST(floor(date_diff('day', DATE '{p.AS_OF}', due) / 7.0) AS INT)) AS bucket FROM lines WHERE (due >= DATE '{p.AS_OF}' OR kind = 'supply' AND due >= DATE '{p.AS_OF}' - {p.LATE}) AND due < DATE '{p.AS_OF}' + {7 * p.WEEKS}
), moves AS (SELECT item_id, location_id, kind, bucket, qty FROM flows WHERE kind <> 'forecast' UNION ALL SELECT item_id, location_id, kind, CAST(b AS INT), qty / {p.SPAN} * (least(due + {p.SPAN}, DATE '{p.AS_OF}' + CAST(7 * b + 7 AS INT)) - greatest(due, DATE '{p.AS_OF}' + CAST(7 * b AS INT)))
  FROM lines, range({p.WEEKS}) r(b) WHERE kind = 'forecast' AND due < DATE '{p.AS_OF}' + CAST(7 * b + 7 AS INT) AND due + {p.SPAN} > DATE '{p.AS_OF}' + CAST(7 * b AS INT)
), history AS (SELECT l.*, CAST(o_orderdate AS DATE) AS booked, c_nationkey AS state, c_mktsegment AS channel, o_orderpriority AS order_type, o_orderstatus FROM lines l JOIN orders ON order_id = o_orderkey JOIN customer ON o_custkey = c_custkey
), supplier_items AS (SELECT item_id, supplier_id, (CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) * 200 + CAST(sum(qty) AS BIGINT)) // (2 * CAST(sum(qty) AS BIGINT)) / 10000 AS unit_cost, CAST(7 + supplier_id % 28 AS INT) AS lead_days, supplier_id % 10 = 0 AS is_preferred FROM lines GROUP BY ALL
), bom AS (SELECT a.p_partkey AS parent, b.p_partkey AS component, CAST(1 + a.p_partkey % 3 AS DOUBLE) AS qty_per, CASE WHEN b.p_partkey % 2 = 0 THEN 0.05 ELSE 0.0 END AS scrap FROM part a JOIN part b ON b.p_partkey IN (2 * a.p_partkey + 1, 2 * a.p_partkey + 2)
), sums AS (SELECT item_id, location_id, bucket, sum(qty) FILTER (kind = 'supply') AS s, sum(qty) FILTER (kind = 'order') AS o, sum(qty) FILTER (kind = 'forecast') AS f, sum(qty) FILTER (kind = 'transfer') AS t FROM moves GROUP BY ALL
), grid AS (SELECT * FROM (SELECT item_id, location_id FROM sums UNION SELECT item_id, location_id FROM on_hand), (SELECT CAST(range AS INT) AS bucket FROM range({p.WEEKS}))
), io AS (SELECT item_id, location_id, bucket, coalesce(on_hand, 0.0) AS on_hand, coalesce(s, 0.0) AS inflows, greatest(coalesce(f, 0.0), coalesce(o, 0.0)) + coalesce(t, 0.0) AS outflows FROM grid LEFT JOIN on_hand USING (item_id, location_id) LEFT JOIN sums USING (item_id, location_id, bucket)
), projection AS (SELECT item_id, location_id, bucket, closing - inflows + outflows AS opening, inflows, outflows, closing, closing < -1e-9 AS has_shortage, CASE WHEN closing < -1e-9 THEN -closing ELSE 0.0 END AS shortage_qty
  FROM (SELECT *, on_hand + sum(inflows - outflows) OVER (PARTITION BY item_id, location_id ORDER BY bucket) AS closing FROM io)
)"""


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{WITH}{sql}" if sql.startswith(",") else f"{WITH}\n{sql}"
        return f

    return register


def flows(spark: SparkSession, d: str, beside: DataFrame | None = None) -> DataFrame:
    return stock.series_flows(p.moves(spark, d, p.WEEKS, 7), p.WEEKS, beside)


def projected(spark: SparkSession, d: str) -> DataFrame:
    return stock.project_series(flows(spark, d))


def planned(spark: SparkSession, d: str) -> DataFrame:
    return stock.planned_series(flows(spark, d))


def costed(spark: SparkSession, d: str) -> DataFrame:
    """The flows with their item's standard_cost, which meets whole series."""
    return flows(spark, d, p.items(spark, d).select("item_id", "standard_cost"))


@query("SELECT * FROM projection")
def projection(spark, d):
    return projected(spark, d)


@query("SELECT item_id, location_id, bucket, CASE WHEN closing < -1e-9 THEN 'stockout' ELSE 'below_safety_stock' END AS class, CASE WHEN closing < -1e-9 THEN -closing ELSE 20 - closing END AS qty, CAST(round(CAST(CASE WHEN closing < -1e-9 THEN -closing ELSE 20 - closing END AS DECIMAL(12,3)) * 7 * CAST(coalesce(p_retailprice, 1) AS DECIMAL(12,2)), 2) AS DOUBLE) AS severity FROM projection LEFT JOIN part ON p_partkey = item_id WHERE closing < 20")
def shortages_per_site(spark, d):
    return stock.shortages(stock.project_series(costed(spark, d), "standard_cost"), F.lit(20.0), per_site=True)


@query("SELECT item_id, location_id, count(*) FILTER (has_shortage) AS shortage_buckets, sum(shortage_qty) AS total_shortage, min(closing) AS lowest FROM projection GROUP BY ALL")
def portfolio(spark, d):
    return stock.portfolio(planned(spark, d))


@query("SELECT item_id, location_id, bucket // 4 AS period, arg_min(opening, bucket) AS opening, sum(inflows) AS inflows, sum(outflows) AS outflows, arg_max(closing, bucket) AS closing, bool_or(has_shortage) AS has_shortage, sum(shortage_qty) AS shortage_qty FROM projection GROUP BY ALL")
def projection_by_month(spark, d):
    return stock.roll_up(planned(spark, d), lambda bucket: F.floor(bucket / 4).cast("int"))


@query("SELECT item_id, location_id, bucket, part, CASE WHEN part = 6 THEN inflows - 6 * floor(inflows / 7) ELSE floor(inflows / 7) END AS inflows, CASE WHEN part = 6 THEN outflows - 6 * floor(outflows / 7) ELSE floor(outflows / 7) END AS outflows, opening + CASE WHEN part = 6 THEN inflows - outflows ELSE (part + 1) * (floor(inflows / 7) - floor(outflows / 7)) END AS closing FROM projection, (SELECT CAST(range AS INT) AS part FROM range(7))")
def projection_by_day(spark, d):
    return stock.split_flat(projected(spark, d), 7)


@query(""", b AS (SELECT item_id, location_id, bucket, opening, inflows, outflows, closing + CASE WHEN item_id % 50 = 0 AND bucket = 3 THEN 1 ELSE 0 END AS closing, has_shortage <> (item_id % 70 = 0 AND bucket = 5) AS has_shortage FROM projection), c AS (SELECT *, lag(closing) OVER (PARTITION BY item_id, location_id ORDER BY bucket) AS last FROM b)
SELECT 'balance' AS invariant, item_id, location_id, bucket FROM c WHERE abs(opening + inflows - outflows - closing) > 1e-6 UNION ALL SELECT 'chain', item_id, location_id, bucket FROM c WHERE abs(last - opening) > 1e-6 UNION ALL SELECT 'flag', item_id, location_id, bucket FROM c WHERE has_shortage <> (closing < -1e-9)""")
def broken_invariants(spark, d):
    """A projection with wrong closings in one bucket and wrong flags in another, of some items."""
    broken = projected(spark, d).withColumn("closing", F.col("closing") + F.when((F.col("item_id") % 50 == 0) & (F.col("bucket") == 3), 1.0).otherwise(0.0))
    return stock.broken_invariants(broken.withColumn("has_shortage", F.col("has_shortage") != ((F.col("item_id") % 70 == 0) & (F.col("bucket") == 5))))


@query("SELECT item_id, location_id, min(bucket) AS bucket, arg_min(10 - closing, bucket) AS deficit FROM projection WHERE closing < 10 GROUP BY ALL")
def first_shortage(spark, d):
    return stock.first_below(flows(spark, d), F.lit(10.0))


@query("""SELECT item_id, location_id, bucket, CASE WHEN base THEN 'resolved' ELSE 'new' END AS change FROM (
  SELECT item_id, location_id, bucket, closing < -1e-9 AS base, closing - (bucket + 1) + 30 < -1e-9 AS scenario FROM projection) WHERE base <> scenario""")
def shortage_delta(spark, d):
    """A scenario with 30 more on hand and one more demanded every week."""
    return stock.shortage_delta(flows(spark, d), F.col("on_hand") + 30, 1.0)


@query("SELECT item_id, location_id, bucket, CASE WHEN s < 100 THEN 'low' WHEN s <= 1000 THEN 'medium' ELSE 'high' END AS band FROM (SELECT *, round(CAST(shortage_qty AS DECIMAL(12,3)) * 7 * CAST(p_retailprice AS DECIMAL(12,2)), 2) AS s FROM projection JOIN part ON p_partkey = item_id) WHERE has_shortage ORDER BY s DESC, item_id, location_id, bucket LIMIT 100")
def worst_shortages(spark, d):
    found = stock.shortages(stock.project_series(costed(spark, d), "standard_cost"), F.lit(0.0), per_site=False)
    top = found.orderBy(F.desc("severity"), "item_id", "location_id", "bucket").limit(100)
    return top.select("item_id", "location_id", "bucket", stock.severity_band(F.col("severity")).alias("band"))


@query(f"SELECT order_id, line_id, item_id, qty, booked FROM history WHERE kind IN ('order', 'forecast') AND booked >= DATE '{p.AS_OF}' - 365 AND booked < DATE '{p.AS_OF}'")
def business_demand(spark, d):
    return demand.business_demand(p.demand_history(spark, d), p.AS_OF, 365).select("order_id", "line_id", "item_id", "qty", "booked")


PRICES = f"SELECT item_id, sum(qty) AS units, sum(CAST(round(price * 100) AS BIGINT)) / 100 AS value, (CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) * 200 + CAST(sum(qty) AS BIGINT)) // (2 * CAST(sum(qty) AS BIGINT)) / 10000 AS asp FROM history WHERE booked >= DATE '{p.AS_OF}' - INTERVAL 12 MONTH AND booked < DATE '{p.AS_OF}' GROUP BY 1 HAVING sum(qty) > 0"


@query(PRICES)
def selling_price(spark, d):
    return demand.selling_price(p.demand_history(spark, d), p.AS_OF)


@query(f"SELECT count(asp) AS n, median(asp) AS median, min(asp) AS lowest, max(asp) AS highest FROM ({PRICES})")
def price_summary(spark, d):
    return demand.price_summary(demand.selling_price(p.demand_history(spark, d), p.AS_OF))


@query(f"SELECT item_id, max(booked) AS last_booked, greatest(0, date_diff('day', max(booked), DATE '{p.AS_OF}')) AS age_days FROM history GROUP BY 1")
def demand_freshness(spark, d):
    return demand.freshness(p.demand_history(spark, d), p.AS_OF)


@query("""SELECT item_id, due, coalesce("end", due + CAST(coalesce(gap, 7) AS INT)) AS "end", qty FROM (SELECT item_id, due, qty, lead(due) OVER w AS "end" FROM (SELECT item_id, due, sum(qty) AS qty FROM lines WHERE kind = 'forecast' GROUP BY ALL) WINDOW w AS (PARTITION BY item_id ORDER BY due))
  LEFT JOIN (SELECT item_id, g[len(g) // 2 + 1] AS gap FROM (SELECT item_id, list_sort(list(n - due)) AS g FROM (SELECT item_id, due, lead(due) OVER (PARTITION BY item_id ORDER BY due) AS n FROM (SELECT DISTINCT item_id, due FROM lines WHERE kind = 'forecast')) WHERE n IS NOT NULL GROUP BY 1)) USING (item_id)""")
def forecast_periods(spark, d):
    return demand.period_ends(p.lines(spark, d).where("kind = 'forecast'"))


@query("SELECT *, CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS class FROM (SELECT item_id, qty, row_number() OVER w AS rank, round(sum(qty) OVER (w ROWS UNBOUNDED PRECEDING) / sum(qty) OVER (), 6) AS share FROM (SELECT item_id, sum(qty) AS qty FROM lines GROUP BY 1) WINDOW w AS (ORDER BY qty DESC, item_id))")
def pareto(spark, d):
    return demand.pareto(p.lines(spark, d).groupBy("item_id").agg(F.sum("qty").alias("qty")))


@query(f"""SELECT item_id, active_days, span, zero_ratio, idle, qty, class, CASE class WHEN 'cold_start' THEN 'MOVING_AVERAGE' WHEN 'intermittent' THEN 'CROSTON' ELSE 'AUTO' END AS method FROM (
  SELECT *, CASE WHEN active_days < 3 THEN 'cold_start' WHEN idle > 365 / 3 THEN 'end_of_life' WHEN zero_ratio >= 0.9 THEN 'intermittent' ELSE 'regular' END AS class FROM (
    SELECT item_id, count(DISTINCT booked) AS active_days, date_diff('day', min(booked), max(booked)) + 1 AS span, round(1 - count(DISTINCT booked) / (date_diff('day', min(booked), max(booked)) + 1), 6) AS zero_ratio, date_diff('day', max(booked), DATE '{p.AS_OF}') AS idle, sum(qty) AS qty
    FROM history WHERE kind IN ('order', 'forecast') AND booked >= DATE '{p.AS_OF}' - 365 AND booked < DATE '{p.AS_OF}' GROUP BY 1))""")
def series_features(spark, d):
    return demand.series_features(p.demand_history(spark, d), p.AS_OF, 365)


@query("SELECT channel, round(sum(price) FILTER (qty > 0) / sum(qty), 4) AS price FROM history GROUP BY 1")
def weighted_price(spark, d):
    return p.with_customers(p.demand_history(spark, d), spark, d).groupBy("channel").agg(F.round(demand.weighted_mean(F.col("price") / F.col("qty"), F.col("qty")), 4).alias("price"))


def gross_inputs(spark: SparkSession, d: str) -> DataFrame:
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("qty")).otherwise(0.0)).alias("orders" if kind == "order" else "forecast")
    return p.moves(spark, d, p.WEEKS, 7).where("kind IN ('order', 'forecast')").groupBy("item_id", "bucket").agg(of("order"), of("forecast"))


DEMAND = "(SELECT item_id, bucket, coalesce(sum(qty) FILTER (kind = 'order'), 0.0) AS orders, coalesce(sum(qty) FILTER (kind = 'forecast'), 0.0) AS forecast FROM moves WHERE kind IN ('order', 'forecast') GROUP BY ALL)"


@query(f"SELECT * FROM (SELECT item_id, bucket, CASE WHEN bucket < 4 THEN orders ELSE greatest(orders, forecast) END AS gross FROM {DEMAND}) WHERE gross <> 0")
def forecast_consumption(spark, d):
    return netting.consume(gross_inputs(spark, d), fence=4)


@query(f"SELECT item_id, bucket, CASE WHEN bucket < 4 THEN greatest(orders, forecast) ELSE forecast END AS consumed FROM {DEMAND}")
def forecast_consumption_weekly(spark, d):
    return netting.consume_weekly(gross_inputs(spark, d), fence=4)


@query()
def forecast_consumption_windowed(spark, d):
    return netting.consume_windowed(gross_inputs(spark, d), window=2, fence=2)


EXCESS = f"""SELECT item_id, on_hand, round(annual, 4) AS annual, CASE WHEN annual = 0 THEN 'OBSOLETE' ELSE 'EXCESS' END AS class, round(on_hand - annual / 2, 4) AS surplus FROM (
  SELECT item_id, on_hand, coalesce(g, 0.0) * 52 / 26 AS annual FROM (SELECT item_id, sum(on_hand) AS on_hand FROM on_hand GROUP BY 1) LEFT JOIN (SELECT item_id, sum(greatest(orders, forecast)) AS g FROM {DEMAND} GROUP BY 1) USING (item_id)) WHERE on_hand > 0 AND (annual = 0 OR on_hand > annual / 2)"""


@query(EXCESS)
def excess_and_obsolete(spark, d):
    held = p.on_hand(spark, d).groupBy("item_id").agg(F.sum("on_hand").alias("on_hand"))
    return netting.excess(held, netting.consume(gross_inputs(spark, d)), p.WEEKS)


LEVELS = "SELECT item_id, CAST(max(llc) AS INT) AS llc FROM (SELECT p_partkey AS item_id, 0 AS llc FROM part UNION ALL SELECT item_id, llc FROM walk) GROUP BY 1"
WALK = ", walk AS (SELECT component AS item_id, 1 AS llc FROM bom UNION SELECT component, llc + 1 FROM walk JOIN bom ON parent = item_id)"


@query(f"{WALK} {LEVELS}")
def low_level_codes(spark, d):
    return bills.low_level_codes(p.items(spark, d), p.bom(spark, d))


@query(", c AS (SELECT parent AS ancestor, component, 1 AS depth FROM bom UNION SELECT ancestor, bom.component, depth + 1 FROM c JOIN bom ON bom.parent = c.component) SELECT ancestor, component, CAST(min(depth) AS INT) AS depth FROM c GROUP BY ALL")
def bom_closure(spark, d):
    return bills.closure(p.bom(spark, d))


@query(", need AS (SELECT item_id, sum(qty) AS gross, 0 AS depth FROM flows WHERE kind = 'order' GROUP BY 1 UNION ALL SELECT component, gross * qty_per * (1 + scrap), depth + 1 FROM need JOIN bom ON parent = item_id) SELECT item_id, round(sum(gross), 3) AS gross FROM need GROUP BY 1")
def bom_explosion(spark, d):
    need = p.flows(spark, d).where("kind = 'order'").groupBy("item_id").agg(F.sum("qty").alias("qty"))
    return bills.explode(need, p.bom(spark, d)).select("item_id", F.round("gross", 3).alias("gross"))


@query(""", paths AS (SELECT parent AS item_id, component, qty_per * (1 + scrap) AS per FROM bom UNION ALL SELECT paths.item_id, bom.component, per * qty_per * (1 + scrap) FROM paths JOIN bom ON bom.parent = paths.component)
SELECT item_id, round(sum(per * p_retailprice), 2) AS cost FROM paths JOIN part ON p_partkey = component WHERE component NOT IN (SELECT parent FROM bom) GROUP BY 1 UNION ALL SELECT p_partkey, round(p_retailprice, 2) FROM part WHERE p_partkey NOT IN (SELECT parent FROM bom)""")
def cost_rollup(spark, d):
    parts, edges = p.items(spark, d), p.bom(spark, d)
    return bills.cost_rollup(parts, edges, bills.low_level_codes(parts, edges)).select("item_id", F.round("cost", 2).alias("cost"))


def planning_parameters(spark: SparkSession, d: str) -> DataFrame:
    edges = p.bom(spark, d)
    levels = bills.low_level_codes(p.items(spark, d), edges)
    held = p.on_hand(spark, d).groupBy("item_id").agg(F.sum("on_hand").alias("on_hand"))
    made = edges.select(F.col("parent").alias("item_id")).distinct().withColumn("is_make", F.lit(True))
    rule = F.element_at(F.array(*map(F.lit, ("L4L", "POQ", "EOQ", "MIN_MAX", "FIXED_QTY"))), (F.col("item_id") % 5 + 1).cast("int"))
    return levels.join(held, "item_id", "left").join(made, "item_id", "left").select(
        "item_id", "llc", F.coalesce("is_make", F.lit(False)).alias("is_make"), F.coalesce("on_hand", F.lit(0.0)).alias("on_hand"), (F.col("item_id") % 4 * 5).cast("double").alias("safety"),
        (7 + F.col("item_id") % 21).cast("int").alias("lead_days"), rule.alias("lot_rule"), F.lit(3).alias("periods"), F.lit(40.0).alias("eoq"), F.lit(60.0).alias("top"), F.lit(5.0).alias("moq"), F.lit(0.0).alias("multiple"), F.lit(0.0).alias("most"),
    )


@query()
def mrp_cascade(spark, d):
    gross = netting.consume(gross_inputs(spark, d)).select("item_id", "bucket", F.col("gross").alias("qty"))
    receipts = p.flows(spark, d).where("kind = 'supply'").select("item_id", "bucket", "qty")
    return mrp.cascade(planning_parameters(spark, d), gross, receipts, p.bom(spark, d), p.WEEKS)


@query(f"SELECT item_id, location_id, bucket, CAST(ceil((15 - closing) / 12) * 12 AS DOUBLE) AS qty, greatest(DATE '{p.AS_OF}' + bucket * 7 - 14, DATE '{p.AS_OF}') AS order_date FROM projection WHERE closing < 15")
def simple_orders(spark, d):
    return mrp.simple_orders(projected(spark, d), F.lit(15.0), F.lit(12.0), 14, p.AS_OF)


@query(""", s AS (SELECT item_id, lead_days, row_number() OVER (PARTITION BY item_id ORDER BY is_preferred DESC, unit_cost, supplier_id) AS n FROM supplier_items)
SELECT item_id, runway, CASE WHEN runway - lead_days >= 0 THEN 'RECOVERABLE' WHEN runway - lead_days >= -14 THEN 'TIGHT' WHEN lead_days IS NULL THEN 'NO_SOURCE' ELSE 'CRITICAL' END AS class
FROM (SELECT item_id, min(bucket) * 7 AS runway FROM projection WHERE has_shortage GROUP BY 1) LEFT JOIN (SELECT item_id, lead_days FROM s WHERE n = 1) USING (item_id)""")
def shortage_scan(spark, d):
    best = p.supplier_items(spark, d).groupBy("item_id").agg(F.min_by("lead_days", F.struct(~F.col("is_preferred"), "unit_cost", "supplier_id")).alias("lead"))
    short = F.try_element_at(F.filter("cells", lambda c: c["has_shortage"]), F.lit(1))["bucket"]
    first = planned(spark, d).select("item_id", short.alias("bucket")).groupBy("item_id").agg((F.min("bucket") * 7).alias("runway")).where("runway is not null")  # a filter before would plan each series twice
    return first.join(best, "item_id", "left").select("item_id", "runway", mrp.reorder_class(F.col("lead"), F.col("runway")).alias("class"))


@query("SELECT item_id, supplier_id, unit_cost FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY is_preferred DESC, unit_cost, supplier_id) AS n FROM supplier_items WHERE unit_cost > 0) WHERE n = 1")
def best_supplier(spark, d):
    own = p.supplier_items(spark, d).where("unit_cost > 0")
    return own.groupBy("item_id").agg(F.min_by(F.struct("supplier_id", "unit_cost"), F.struct(~F.col("is_preferred"), "unit_cost", "supplier_id")).alias("b")).select("item_id", "b.*")


@query("SELECT item_id, location_id, on_hand - coalesce(used, 0) - 5 AS excess FROM on_hand LEFT JOIN (SELECT item_id, location_id, sum(qty) AS used FROM flows WHERE kind = 'order' GROUP BY ALL) USING (item_id, location_id) WHERE on_hand - coalesce(used, 0) - 5 > 0")
def location_excess(spark, d):
    return supply.location_excess(p.on_hand(spark, d), p.flows(spark, d).where("kind = 'order'"), 5.0)


def lanes(spark: SparkSession, d: str) -> DataFrame:
    pairs = [(a, b) for a in range(p.LOCATIONS) for b in range(p.LOCATIONS) if a != b]
    generic = [(None, a, b, 1 if (a * b) % 3 else 2, 1 + (a + b) % 2, float(1 + a % 3), float(b % 3), None if b % 2 else 40.0) for a, b in pairs]
    own = [(i, 0, 1, 1, 1, 5.0, 0.0, None) for i in range(1, 20)]
    return spark.createDataFrame(generic + own, "item_id long, source long, dest long, priority int, lead int, multiple double, least double, most double")


@query()
def transfer_signals(spark, d):
    """Deficits of what is on hand against demand alone: receipts that are expected don't count."""
    low = stock.first_below(_without_inflows(flows(spark, d)), F.lit(5.0))
    excess = supply.location_excess(p.on_hand(spark, d), p.flows(spark, d).where("kind = 'order'"), 5.0)
    return supply.transfers(excess, low, lanes(spark, d))


@query(""", s AS (SELECT item_id, location_id, sum(qty) AS qty FROM history WHERE kind IN ('order', 'forecast') GROUP BY ALL), r AS (SELECT item_id, location_id, CAST(round_even(CAST(qty AS DECIMAL(20,4)) / sum(qty) OVER (PARTITION BY item_id), 8) AS DECIMAL(12,8)) AS pct FROM s)
SELECT item_id, location_id, CAST(CASE WHEN row_number() OVER (PARTITION BY item_id ORDER BY pct DESC, location_id) = 1 THEN pct + 1 - sum(pct) OVER (PARTITION BY item_id) ELSE pct END AS DOUBLE) AS pct FROM r""")
def split_shares(spark, d):
    return supply.split_shares(p.demand_history(spark, d).where("kind IN ('order', 'forecast')").groupBy("item_id", "location_id").agg(F.sum("qty").alias("qty")))


PROMISE = f""", promised AS (SELECT item_id, location_id, greatest(0, date_diff('day', DATE '{p.AS_OF}', due)) AS day, coalesce(sum(qty) FILTER (kind = 'supply'), 0.0) AS supply, coalesce(sum(qty) FILTER (kind = 'order'), 0.0) AS demand FROM flows WHERE kind IN ('supply', 'order') AND due < DATE '{p.AS_OF}' + 28 GROUP BY ALL
), g AS (SELECT * FROM (SELECT item_id, location_id FROM promised UNION SELECT item_id, location_id FROM on_hand), (SELECT range AS day FROM range(28))
), atp AS (SELECT item_id, location_id, CAST(day AS INT) AS day, coalesce(supply, 0.0) AS supply, coalesce(demand, 0.0) AS demand, coalesce(on_hand, 0.0) + sum(coalesce(supply, 0.0) - coalesce(demand, 0.0)) OVER (PARTITION BY item_id, location_id ORDER BY day) AS closing FROM g LEFT JOIN promised USING (item_id, location_id, day) LEFT JOIN on_hand USING (item_id, location_id))"""


def _without_inflows(series: DataFrame) -> DataFrame:
    return series.withColumn("cells", F.transform("cells", lambda c: c.withField("inflows", F.lit(0.0))))


def atp(spark: SparkSession, d: str) -> DataFrame:
    return stock.promise_buckets(p.moves(spark, d, 28, 1), 28)


@query(f"{PROMISE} SELECT * FROM atp")
def available_to_promise(spark, d):
    return atp(spark, d)


@query(f"""{PROMISE}, q AS (SELECT order_id * 10 + line_id AS request_id, item_id, location_id, qty, 3 AS request_day FROM flows WHERE kind = 'forecast' AND bucket = 0
), x AS (SELECT request_id, q.item_id, q.location_id, q.qty, min(day) FILTER (closing >= q.qty) AS full_day, max(day) FILTER (closing > 0) AS last_day FROM q JOIN atp ON q.item_id = atp.item_id AND q.location_id = atp.location_id AND day >= request_day GROUP BY ALL
) SELECT request_id, x.item_id, x.location_id, coalesce(full_day, last_day) AS day, CASE WHEN full_day IS NOT NULL THEN qty ELSE coalesce(closing, 0.0) END AS promised, qty - CASE WHEN full_day IS NOT NULL THEN qty ELSE coalesce(closing, 0.0) END AS backorder, full_day = 3 AS on_time FROM x LEFT JOIN atp ON x.item_id = atp.item_id AND x.location_id = atp.location_id AND atp.day = last_day""")
def order_promise(spark, d):
    asked = p.flows(spark, d).where("kind = 'forecast' and bucket = 0").select((F.col("order_id") * 10 + F.col("line_id")).alias("request_id"), "item_id", "location_id", "qty", F.lit(3).alias("request_day"))
    return supply.promise(atp(spark, d), asked)


LOAD = f""", ops AS (SELECT * FROM (VALUES (0, 1, 5000, 2000), (0, 2, 10000, 3000), (1, 1, 2500, 5000)) t(routing, sequence, setup, run)
), j AS (SELECT order_id * 10 + line_id AS id, item_id % 7 AS resource_id, sequence, CAST(setup + run * qty AS BIGINT) AS h, date_diff('day', DATE '{p.AS_OF}', due) AS due_day FROM flows JOIN ops ON routing = item_id % 2 WHERE kind = 'order'
), k AS (SELECT *, greatest(1, (h + 79999) // 80000) AS days FROM j
), f AS (SELECT *, CAST(due_day - sum(days) OVER (PARTITION BY id ORDER BY sequence DESC) + 1 AS BIGINT) AS first FROM k
), load AS (SELECT resource_id, CAST(day AS INT) AS day, (CAST(sum(part) AS BIGINT) + 50000) // 100000 / 10000 AS hours FROM (SELECT resource_id, unnest(range(first, first + days)) AS day, h * 100000 // days AS part FROM f) WHERE day >= 0 GROUP BY ALL)"""


@query(f"{LOAD} SELECT * FROM load")
def capacity_load(spark, d):
    ops = spark.createDataFrame([(0, 1, 0.5, 0.2), (0, 2, 1.0, 0.3), (1, 1, 0.25, 0.5)], "routing long, sequence int, setup double, run double")
    jobs = p.flows(spark, d).where("kind = 'order'").select((F.col("order_id") * 10 + F.col("line_id")).alias("order_id"), (F.col("item_id") % 7).alias("resource_id"), (F.col("item_id") % 2).alias("routing_id"), "qty", F.datediff("due", F.lit(p.AS_OF).cast("date")).alias("due_day"))
    return supply.backward_load(jobs, F.broadcast(ops))


POINTS = f"(SELECT item_id, CAST(date_diff('month', DATE '1995-01-01', booked) AS INT) AS period, sum(qty) AS qty FROM history WHERE booked < DATE '{p.AS_OF}' GROUP BY ALL)"


def monthly(spark: SparkSession, d: str) -> DataFrame:
    booked = p.demand_history(spark, d).where(F.col("booked") < F.lit(p.AS_OF).cast("date"))
    return booked.select("item_id", ((F.year("booked") - 1995) * 12 + F.month("booked") - 1).alias("period"), "qty")


SERIES36 = f""", m AS {POINTS}, v AS (SELECT item_id, list_transform(range(36), lambda i: coalesce(map_extract(q, CAST(i AS INT))[1], 0.0)) AS v FROM (SELECT item_id, map_from_entries(list((period, qty))) AS q FROM m GROUP BY 1))"""


@query(f"""{SERIES36}
SELECT item_id, round(list_sum(v[34:36]) / 3, 6) AS average, round(list_reduce(v, lambda a, x: 0.3 * x + 0.7 * a), 6) AS smoothed, round(CASE WHEN len(z) = 0 THEN 0 WHEN len(z) = 1 THEN list_sum(v) ELSE list_sum(v) / len(z) / ((z[len(z)] - z[1]) / (len(z) - 1)) END, 6) AS croston FROM (SELECT *, list_filter(range(1, 37), lambda i: v[i] > 0) AS z FROM v)""")
def forecast_methods(spark, d):
    data = forecast.series(monthly(spark, d), 36)
    v = F.col("values")
    r = lambda c, n: F.round(c, 6).alias(n)
    return data.select("item_id", r(forecast.moving_average(v, 3), "average"), r(forecast.exponential(v, 0.3), "smoothed"), r(forecast.croston(v), "croston"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    methods = {"MA3": forecast.running_average(3), "ES_0.3": forecast.running_exponential(0.3), "CROSTON": forecast.running_croston}
    return forecast.accuracy(forecast.backtest(forecast.series(monthly(spark, d), 36), methods, 24, 36), ["item_id", "method"])


SCORED = f"""{SERIES36}, h AS (SELECT item_id, origin, v[origin + 1] AS actual, v[1:origin] AS h FROM (SELECT *, unnest(range(24, 36)) AS origin FROM v)
), z AS (SELECT *, list_filter(range(1, origin + 1), lambda i: h[i] > 0) AS z FROM h
), f AS (SELECT item_id, 'MA3' AS method, actual, (h[origin - 2] + h[origin - 1] + h[origin]) / 3 AS f FROM h UNION ALL SELECT item_id, 'ES_0.3', actual, list_reduce(h, lambda a, x: 0.3 * x + 0.7 * a) FROM h
  UNION ALL SELECT item_id, 'CROSTON', actual, CASE WHEN len(z) = 0 THEN 0 WHEN len(z) = 1 THEN list_sum(h) ELSE list_sum(h) / len(z) / ((z[len(z)] - z[1]) / (len(z) - 1)) END FROM z
), e AS (SELECT *, actual - f AS e, abs(actual) + abs(f) AS b FROM f
), scored AS (SELECT item_id, method, round(avg(CASE WHEN actual <> 0 THEN abs(e) / abs(actual) * 100 ELSE 0 END), 6) + 0.0 AS mape, round(sum(e), 6) + 0.0 AS bias, round(avg(abs(e)), 6) + 0.0 AS mad, round(avg(e * e), 6) + 0.0 AS mse,
  round(sum(abs(e)) / nullif(sum(abs(actual)), 0), 6) + 0.0 AS wape, round(avg(CASE WHEN b <> 0 THEN 2 * abs(e) / b END), 6) + 0.0 AS smape, round(sum(e) / nullif(avg(abs(e)), 0), 4) + 0.0 AS tracking FROM e GROUP BY ALL)"""


@query(f"{SCORED} SELECT * FROM scored")
def forecast_backtest(spark, d):
    return scored(spark, d)


@query(f"{SCORED} SELECT item_id, method, wape FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY wape, method) AS n FROM scored WHERE wape IS NOT NULL) WHERE n = 1")
def forecast_selection(spark, d):
    return forecast.best_method(scored(spark, d))


@query(f""", m AS {POINTS}, s AS (SELECT item_id, period % 12 AS position, sum(qty) AS q FROM m WHERE period < 36 GROUP BY ALL) SELECT item_id, CAST(position AS INT) AS position, round(q * 12 / sum(q) OVER (PARTITION BY item_id), 6) AS "index" FROM s""")
def seasonal_index(spark, d):
    return forecast.seasonal_profile(monthly(spark, d).where("period < 36"), 12, 36)


@query(f""", c AS (SELECT p_brand AS node, bucket AS period, sum(qty) AS qty FROM flows JOIN part ON p_partkey = item_id WHERE kind = 'forecast' GROUP BY ALL), w AS (SELECT p_brand AS node, p_partkey AS leaf, coalesce(q, 0.0) AS weight FROM part LEFT JOIN (SELECT item_id, sum(qty) AS q FROM history WHERE booked < DATE '{p.AS_OF}' AND kind = 'order' GROUP BY 1) ON item_id = p_partkey
 ), f AS (SELECT node, leaf, CAST(weight AS HUGEINT) AS weight, coalesce(CAST(sum(weight) FILTER (weight > 0) OVER o AS HUGEINT), 0) AS total, count(*) FILTER (weight > 0) OVER o AS known, count(*) OVER o AS n FROM w WINDOW o AS (PARTITION BY node))
SELECT node, leaf, period, CAST((CAST(qty AS HUGEINT) * CASE WHEN weight > 0 THEN weight * known ELSE greatest(total, 1) END * 2000000 + greatest(total, 1) * n) // (greatest(total, 1) * n * 2) AS BIGINT) / 1000000 AS qty FROM c JOIN f USING (node)""")
def middle_out(spark, d):
    parts = p.items(spark, d)
    curves = p.flows(spark, d).where("kind = 'forecast'").join(parts, "item_id").groupBy(F.col("brand").alias("node"), F.col("bucket").alias("period")).agg(F.sum("qty").alias("qty"))
    past = p.demand_history(spark, d).where((F.col("booked") < F.lit(p.AS_OF).cast("date")) & (F.col("kind") == "order")).groupBy("item_id").agg(F.sum("qty").alias("q"))
    weights = parts.join(past, "item_id", "left").select(F.col("brand").alias("node"), F.col("item_id").alias("leaf"), F.coalesce("q", F.lit(0.0)).alias("weight"))
    return forecast.middle_out(curves, weights)


STAGED = "(SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 50 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS item, CASE WHEN l_orderkey % 70 = 1 THEN '-3' WHEN l_orderkey % 70 = 2 THEN 'many' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS qty, CASE WHEN l_orderkey % 90 = 3 THEN '1998-02-31' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS due FROM lineitem)"


def staged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    return p.table(spark, d, "lineitem").select(
        (k * 10 + F.col("l_linenumber")).alias("id"),
        F.when(k % 50 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("item"),
        F.when(k % 70 == 1, "-3").when(k % 70 == 2, "many").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("qty"),
        F.when(k % 90 == 3, "1998-02-31").otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("due"),
    )


@query(f"""SELECT id, 'L1_MISSING' AS rule_code, 'item' AS field_name, 'error' AS severity FROM {STAGED} WHERE item = '' UNION ALL SELECT id, 'L1_TYPE', 'qty', 'error' FROM {STAGED} WHERE coalesce(TRY_CAST(qty AS DOUBLE) <= 0, true)
UNION ALL SELECT id, 'L1_TYPE', 'due', 'error' FROM {STAGED} WHERE TRY_CAST(due AS DATE) IS NULL""")
def dq_structural(spark, d):
    return quality.check_rows(staged(spark, d), "id", quality.structural({"item": "text", "qty": "positive", "due": "date"}))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey + 1 AS item_id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey + 1)")
def dq_references(spark, d):
    rows = p.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") + 1).alias("item_id"))
    return quality.unknown_references(rows, "item_id", p.items(spark, d), "item_id").select("id", "item_id")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dq_duplicates(spark, d):
    rows = p.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return quality.duplicates_in_batch(rows, "id")


@query("""SELECT item_id, supplier_id, unit_cost, q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM supplier_items JOIN (SELECT item_id, v[len(v) // 4 + 1] AS q1, v[3 * len(v) // 4 + 1] AS q3 FROM (SELECT item_id, list_sort(list(unit_cost)) AS v FROM supplier_items GROUP BY 1) WHERE len(v) >= 4) USING (item_id) WHERE unit_cost < q1 - 1.5 * (q3 - q1) OR unit_cost > q3 + 1.5 * (q3 - q1)""")
def dq_price_outliers(spark, d):
    return quality.price_outliers(p.supplier_items(spark, d).select("item_id", "supplier_id", "unit_cost"), "item_id", "unit_cost")


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'delete' WHEN p_partkey % 13 = 0 THEN 'insert' WHEN p_partkey % 7 = 0 THEN 'update' ELSE 'noop' END AS action FROM part")
def batch_diff(spark, d):
    parts = p.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    batch = parts.where("p_partkey % 11 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" new"))).otherwise(F.concat(F.lit(" "), "p_name")))
    return quality.batch_diff(batch, parts.where("p_partkey % 13 <> 0 or p_partkey % 11 = 0"), "p_partkey", ["p_name", "p_size"])


@query(f"""SELECT item_id, action, size, effective_from, effective_to FROM (
  SELECT p_partkey AS item_id, CASE WHEN p_partkey % 5 = 0 THEN 'created' WHEN p_partkey % 3 <> 0 THEN 'noop' WHEN p_partkey % 2 = 0 THEN 'in_place' ELSE 'rotated' END AS action, p_size, CASE WHEN p_partkey % 2 = 0 THEN DATE '{p.AS_OF}' ELSE DATE '1997-01-01' END AS since FROM part),
  LATERAL (SELECT CASE WHEN action IN ('created', 'in_place') THEN p_size + (CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END) ELSE p_size END AS size, CASE WHEN action = 'created' THEN DATE '{p.AS_OF}' ELSE since END AS effective_from, CASE WHEN action = 'rotated' THEN DATE '{p.AS_OF}' END AS effective_to
    UNION ALL SELECT p_size + 1, DATE '{p.AS_OF}', NULL WHERE action = 'rotated')""")
def versioned_parameters(spark, d):
    parts = p.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("size"))
    day = F.lit(p.AS_OF).cast("date")
    now = parts.where("item_id % 5 <> 0").withColumn("effective_from", F.when(F.col("item_id") % 2 == 0, day).otherwise(F.lit("1997-01-01").cast("date")))
    feed = parts.withColumn("size", F.col("size") + F.when(F.col("item_id") % 3 == 0, 1).otherwise(0))
    return quality.versioned(now, feed, "item_id", ["size"], p.AS_OF)


@query("SELECT item_id, location_id, CASE WHEN item_id % 4 = 0 AND location_id = 1 THEN 99.0 WHEN item_id % 6 = 0 THEN 50.0 ELSE on_hand END AS safety FROM on_hand")
def parameter_overlay(spark, d):
    base = p.on_hand(spark, d).withColumnRenamed("on_hand", "safety")
    ids = base.select("item_id").distinct()
    row = lambda where, place, value: ids.where(where).select("item_id", F.lit(place).cast("long").alias("location_id"), F.lit("safety").alias("field_name"), F.lit(value).alias("value"))
    return quality.overlay(base, row("item_id % 4 = 0", 1, "99").unionByName(row("item_id % 6 = 0", None, "50")), {"safety": "double"})


@query(""", r AS (SELECT order_id * 10 + line_id AS recommendation_id, item_id, qty, due AS need FROM flows WHERE kind = 'order'), g AS (SELECT order_id * 10 + line_id AS receipt_id, item_id, qty AS got, due AS arrived FROM flows WHERE kind = 'supply'
), c AS (SELECT recommendation_id, receipt_id, count(*) OVER (PARTITION BY recommendation_id) AS n, count(*) OVER (PARTITION BY receipt_id) AS m FROM r JOIN g USING (item_id) WHERE abs(qty - got) <= 0.05 * qty AND abs(date_diff('day', arrived, need)) <= 7), t AS (SELECT recommendation_id, max(greatest(n, m)) AS most, min(receipt_id) AS receipt_id FROM c GROUP BY 1)
SELECT recommendation_id, CASE WHEN most IS NULL THEN 'unmatched' WHEN most = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN most = 1 THEN receipt_id END AS receipt_id FROM r LEFT JOIN t USING (recommendation_id)""")
def receipt_reconciliation(spark, d):
    f = p.flows(spark, d).withColumn("id", F.col("order_id") * 10 + F.col("line_id"))
    wanted = f.where("kind = 'order'").select(F.col("id").alias("recommendation_id"), "item_id", "qty", F.col("due").alias("need"))
    return quality.reconcile(wanted, f.where("kind = 'supply'").select(F.col("id").alias("receipt_id"), "item_id", F.col("qty").alias("got"), F.col("due").alias("arrived")))


@query("SELECT o_orderkey, date_trunc('week', CAST(o_orderdate AS DATE))::DATE AS week, date_trunc('month', CAST(o_orderdate AS DATE))::DATE AS month, (date_trunc('month', CAST(o_orderdate AS DATE)) + INTERVAL 1 MONTH)::DATE AS month_end, year(o_orderdate) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS label, CASE o_orderkey % 6 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'SPRING' WHEN 2 THEN 'FWD_BUY' WHEN 3 THEN 'SUMMER' WHEN 4 THEN 'EARLY' ELSE 'BASE' END AS program FROM orders")
def calendar_functions(spark, d):
    day = F.col("o_orderdate").cast("date")
    kind = F.element_at(F.array(*map(F.lit, ("  ", "spring buy", "Fwd buy", "SUMMER and fwd buy", "an early one", "5-LOW"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return p.table(spark, d, "orders").select("o_orderkey", timegrid.week_start(day).alias("week"), timegrid.month_start(day).alias("month"), timegrid.bucket_end(day, "month").alias("month_end"), timegrid.iso_label(day).alias("label"), rules.program_of(kind).alias("program"))


@query("SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n, round(sum(value), 4) AS value, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def event_windows(spark, d):
    events = p.table(spark, d, "events")
    return events.groupBy(timegrid.week_start(F.col("ts")).alias("week"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.countDistinct("user_id").alias("users"))
