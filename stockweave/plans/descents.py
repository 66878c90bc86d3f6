"""Registered queries on demand brought down to places; each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descent
from ..sources import planning as p
from ..sources.written import written
from .registry import query

#: A nation is served from its region's place, if one of its suppliers has a good balance; items are eligible where they are received.
RICH = 4000


def _exact(n: str, d: str) -> str:
    """n / d, half to even, of whole numbers."""
    return f"(({n}) // ({d}) + CASE WHEN 2 * (({n}) % ({d})) > ({d}) OR 2 * (({n}) % ({d})) = ({d}) AND (({n}) // ({d})) % 2 = 1 THEN 1 ELSE 0 END)"


def _portions(rows: str, group: str, weight: str, amount: str, name: str) -> str:
    first = f"row_number() OVER (PARTITION BY {group} ORDER BY {weight} DESC, place) = 1"
    return f"SELECT * EXCLUDE (_q), CAST(_q + CASE WHEN {first} THEN {amount} - sum(_q) OVER (PARTITION BY {group}) ELSE 0 END AS BIGINT) AS {name} FROM (SELECT *, {_exact(f'CAST({weight} AS HUGEINT) * {amount}', f'sum(CAST({weight} AS HUGEINT)) OVER (PARTITION BY {group})')} AS _q FROM {rows})"


SHARES = f""", routes AS (SELECT n_nationkey AS state, min(n_regionkey) AS place FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > {RICH} GROUP BY 1
), pairs AS (SELECT DISTINCT item_id, location_id AS place FROM lines WHERE kind = 'supply'
), weights AS MATERIALIZED (SELECT h.item_id, r.place, CAST(sum(qty) AS BIGINT) AS weight FROM history h JOIN routes r USING (state) JOIN pairs q ON q.item_id = h.item_id AND q.place = r.place WHERE kind = 'order' GROUP BY ALL HAVING sum(qty) > 0
), basis AS MATERIALIZED (SELECT item_id, CAST(sum(weight) AS BIGINT) AS basis FROM weights GROUP BY 1 HAVING sum(weight) >= 100
), known AS (SELECT item_id, place, weight, basis FROM weights JOIN basis USING (item_id)
), cold AS (SELECT p_partkey AS item_id, place, 1 AS weight FROM part JOIN pairs ON item_id = p_partkey WHERE p_partkey NOT IN (SELECT item_id FROM basis)
), shares AS MATERIALIZED (SELECT item_id, place, share, 'history' AS method, least(1.0, basis / 1000) AS confidence, basis, false AS cold_start FROM ({_portions('known', 'item_id', 'weight', str(descent.SHARE), 'share')})
  UNION ALL SELECT item_id, place, share, 'equal_split', NULL, 0, true FROM ({_portions('cold', 'item_id', 'weight', str(descent.SHARE), 'share')}))"""


def _inputs(spark, d):
    rich = p.table(spark, d, "supplier").where(F.col("s_acctbal") > RICH).select(F.col("s_nationkey").alias("n_nationkey"))
    routes = p.table(spark, d, "nation").join(rich, "n_nationkey").select(F.col("n_nationkey").alias("state"), F.col("n_regionkey").cast("long").alias("place"))
    received = p.lines(spark, d, F.col("l_returnflag") == "R").select("item_id", F.col("location_id").alias("place")).distinct().withColumn("eligible", F.lit(True))
    past = p.with_customers(p.demand_history(spark, d).where("kind = 'order'"), spark, d).select("item_id", "state", "qty")
    return routes, received, past


def shared(spark, d):
    routes, eligible, past = _inputs(spark, d)
    return descent.shares(p.items(spark, d), past, routes, eligible, least=100)


@query(f"{SHARES} SELECT * FROM shares")
def demand_shares(spark, d):
    """Shares of the places by history, evenly where there is too little of it."""
    return shared(spark, d)


@query(f"{SHARES} SELECT item_id, state, sum(qty) AS qty FROM history WHERE kind = 'order' AND state NOT IN (SELECT state FROM routes) GROUP BY ALL")
def unrouted_history(spark, d):
    routes, _, past = _inputs(spark, d)
    return descent.unrouted(past, descent.checked_routes(routes))


LEDGER = f"""{SHARES}, gone AS (SELECT * FROM pairs WHERE NOT EXISTS (SELECT 1 FROM on_hand o WHERE o.item_id = pairs.item_id AND o.location_id = pairs.place)
), usable AS (SELECT item_id, place, share AS stated FROM shares WHERE share > 0 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.item_id = shares.item_id AND g.place = shares.place)
), applied AS MATERIALIZED (SELECT item_id, place, share FROM ({_portions('usable', 'item_id', 'stated', str(descent.SHARE), 'share')})
), national AS (SELECT order_id || '-' || line_id || '-' || item_id || '-' || location_id AS node_id, item_id, sum(qty) AS qty FROM flows WHERE kind = 'forecast' GROUP BY order_id, line_id, item_id, location_id
), sourced AS (SELECT node_id, item_id, place, share, CAST(round_even(qty * {descent.QTY}, 0) AS BIGINT) AS qty_source FROM national JOIN applied USING (item_id)
), ledger AS MATERIALIZED (SELECT node_id, item_id, place, share, qty_source, qty, node_id || '@' || place AS derived_id FROM ({_portions('sourced', 'node_id', 'share', 'qty_source', 'qty')}))"""


def _ledger(spark, d):
    """Forecasts brought down to the places that are eligible and have had stock by now."""
    national = p.flows(spark, d).where("kind = 'forecast'").groupBy("order_id", "line_id", "item_id", "location_id").agg(F.sum("qty").alias("qty"))
    national = national.select(F.concat_ws("-", "order_id", "line_id", "item_id", "location_id").alias("node_id"), "item_id", F.lit(None).cast("long").alias("location_id"), "qty", F.lit(True).alias("active"), F.lit(None).cast("string").alias("source_id"))
    _, eligible, _ = _inputs(spark, d)
    stocked = eligible.join(p.on_hand(spark, d).select("item_id", F.col("location_id").alias("place")), ["item_id", "place"], "left_semi")
    return national, written(descent.descend(national, shared(spark, d), stocked))


@query(f"{LEDGER} SELECT * FROM ledger")
def demand_descent(spark, d):
    return _ledger(spark, d)[1]


@query(f"{LEDGER} SELECT node_id, item_id, CAST(NULL AS BIGINT) AS location_id, qty, node_id NOT IN (SELECT node_id FROM ledger) AS active, CAST(NULL AS VARCHAR) AS source_id FROM national UNION ALL SELECT derived_id, item_id, place, qty / {descent.QTY}, true, node_id FROM ledger")
def demand_descended(spark, d):
    """The demand after the descent; done a second time, it changes nothing."""
    national, ledger = _ledger(spark, d)
    return descent.applied(descent.applied(national, ledger), ledger)


@query(f"{LEDGER} SELECT 'split' AS invariant, CAST(item_id AS VARCHAR) AS key FROM shares GROUP BY item_id HAVING sum(share + CASE WHEN item_id % 50 = 0 AND place = 1 THEN 1 ELSE 0 END) <> {descent.SHARE} UNION ALL SELECT 'mass', node_id FROM ledger GROUP BY node_id HAVING sum(qty - CASE WHEN place = 2 AND item_id % 20 = 0 THEN 1 ELSE 0 END) <> max(qty_source)")
def broken_descents(spark, d):
    """Shares with one too much for some items, and a ledger with one too little for others."""
    much = F.when((F.col("item_id") % 50 == 0) & (F.col("place") == 1), 1).otherwise(0)
    little = F.when((F.col("place") == 2) & (F.col("item_id") % 20 == 0), 1).otherwise(0)
    return descent.broken(shared(spark, d).withColumn("share", F.col("share") + much), _ledger(spark, d)[1].withColumn("qty", F.col("qty") - little))
