"""Planning inputs as deterministic views of the star-schema tables.

An item is a part; a location is one of the LOCATIONS groups of suppliers. Lines
returned 'R' are supply receipts, 'N' customer orders (each order's seventh line a
transfer to another site), 'A' forecast of SPAN days. All dates are relative to AS_OF,
which is a parameter of the operators and never the clock.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, timegrid

AS_OF = "1998-01-05"
WEEKS = 26
LOCATIONS = 5
#: Lines to a task of a step that holds or sorts as many rows as it gets.
SHARE = 250_000
#: Days of a forecast; days after which a receipt that is due counts as stock.
SPAN, LATE = 8, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """As many tasks as the lines are dealt to by SHARE; only the counts in the files' footers are read."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // SHARE))


def shipped(days: int) -> Column:
    """The date `days` from AS_OF on, as the lines' ship dates are stored, so that comparisons reach the scan."""
    return F.lit(f"{date.fromisoformat(AS_OF) + timedelta(days)} 00:00:00").cast("timestamp_ntz")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, item_type, brand, standard_cost."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("item_type"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("standard_cost"))


def lines(spark: SparkSession, sf_dir: str, wanted: Column | None = None) -> DataFrame:
    """item_id, location_id, supplier_id, qty, price, kind (supply, order, transfer, forecast), due date; of `wanted` lines only."""
    kind = F.when(F.col("l_returnflag") == "R", "supply").when(F.col("l_returnflag") == "A", "forecast").when(F.col("l_linenumber") == 7, "transfer").otherwise("order")
    rows = table(spark, sf_dir, "lineitem")
    return (rows if wanted is None else rows.where(wanted)).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_id"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_suppkey") % LOCATIONS).alias("location_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        kind.alias("kind"),
        F.col("l_shipdate").cast("date").alias("due"),
    )


def demand_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booked demand facts: lines with their order's date, type, status and customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("booked"), F.col("o_orderpriority").alias("order_type"), "o_orderstatus")
    facts = lines(spark, sf_dir).join(orders, F.col("order_id") == F.col("o_orderkey"))
    return facts.select("order_id", "line_id", "item_id", "location_id", "qty", "price", "kind", "booked", "due", "customer_id", "order_type", "o_orderstatus")


def with_customers(facts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand facts with their customer's state and channel."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("state"), F.col("c_mktsegment").alias("channel"))
    return facts.join(customers, "customer_id")


def supplier_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sourcing terms: one row per item and supplier, dealt by item.

    Lines meet by item and supplier, and an item's suppliers after that, in tasks of about SHARE lines.
    """
    n = tasks(spark, sf_dir)
    own = lines(spark, sf_dir).select("item_id", "supplier_id", "qty", "price").repartition(n, "item_id", "supplier_id").groupBy("item_id", "supplier_id").agg(F.sum(rules.cents(F.col("price"))).alias("cents"), F.sum("qty").alias("qty"))
    return own.repartition(n, "item_id").select("item_id", "supplier_id", rules.unit_price(F.col("cents"), F.col("qty")).alias("unit_cost"), (7 + F.col("supplier_id") % 28).cast("int").alias("lead_days"), (F.col("supplier_id") % 10 == 0).alias("is_preferred"))


def bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, component, qty_per, scrap: part p is made of parts 2p+1 and 2p+2, where they exist."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    pairs = parts.select(F.col("p").alias("parent"), F.explode(F.array(2 * F.col("p") + 1, 2 * F.col("p") + 2)).alias("component"))
    return pairs.join(parts.select(F.col("p").alias("component")), "component", "left_semi").select("parent", "component", (1 + F.col("parent") % 3).cast("double").alias("qty_per"), F.when(F.col("component") % 2 == 0, 0.05).otherwise(0.0).alias("scrap"))


def on_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, location_id, on_hand: a fifth of the supply that was due more than LATE days before AS_OF."""
    past = lines(spark, sf_dir, (F.col("l_returnflag") == "R") & (F.col("l_shipdate") < shipped(-LATE)))
    return past.groupBy("item_id", "location_id").agg(F.floor(F.sum("qty") / 5).cast("double").alias("on_hand"))


def _day() -> Column:
    return F.datediff("due", F.lit(AS_OF).cast("date"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the horizon with their weekly bucket; receipts up to LATE days late are expected in the first."""
    late = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= shipped(-LATE))
    wanted = (F.col("l_shipdate") < shipped(7 * WEEKS)) & (late | (F.col("l_shipdate") >= shipped(0)))
    return lines(spark, sf_dir, wanted).withColumn("bucket", timegrid.week_index(F.col("due"), F.lit(AS_OF).cast("date")))


def moves(spark: SparkSession, sf_dir: str, size: int, days: int, only: Column | None = None) -> DataFrame:
    """item_id, location_id, kind, bucket, qty: what moves in `size` buckets of `days` days, and in bucket -1 what has come before.

    A forecast is shared among the buckets that its days fall in; shares outside the
    horizon are dropped. One scan of the lines (of those that meet `only`) gives stock and flows.
    """
    supply = F.col("l_returnflag") == "R"
    since = supply | (F.col("l_shipdate") >= shipped(0)) | ((F.col("l_returnflag") == "A") & (F.col("l_shipdate") > shipped(-SPAN)))
    rows = lines(spark, sf_dir, (F.col("l_shipdate") < shipped(size * days)) & since & (F.lit(True) if only is None else only))
    first, forecast = F.floor(_day() / days).cast("int"), F.col("kind") == "forecast"
    last = F.when(forecast, F.floor((_day() + SPAN - 1) / days).cast("int")).otherwise(first)
    first = F.when(F.col("kind") != "supply", F.greatest(first, F.lit(0))).when(_day() < -LATE, -1).otherwise(F.greatest(first, F.lit(0)))
    placed = rows.select("item_id", "location_id", "kind", "qty", "due", F.explode(F.sequence(first, F.least(F.greatest(last, first), F.lit(size - 1)))).alias("bucket"))
    start = F.date_add(F.lit(AS_OF).cast("date"), F.col("bucket") * days)
    share = timegrid.prorated(F.col("qty"), F.col("due"), F.date_add("due", SPAN), start, F.date_add(start, days))
    return placed.select("item_id", "location_id", "kind", "bucket", F.when(forecast, share).otherwise(F.col("qty")).alias("qty"))
