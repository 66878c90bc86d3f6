"""Projected inventory: flows netted per bucket, running stock per series, shortages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("item_id", "location_id")
EPSILON = 1e-9


def packed(sums: DataFrame, size: int, values: tuple[str, ...], beside: DataFrame | None = None) -> DataFrame:
    """A row for each series: its on_hand, the columns of `beside` (by item_id), and `cells`: buckets 0 to size - 1 in order, with zeros where `sums` (series, bucket, values) has none.

    What runs over a series' buckets is computed within this row: as many rows as a series has buckets need not be sorted again.
    """
    entry = F.struct("bucket", F.struct(*values).alias("sums"))
    out = sums.groupBy(*SERIES).agg(F.coalesce(F.max("on_hand"), F.lit(0.0)).alias("on_hand"), F.map_from_entries(F.collect_list(entry)).alias("found"))
    if beside is not None:
        out = out.join(beside.hint("shuffle_hash"), "item_id", "left")  # the items are hashed; series aren't sorted to meet them
    found = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(i.alias("bucket"), F.try_element_at("found", i).alias("sums")))
    cells = F.transform(found, lambda e: F.struct(e["bucket"].alias("bucket"), *(F.coalesce(e["sums"][v], F.lit(0.0)).alias(v) for v in values)))
    return out.withColumn("cells", cells).drop("found")


def upto(cells: Column, value: Callable[[Column], Column]) -> Column:
    """What `value` of the cells before each sums to."""
    first = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("before"))
    step = lambda a, c: F.struct((a["sum"] + value(c)).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before"))
    return F.aggregate(cells, first, step, lambda a: a["before"])


def series_flows(moves: DataFrame, buckets: int, beside: DataFrame | None = None) -> DataFrame:
    """A row for each series with on_hand and `cells` of bucket, inflows, outflows, all buckets in order.

    `moves` has bucket, kind and qty; supply of bucket -1 is what has been received, of
    which a fifth is on hand. Outflow nets forecast and orders by their maximum, and adds
    what goes to other sites. Moves are summed once per series and bucket before they meet the grid.
    """
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("qty")).otherwise(0.0))
    sums = moves.groupBy(*SERIES, "bucket").agg(of("supply").alias("inflows"), of("order").alias("orders"), of("forecast").alias("forecast"), of("transfer").alias("transfers"))
    sums = sums.withColumn("on_hand", F.when(F.col("bucket") < 0, F.floor(F.col("inflows") / 5).cast("double")))
    out = packed(sums, buckets, ("inflows", "orders", "forecast", "transfers"), beside)
    net = lambda c: F.struct(c["bucket"].alias("bucket"), c["inflows"].alias("inflows"), (F.greatest(c["forecast"], c["orders"]) + c["transfers"]).alias("outflows"))
    return out.withColumn("cells", F.transform("cells", net))


def bucket_flows(moves: DataFrame, buckets: int) -> DataFrame:
    """The cells of series_flows as rows."""
    return series_flows(moves, buckets).select(*SERIES, "on_hand", F.explode("cells").alias("c")).select(*SERIES, "c.bucket", "on_hand", "c.inflows", "c.outflows")


def more(series: DataFrame, on_hand: Column, outflows: float) -> DataFrame:
    """Series flows with another on_hand, and more outflows in every bucket."""
    cells = F.transform("cells", lambda c: F.struct(c["bucket"].alias("bucket"), c["inflows"].alias("inflows"), (c["outflows"] + outflows).alias("outflows")))
    return series.withColumns({"on_hand": on_hand, "cells": cells})


def _planned(on_hand: Column, c: Column, before: Column, epsilon: float) -> tuple[Column, ...]:
    opening = on_hand + before
    closing = opening + c["inflows"] - c["outflows"]
    short = closing < -epsilon
    return (c["bucket"].alias("bucket"), opening.alias("opening"), c["inflows"].alias("inflows"), c["outflows"].alias("outflows"), closing.alias("closing"), short.alias("has_shortage"), F.when(short, -closing).otherwise(0.0).alias("shortage_qty"))


def _net(c: Column) -> Column:
    return c["inflows"] - c["outflows"]


def project_series(series: DataFrame, *keep: str, epsilon: float = EPSILON) -> DataFrame:
    """Opening and closing stock of every bucket of series flows, as project() has them, with the columns in `keep`: no row is sorted."""
    held = F.zip_with("cells", upto(F.col("cells"), _net), lambda c, b: F.struct(c.alias("cell"), b.alias("before")))
    rows = series.select(*SERIES, *keep, "on_hand", F.explode(held).alias("c"))
    return rows.select(*SERIES, *keep, *_planned(F.col("on_hand"), F.col("c.cell"), F.col("c.before"), epsilon))


def planned_series(series: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Series flows with `cells` of the projection: bucket, opening, inflows, outflows, closing, has_shortage, shortage_qty."""
    plan = F.zip_with("cells", upto(F.col("cells"), _net), lambda c, b: F.struct(*_planned(F.col("on_hand"), c, b, epsilon)))
    return series.withColumn("cells", plan)


def project(flows: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Opening and closing stock of every bucket: two running sums over each series."""
    order = Window.partitionBy(*SERIES).orderBy("bucket")
    net = F.col("inflows") - F.col("outflows")
    before = F.coalesce(F.sum(net).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = flows.withColumn("opening", F.col("on_hand") + before).withColumn("closing", F.col("opening") + F.col("inflows") - F.col("outflows"))
    short = F.col("closing") < -epsilon
    return out.select(*SERIES, "bucket", "opening", "inflows", "outflows", "closing", short.alias("has_shortage"), F.when(short, -F.col("closing")).otherwise(0.0).alias("shortage_qty"))


def shortages(projection: DataFrame, safety: Column, *, per_site: bool, days: int = 7, epsilon: float = EPSILON) -> DataFrame:
    """Stockouts, and in per-site scope buckets below safety stock, with their severity by the projection's standard_cost."""
    closing = F.col("closing")
    out = F.when(closing < -epsilon, "stockout")
    if per_site:
        out = out.when(closing < safety, "below_safety_stock")
    qty = F.when(F.col("class") == "stockout", -closing).otherwise(safety - closing)
    found = projection.withColumn("class", out).where("class is not null").withColumnRenamed("standard_cost", "unit_cost")
    # Exact numbers, rounded once, whatever the order of the terms.
    score = qty.cast("decimal(18,3)") * max(days, 1) * F.coalesce(F.col("unit_cost").cast("decimal(12,2)"), F.lit(1).cast("decimal(12,2)"))
    return found.select(*SERIES, "bucket", "class", qty.alias("qty"), F.round(score, 2).cast("double").alias("severity"))


def severity_band(score: Column) -> Column:
    return F.when(score < 100, "low").when(score <= 1000, "medium").otherwise("high")


def broken_invariants(projection: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Buckets whose balance, chaining or flag is wrong: invariant, series, bucket."""
    order = Window.partitionBy(*SERIES).orderBy("bucket")
    p = projection.withColumn("last", F.lag("closing").over(order))
    checks = F.array(
        F.when(F.abs(F.col("opening") + F.col("inflows") - F.col("outflows") - F.col("closing")) > epsilon, "balance"),
        F.when(F.abs(F.col("last") - F.col("opening")) > epsilon, "chain"),
        F.when(F.col("has_shortage") != (F.col("closing") < -EPSILON), "flag"),
    )
    return p.select(F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("invariant"), *SERIES, "bucket")


def portfolio(series: DataFrame) -> DataFrame:
    """Per planned series: buckets short, total short, lowest closing."""
    of = lambda name: F.transform("cells", lambda c: c[name])
    short = F.size(F.filter("cells", lambda c: c["has_shortage"])).cast("long")
    return series.select(*SERIES, short.alias("shortage_buckets"), _total(of("shortage_qty")).alias("total_shortage"), F.array_min(of("closing")).alias("lowest"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def roll_up(series: DataFrame, period: Callable[[Column], Column]) -> DataFrame:
    """Coarser buckets of planned series: first opening, summed flows, last closing. `period` is of a bucket."""
    of = lambda part, name: F.transform(part, lambda c: c[name])
    at = lambda part, i, name: F.element_at(part, i)[name].alias(name)

    def summed(of_period: Column) -> Column:
        part = F.filter("cells", lambda c: period(c["bucket"]) == of_period)
        return F.struct(of_period.alias("period"), part.alias("part"))

    periods = F.array_distinct(F.transform("cells", lambda c: period(c["bucket"])))
    rows = series.select(*SERIES, F.explode(F.transform(periods, summed)).alias("p")).select(*SERIES, "p.period", "p.part")
    part = F.col("part")
    total = lambda name: _total(of(part, name)).alias(name)
    return rows.select(*SERIES, "period", at(part, 1, "opening"), total("inflows"), total("outflows"), at(part, -1, "closing"), F.exists(part, lambda c: c["has_shortage"]).alias("has_shortage"), total("shortage_qty"))


def split_flat(projection: DataFrame, parts: int) -> DataFrame:
    """Finer buckets: flows in whole units by floor division, the remainder in the last part; running stock, which whole units make exact without a running sum."""
    share = lambda c: F.floor(F.col(c) / parts).cast("double")
    fine = projection.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    last = F.col("part") == parts - 1
    flow = lambda c: F.when(last, F.col(c) - share(c) * (parts - 1)).otherwise(share(c)).alias(c)
    run = F.when(last, F.col("inflows") - F.col("outflows")).otherwise((F.col("part") + 1) * (share("inflows") - share("outflows")))
    return fine.select(*SERIES, "bucket", "part", flow("inflows"), flow("outflows"), (F.col("opening") + run).alias("closing"))


def shortage_delta(series: DataFrame, on_hand: Column, outflows: float) -> DataFrame:
    """New and resolved shortages by (item, location, bucket) of series flows when on-hand is replaced by the scenario's, and outflows are more. Both plans of a series are compared within its row."""
    run = lambda rows: F.zip_with("cells", upto(F.col("cells"), _net), lambda c, b: F.struct(c["bucket"].alias("bucket"), (F.col("on_hand") + (b + _net(c)) < -EPSILON).alias("short")))
    both = more(series.withColumn("base", run(series)), on_hand, outflows)
    both = both.select(*SERIES, F.zip_with("base", run(both), lambda a, b: F.struct(a["bucket"].alias("bucket"), a["short"].alias("before"), b["short"].alias("after"))).alias("cells"))
    rows = both.select(*SERIES, F.explode(F.filter("cells", lambda c: c["before"] != c["after"])).alias("c"))
    return rows.select(*SERIES, "c.bucket", F.when(F.col("c.after"), "new").otherwise("resolved").alias("change"))


def first_below(series: DataFrame, safety: Column) -> DataFrame:
    """Each series' first bucket whose running stock is below safety, and by how much."""
    low = F.filter(F.transform("cells", lambda c: F.struct(c["bucket"].alias("bucket"), (safety - c["closing"]).alias("deficit"))), lambda c: c["deficit"] > 0)
    return planned_series(series).select(*SERIES, F.try_element_at(low, F.lit(1)).alias("c")).where("c is not null").select(*SERIES, "c.bucket", "c.deficit")


def promise_series(moves: DataFrame, days: int) -> DataFrame:
    """A row for each series with `cells` of day, supply, demand and closing: cumulative available-to-promise, from supply, customer orders and the stock on hand (bucket -1)."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("qty")).otherwise(0.0))
    sums = moves.where("kind in ('supply', 'order')").groupBy(*SERIES, "bucket").agg(of("supply").alias("supply"), of("order").alias("demand"))
    sums = sums.withColumn("on_hand", F.when(F.col("bucket") < 0, F.floor(F.col("supply") / 5).cast("double")))
    net = lambda c: c["supply"] - c["demand"]
    held = lambda c, b: F.struct(c["bucket"].alias("day"), c["supply"].alias("supply"), c["demand"].alias("demand"), (F.col("on_hand") + (b + net(c))).alias("closing"))
    return packed(sums, days, ("supply", "demand")).select(*SERIES, F.zip_with("cells", upto(F.col("cells"), net), held).alias("cells"))


def promise_buckets(moves: DataFrame, days: int) -> DataFrame:
    """The cells of promise_series as rows."""
    return promise_series(moves, days).select(*SERIES, F.explode("cells").alias("c")).select(*SERIES, "c.*")
