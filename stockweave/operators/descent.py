"""Demand that is planned for all places together, brought down to the places that serve it.

Shares are whole numbers of 1e-8 and quantities of 1e-6, rounded half to even; what rounding leaves over goes to the largest share (of equals the
least place), so that parts add up exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written
from .hierarchy import refuse

SHARE, QTY = 10**8, 10**6
HISTORY, EQUAL = "history", "equal_split"


def _half_even(n: Column, d: Column) -> Column:
    """n / d as a whole number; both are decimals of no places, and not negative."""
    q = F.floor(n / d)  # corrected below, whatever the division has rounded
    q = (q - F.when(q * d > n, 1).otherwise(0)).cast("decimal(38,0)")
    rest = (n - q * d) * 2
    return (q + F.when((rest > d) | ((rest == d) & (q % 2 == 1)), 1).otherwise(0)).cast("long")


def whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def portions(rows: DataFrame, group: list[str], place: str, weight: str, amount: Column, name: str) -> DataFrame:
    """Adds `name`: the group's amount, a whole number, in proportion to the weights (whole and positive), exactly. A group has a row for each place at most."""
    own = Window.partitionBy(*group)
    first = F.row_number().over(own.orderBy(F.desc(weight), place)) == 1
    both = rows.withColumns({"_total": F.sum(weight).over(own), "_amount": amount.cast("long"), "_first": first})
    both = both.withColumn(name, _half_even(whole(F.col(weight)) * whole(F.col("_amount")), whole(F.col("_total"))))
    rest = F.when(F.col("_first"), F.col("_amount") - F.sum(name).over(own)).otherwise(0)
    return both.withColumn(name, (F.col(name) + rest).cast("long")).select(*rows.columns, name)


def eligible_pairs(eligibility: DataFrame) -> DataFrame:
    """(item_id, place) that are eligible; a pair that is stated both ways raises. What isn't stated is not eligible."""
    stated = eligibility.groupBy("item_id", "place").agg(F.bool_or("eligible").alias("yes"), F.bool_or(~F.col("eligible")).alias("no"))
    refuse(stated.where("yes and no").select("item_id", "place"), "items stated as eligible and not, with places")
    return stated.where("yes").select("item_id", "place")


def checked_routes(routes: DataFrame) -> DataFrame:
    """(state, place); a state that is served from two places raises."""
    found = routes.groupBy("state").agg(F.min("place").alias("place"), F.max("place").alias("other"))
    refuse(found.where("place <> other").select("state", "place", "other"), "states with two routes")
    return found.select("state", "place")


def unrouted(observed: DataFrame, routes: DataFrame) -> DataFrame:
    """(item_id, state, qty) of the history in states that no place serves."""
    return observed.join(routes, "state", "left_anti").groupBy("item_id", "state").agg(F.sum("qty").alias("qty"))


def shares(items: DataFrame, observed: DataFrame, routes: DataFrame, eligibility: DataFrame, least: int = 0, enough: int = 1000) -> DataFrame:
    """(item_id, place, share, method, confidence, basis, cold_start): how an item's demand divides over its eligible places.

    By history (item_id, state, qty; whole units), routed from states to places, where the item has any that is
    `least` or more; its confidence is basis / `enough`, 1 at most. Else evenly, without confidence. `items` without an eligible place have none.
    Negative history raises; places whose share would be nothing are left out.
    """
    pairs, ways = eligible_pairs(eligibility), checked_routes(routes)
    refuse(observed.where("qty < 0").select("item_id", "state", "qty"), "negative history")
    weights = observed.join(ways, "state").groupBy("item_id", "place").agg(F.sum("qty").cast("long").alias("weight")).where("weight > 0").join(pairs, ["item_id", "place"])
    weights = written(weights)
    basis = weights.groupBy("item_id").agg(F.sum("weight").alias("basis")).where(F.col("basis") >= least)
    known = weights.join(basis, "item_id").where(_half_even(whole(F.col("weight")) * whole(F.lit(SHARE)), whole(F.col("basis"))) > 0)
    by_history = portions(known, ["item_id"], "place", "weight", F.lit(SHARE), "share")
    confidence = F.least(F.lit(1.0), F.col("basis") / enough)
    by_history = by_history.select("item_id", "place", "share", F.lit(HISTORY).alias("method"), confidence.alias("confidence"), "basis", F.lit(False).alias("cold_start"))
    cold = items.select("item_id").distinct().join(basis, "item_id", "left_anti").join(pairs, "item_id").withColumn("weight", F.lit(1).cast("long"))
    evenly = portions(cold, ["item_id"], "place", "weight", F.lit(SHARE), "share")
    return by_history.unionByName(evenly.select("item_id", "place", "share", F.lit(EQUAL).alias("method"), F.lit(None).cast("double").alias("confidence"), F.lit(0).cast("long").alias("basis"), F.lit(True).alias("cold_start")))


def overlaid(base: DataFrame, own: DataFrame) -> DataFrame:
    """Shares (item_id, place, share) with a scenario's own in place of the base's of the same pair."""
    return own.select("item_id", "place", "share").unionByName(base.select("item_id", "place", "share").join(own, ["item_id", "place"], "left_anti"))


def descend(demand: DataFrame, shared: DataFrame, eligibility: DataFrame) -> DataFrame:
    """The ledger of a descent: (node_id, item_id, place, share, qty_source, qty, derived_id) for each active demand (node_id, item_id, qty, active) and place.

    Shares of places that aren't eligible (any more) are dropped and the item's others brought up to one again. Items
    without shares have no lines: their demand stays where it is. Quantities are in millionths; a derived id is that of its source and the place.
    """
    usable = shared.where("share > 0").join(eligible_pairs(eligibility), ["item_id", "place"]).select("item_id", "place", F.col("share").alias("stated"))
    usable = portions(usable, ["item_id"], "place", "stated", F.lit(SHARE), "share").drop("stated")
    sources = demand.where("active").select("node_id", "item_id", F.bround(F.col("qty") * QTY).cast("long").alias("qty_source"))
    lines = sources.join(usable, "item_id")
    return portions(lines, ["node_id"], "place", "share", F.col("qty_source"), "qty").withColumn("derived_id", F.concat_ws("@", "node_id", "place"))


def applied(demand: DataFrame, ledger: DataFrame) -> DataFrame:
    """The demand after a descent: sources inactive, derived rows added at their place. Applied again, with lines it already has, it changes nothing."""
    split = ledger.select("node_id").distinct().withColumn("_split", F.lit(True))
    kept = demand.join(split, "node_id", "left").withColumn("active", F.col("active") & F.col("_split").isNull()).drop("_split")
    made = ledger.select(F.col("derived_id").alias("node_id"), "item_id", F.col("place").alias("location_id"), (F.col("qty") / QTY).alias("qty"), F.lit(True).alias("active"), F.col("node_id").alias("source_id"))
    return kept.unionByName(made.join(demand.select("node_id"), "node_id", "left_anti"))


def undone(demand: DataFrame, ledger: DataFrame) -> DataFrame:
    """The demand before the descent of that ledger: its derived rows gone, its sources active."""
    split = ledger.select("node_id").distinct().withColumn("_split", F.lit(True))
    rest = demand.join(ledger.select(F.col("derived_id").alias("node_id")), "node_id", "left_anti").join(split, "node_id", "left")
    return rest.withColumn("active", F.col("active") | F.col("_split").isNotNull()).drop("_split")


def broken(shared: DataFrame, ledger: DataFrame) -> DataFrame:
    """(invariant, key): 'split', items whose shares aren't one in all, and 'mass', sources whose lines don't add up to what they had."""
    splits = shared.groupBy("item_id").agg(F.sum("share").alias("n")).where(F.col("n") != SHARE).select(F.lit("split").alias("invariant"), F.col("item_id").cast("string").alias("key"))
    lines = ledger.groupBy("node_id").agg(F.sum("qty").alias("n"), F.max("qty_source").alias("all")).where("n <> `all`")
    return splits.unionByName(lines.select(F.lit("mass").alias("invariant"), F.col("node_id").alias("key")))
