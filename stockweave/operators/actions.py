"""What to do about a plan: allocation, receipts against needs, values as of a date, scenario figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate(demands: DataFrame, supply: DataFrame, keys: list[str]) -> DataFrame:
    """Each demand's share of its series' supply, first by priority, then by due date and id: allocated, status.

    Demands of a series are served one after another, so each gets what those before it leave. Series without supply get nothing.
    """
    before = Window.partitionBy(*keys).orderBy("priority", "due", "demand_id", "qty").rowsBetween(Window.unboundedPreceding, -1)
    both = demands.join(supply, keys, "left")
    left = F.coalesce("supply", F.lit(0.0)) - F.coalesce(F.sum("qty").over(before), F.lit(0.0))
    got = F.greatest(F.lit(0.0), F.least(F.col("qty"), left))
    status = F.when(F.col("allocated") >= F.col("qty"), "full").when(F.col("allocated") > 0, "partial").otherwise("none")
    return both.withColumn("allocated", got).select(*keys, "demand_id", "qty", "allocated", status.alias("status"))


def needed_in(receipts: DataFrame, gross: DataFrame, items: DataFrame, weeks: int) -> DataFrame:
    """The bucket in which half of each receipt is used; null if it never is.

    Requirements are the demand beyond on-hand less safety, so up to bucket t they sum to
    demand up to t - (on_hand - safety), if that is positive; stock that is below safety is a
    requirement in bucket 0, whether or not there is demand. Receipts (item_id, receipt_id, due,
    qty) cover them in the order of due date and id, so each covers a span of that sum.
    """
    sums = gross.where(F.col("bucket").between(0, weeks - 1)).groupBy("item_id", "bucket").agg(F.sum("gross").alias("gross"))
    sums = sums.unionByName(receipts.select("item_id", F.lit(0).cast(sums.schema["bucket"].dataType).alias("bucket"), F.lit(0.0).alias("gross")).distinct())
    sums = sums.groupBy("item_id", "bucket").agg(F.sum("gross").alias("gross"))
    upto = sums.withColumn("upto", F.sum("gross").over(Window.partitionBy("item_id").orderBy("bucket")))
    steps = upto.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "upto"))).alias("steps"))  # one a week at most
    before = Window.partitionBy("item_id").orderBy("due", "receipt_id", "qty").rowsBetween(Window.unboundedPreceding, -1)
    placed = receipts.withColumn("half", F.coalesce(F.sum("qty").over(before), F.lit(0.0)) + F.col("qty") / 2)
    placed = placed.join(items.select("item_id", (F.coalesce("on_hand", F.lit(0.0)) - F.coalesce("safety", F.lit(0.0))).alias("free")), "item_id", "left").join(steps, "item_id", "left")
    met = F.filter("steps", lambda s: s["upto"] - F.coalesce("free", F.lit(0.0)) >= F.col("half") - 1e-9)
    return placed.select("item_id", "receipt_id", "due", "qty", F.try_element_at(met, F.lit(1))["bucket"].alias("need"))


def reschedule(placed: DataFrame, as_of: str, weeks: int, least_days: int) -> DataFrame:
    """RESCHEDULE_IN, RESCHEDULE_OUT or CANCEL for receipts that aren't due in the bucket of their need.

    Moves of fewer than `least_days` days are left; a receipt without need in the last bucket isn't cancelled, as its demand may lie beyond the horizon.
    """
    day = F.lit(as_of).cast("date")
    bucket = F.greatest(F.lit(0), F.floor(F.datediff("due", day) / 7))
    proposed = F.date_add(day, F.col("need") * 7)
    late = F.datediff(proposed, "due")
    moved = F.when((bucket != F.col("need")) & (F.abs(late) >= least_days), F.when(late < 0, "RESCHEDULE_IN").otherwise("RESCHEDULE_OUT"))
    action = F.when(F.col("need").isNotNull(), moved).when((F.col("qty") > 0) & (bucket < weeks - 1), "CANCEL")
    return placed.select("item_id", "receipt_id", "qty", action.alias("action"), F.when(F.col("need").isNotNull(), proposed).alias("proposed")).where("action is not null")


def as_of(rows: DataFrame, facts: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Adds the latest `value` of the facts of the same keys whose `at` is on or before the row's; null without any.

    Facts of one moment count as one, the largest. Both tables go through one window in time order; no pairs are made.
    """
    known = facts.groupBy(*keys, at).agg(F.max(value).alias("_fact"))
    both = rows.select(*keys, at, F.struct(*rows.columns).alias("_row"), F.lit(None).cast(dict(facts.dtypes)[value]).alias("_fact"))
    both = both.unionByName(known.withColumn("_row", F.lit(None).cast(both.schema["_row"].dataType)))
    order = Window.partitionBy(*keys).orderBy(at, F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_fact", ignorenulls=True).over(order)).where("_row is not null").select("_row.*", F.col("_last").alias(value))


def scenario_figures(plans: DataFrame) -> DataFrame:
    """Per plan: shortages, their cost, mean stock value over the buckets, fill rate; and each less the base's.

    `plans` has plan, item_id, standard_cost, bucket, outflows, closing. Sums are of exact numbers and rounded once.
    """
    unit = F.coalesce(F.col("standard_cost").cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))
    short = F.greatest(-F.col("closing"), F.lit(0.0))
    worth = F.sum(F.greatest(F.col("closing"), F.lit(0.0)).cast("decimal(18,3)") * unit)
    per = plans.groupBy("plan").agg(
        F.count_if(F.col("closing") < 0).alias("shortages"),
        F.round(F.sum(short.cast("decimal(18,3)") * unit), 2).cast("double").alias("shortage_value"),
        F.round(worth / F.countDistinct("bucket"), 2).cast("double").alias("stock_value"),
        F.round(1 - F.sum(F.least(short, F.col("outflows"))) / F.nullif(F.sum("outflows"), F.lit(0.0)), 6).alias("fill_rate"),
    )
    base = per.where("plan = 'base'").select(*(F.col(c).alias(f"base_{c}") for c in ("shortages", "stock_value")))
    both = per.join(F.broadcast(base))  # one row
    return both.select("plan", "shortages", "shortage_value", "stock_value", "fill_rate", (F.col("shortages") - F.col("base_shortages")).alias("more_shortages"))


def override(base: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A scenario's rows: the base with the changed fields, which `changes` (key, field_name, value) lists; the last value of a field wins.

    Fields keep their types; a value that can't be cast leaves the base's.
    """
    kinds = dict(base.dtypes)
    wide = changes.groupBy(key).agg(*(F.max(F.when(F.col("field_name") == f, F.struct("at", "value")))["value"].alias(f"_{f}") for f in fields))
    out = base.join(wide, key, "left")
    return out.select(*(F.coalesce(F.col(f"_{c}").try_cast(kinds[c]), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns))


def changed_fields(base: DataFrame, scenario: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, old, new) for every field that differs between two versions, null-safe; keys of one side only differ in all that is set."""
    text = lambda side: F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("v")) for f in fields)).alias(side)
    both = base.select(key, text("a")).join(scenario.select(key, text("b")), key, "full_outer")
    none = F.array(*(F.struct(F.lit(f).alias("field_name"), F.lit(None).cast("string").alias("v")) for f in fields))
    pairs = F.zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda x, y: F.struct(x["field_name"].alias("field_name"), x["v"].alias("old"), y["v"].alias("new")))
    return both.select(key, F.explode(F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))).alias("p")).select(key, "p.*")


def mergeable(base: DataFrame, fork: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What promoting a fork changes: each field it changed since `base`, and whether `current` has moved it elsewhere meanwhile (conflict)."""
    own = changed_fields(base, fork, key, fields)
    others = changed_fields(base, current, key, fields).select(key, "field_name", F.col("new").alias("other"))
    both = own.join(others, [key, "field_name"], "left")
    return both.select(key, "field_name", "old", "new", (F.col("other").isNotNull() & ~F.col("other").eqNullSafe(F.col("new"))).alias("conflict"))


def overloads(load: DataFrame, capacity: Column) -> DataFrame:
    """Weekly load against capacity (in hours / 10,000): utilisation in per cent and its severity, where it is over 100."""
    weekly = load.groupBy("resource_id", F.floor(F.col("day") / 7).cast("int").alias("week")).agg(F.sum(F.round(F.col("hours") * 10000).cast("long")).alias("h"))
    use = F.floor((F.col("h") * 20000 + capacity) / (capacity * 2)).cast("long")  # hundredths of a per cent, half up
    weekly = weekly.withColumn("u", use)
    over = F.col("u") - 10000
    band = F.when(over > 10000, "critical").when(over > 5000, "high").when(over > 2000, "medium").otherwise("low")
    return weekly.where("u > 10000").select("resource_id", "week", (F.col("h") / 10000).alias("hours"), (F.col("u") / 100).alias("utilisation"), band.alias("severity"))


def purchases(short: DataFrame, terms: DataFrame, as_of: str, multiple: float) -> DataFrame:
    """An order for each series' first deficit, in whole multiples, from the item's best supplier: preferred, then cheapest, then first.

    It is placed a lead time before the need, today at the earliest; `late` says that this is too late. Items without a priced supplier are left out.
    """
    day = F.lit(as_of).cast("date")
    best = terms.where("unit_cost > 0").groupBy("item_id").agg(F.min_by(F.struct("supplier_id", "unit_cost", "lead_days"), F.struct(~F.col("is_preferred"), "unit_cost", "supplier_id")).alias("s"))
    both = short.join(best, "item_id").select("item_id", "location_id", "bucket", "s.*", (F.ceil(F.col("deficit") / multiple) * multiple).cast("double").alias("qty"))
    value = F.round(F.col("qty").cast("decimal(12,3)") * F.col("unit_cost").cast("decimal(12,4)"), 2).cast("double")
    ordered = F.greatest(day, F.date_sub(F.date_add(day, F.col("bucket") * 7), F.col("lead_days")))
    return both.select("item_id", "location_id", "supplier_id", "qty", value.alias("value"), ordered.alias("order_date"), (F.col("bucket") * 7 < F.col("lead_days")).alias("late"))


def affected(closure: DataFrame, short: DataFrame, items: DataFrame) -> DataFrame:
    """Of `items`, those that short components go into: how many of them, and over how few levels.

    `closure` has each pair once. Items and components are hashed, so that pairs are neither sorted to meet them nor held to be counted.
    """
    hashed = lambda ids, name: ids.select(F.col("item_id").alias(name)).hint("shuffle_hash")
    used = closure.join(hashed(short, "component"), "component", "left_semi").join(hashed(items, "ancestor"), "ancestor", "left_semi")
    return used.groupBy(F.col("ancestor").alias("item_id")).agg(F.count("component").alias("short_components"), F.min("depth").alias("nearest"))
