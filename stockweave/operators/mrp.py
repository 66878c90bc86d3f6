"""Time-phased material requirements, level by level of the bill of materials."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import written
from .bom import united

PLANNED = "item_id long, qty double, release_bucket int, need_bucket int, kind string, past_due boolean"
UNIT = 1_000_000  # quantities are planned in whole millionths, so that what is exactly enough is seen to be


def millionths(qty: Column) -> Column:
    return F.round(qty * UNIT).cast("long")


def up_to(qty: int, size: int) -> int:
    """The least multiple of `size` that holds qty."""
    return -(-qty // size) * size


def lot(rule: str, short: int, stock: int, safety: int, net: list[int], at: int, periods: int, eoq: int, top: int, moq: int, multiple: int, most: int) -> int:
    """A lot by its rule; then the minimum, the multiple, and last the cap, which MIN_MAX is exempt from."""
    qty = short
    if rule == "POQ":
        qty += sum(x for x in net[at + 1 : at + periods] if x > 0)
    elif rule == "EOQ" and eoq > 0:
        qty = max(eoq, short)
    elif rule == "MIN_MAX" and top > 0:
        qty = safety + top - stock
    elif rule == "FIXED_QTY" and moq > 0:
        qty = up_to(short, moq)
    qty = max(qty, moq)
    if multiple > 0:
        qty = up_to(qty, multiple)
    return min(qty, most) if most > 0 and rule != "MIN_MAX" else qty


def plan_item(net: list[int], on_hand: int, lead_days: int | None, safety: int, lot_rule: str, periods: int, *sizes: int) -> list[tuple[int, int, int, bool]]:
    """(qty, release, need, past due) of one item: whenever stock falls below safety, a lot is ordered. Quantities are in millionths."""
    out, stock = [], on_hand
    lead = -(-(lead_days or 30) // 7)
    for t, need in enumerate(net):
        stock -= need
        if stock < safety:
            qty = lot(lot_rule, safety - stock, stock, safety, net, t, periods, *sizes)
            stock += qty
            out.append((qty, max(0, t - lead), t, t < lead))
    return out


def _by_bucket(flows: DataFrame, name: str) -> DataFrame:
    """item_id, `name`: (bucket, qty) of each of its buckets, summed before they are gathered."""
    return flows.groupBy("item_id", "bucket").agg(F.sum("qty").alias("qty")).groupBy("item_id").agg(F.collect_list(F.struct("bucket", "qty")).alias(name))


def _batches(sizes: dict[int, int], together: int) -> list[list[int]]:
    """All levels in order; neighbours go together while they have that many items at most."""
    out: list[list[int]] = []
    for level in sorted(sizes):
        if out and sum(sizes[x] for x in out[-1]) + sizes[level] <= together:
            out[-1].append(level)
        else:
            out.append([level])
    return out


def cascade(params: DataFrame, gross: DataFrame, receipts: DataFrame, bom: DataFrame, weeks: int, *, together: int = 4096) -> DataFrame:
    """Planned orders of all items that have independent or dependent demand.

    `params` has item_id, llc, is_make, on_hand, safety, lead_days, lot_rule, periods, eoq,
    top, moq, multiple, most. `gross` and `receipts` (item_id, bucket, qty) are independent
    demand and firm supply; buckets outside 0 to weeks - 1 don't count. Items of a level don't depend on each
    other: each is one row with at most `weeks` entries of each kind, and its components. Made orders become
    their components' demand at release, rounded to millionths, half up.

    A level is one job: it reads the items and the dependent demand of that level, and writes orders, and
    dependent demand by the component's level, so that every row is read once. Levels that hold `together` items at
    most between them are planned by one task, one after another: a job for each costs more than they do.
    """
    sizes = ["on_hand", "safety", "eoq", "top", "moq", "multiple", "most"]
    out = "item_id long, qty long, bucket int, need_bucket int, kind string, past_due boolean, level int"

    def plan_rows(items: pd.DataFrame, inside: dict[int, list[tuple[int, int]]]) -> list[tuple]:
        """Orders and dependent demand of some items of a level; `inside` has the dependent demand of those planned in this task."""
        made = []
        columns = [items[c].tolist() for c in ("item_id", "is_make", "uses", "gross", "dependent", "receipts", "lead_days", "lot_rule", "periods", *sizes)]
        for item, make, uses, *flows, lead, rule, periods, on_hand, safety, eoq, top, moq, multiple, most in zip(*columns, strict=True):
            here = inside.get(item, ())
            if flows[0] is None and flows[1] is None and not here:
                continue
            net = [0] * weeks
            for sign, entries in zip((1, 1, -1), flows, strict=True):
                for e in entries if entries is not None else ():
                    if 0 <= e["bucket"] < weeks:
                        net[e["bucket"]] += sign * e["qty"]
            for bucket, qty in here:
                net[bucket] += qty
            found = plan_item(net, on_hand, None if lead is None or lead != lead else int(lead), safety, rule, int(periods), eoq, top, moq, multiple, most)
            made += [(item, q, r, n, "WO" if make else "PO", late, -1) for q, r, n, late in found]
            if make and uses is not None:
                made += [(u["component"], (q * u["per"] * 2 + UNIT) // (2 * UNIT), r, None, None, None, u["llc"]) for q, r, *_ in found for u in uses]
        return made

    def frame(made: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c.split()[0]: pd.Series(v, dtype=object) for c, v in zip_longest(out.split(", "), zip(*made), fillvalue=())})

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for items in batches:
            yield frame(plan_rows(items, {}))

    def plan_levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All rows of a few small levels, in their order."""
        inside: dict[int, list[tuple[int, int]]] = {}
        rows = [b for b in batches if len(b)]
        items = pd.concat(rows) if rows else None
        for level in sorted(items["level"].unique()) if rows else ():
            made = plan_rows(items[items["level"] == level], inside)
            last = items["level"].max()
            for component, qty, bucket, *_, of in made:
                if 0 <= of <= last:
                    inside.setdefault(component, []).append((bucket, qty))
            yield frame([m for m in made if not 0 <= m[-1] <= last])

    exact = lambda flows: flows.select("item_id", "bucket", millionths(F.col("qty")).alias("qty"))
    edges = bom.join(params.select(F.col("item_id").alias("component"), "llc"), "component")
    edges = edges.groupBy(F.col("parent").alias("item_id")).agg(F.collect_list(F.struct("component", millionths(F.col("qty_per") * (1 + F.col("scrap"))).alias("per"), "llc")).alias("uses"))
    items = params.select(*(millionths(F.col(c)).alias(c) if c in sizes else F.col(c) for c in params.columns), F.col("llc").alias("level"))
    items = items.join(_by_bucket(exact(gross), "gross"), "item_id", "left").join(_by_bucket(exact(receipts), "receipts"), "item_id", "left").join(edges, "item_id", "left")
    items = written(items, "level")
    nothing = items.select("item_id", "gross").withColumnRenamed("gross", "dependent").where(F.lit(False))
    tables: list[DataFrame] = []
    for levels in _batches({r.level: r["count"] for r in items.groupBy("level").count().collect()}, together):
        of = F.col("level").isin(levels)
        needs = _by_bucket(united([t.where(of) for t in tables]), "dependent") if tables else nothing
        here = items.where(of).join(needs, "item_id", "left")
        if len(levels) > 1:
            made = here.repartition(1).mapInPandas(plan_levels, out)
        else:
            made = here.where("gross is not null or dependent is not null").mapInPandas(plan, out)
        tables.append(written(made, "level"))
    orders = united([t.where("level = -1") for t in tables]) if tables else items.sparkSession.createDataFrame([], out)
    return orders.select("item_id", (F.col("qty") / UNIT).alias("qty"), F.col("bucket").alias("release_bucket"), "need_bucket", "kind", "past_due")


def lot_size(rule: Column, net: Column, stock: Column, *, moq: Column, most: Column, eoq: Column, multiple: Column, periods: Column, reorder: Column, ahead: Column) -> Column:
    """The other model's lot for one period: nothing without a requirement, else by the rule, then the cap, for all rules.

    LOTFORLOT, EOQ and MULTIPLE (whole multiples of either), and POQ (the requirements `ahead`, an array, of the periods that follow, too) order moq
    at least; FIXED_QTY orders whole multiples of moq. MIN_MAX orders up to the cap, and beyond the reorder point (or moq) no less than
    the requirement. Sizes that are null or not positive don't count; an unknown rule is LOTFORLOT.
    """
    zero = F.lit(0.0)
    size = lambda c: F.when(c > 0, c)
    floor = lambda c: F.greatest(c, F.coalesce(size(moq), zero))
    by = lambda q, step: F.ceil(q / step) * step
    more = F.aggregate(F.slice(ahead, 1, F.greatest(F.coalesce(periods, F.lit(1)) - 1, F.lit(0))), zero, lambda s, x: s + F.greatest(x, zero))
    up_to_most = F.when(most > 0, F.greatest(most - stock, zero))
    below = stock < F.coalesce(size(reorder), size(moq), zero)
    of_multiple = F.coalesce(by(F.greatest(net, F.coalesce(size(moq), zero)), size(multiple)), floor(net))
    lot = (
        F.when(rule == "FIXED_QTY", F.coalesce(by(net, size(moq)), net))
        .when(rule == "EOQ", floor(F.coalesce(by(net, size(eoq)), net)))
        .when(rule == "POQ", floor(net + more))
        .when(rule == "MIN_MAX", F.coalesce(F.when(below, up_to_most).otherwise(F.greatest(net, up_to_most)), net))
        .when(rule == "MULTIPLE", of_multiple)
        .otherwise(floor(net))
    )
    return F.when(net > 0, F.least(lot, F.coalesce(size(most), lot))).otherwise(zero).cast("double")


def simple_orders(projection: DataFrame, safety, moq, lead_days: int, today: str) -> DataFrame:
    """An order for the gap of every bucket below safety, in multiples of moq, nothing carried on."""
    gap = safety - F.col("closing")
    qty = F.when(moq > 0, F.ceil(gap / moq) * moq).otherwise(gap)
    need = F.date_add(F.lit(today).cast("date"), F.col("bucket") * 7)
    return projection.where(gap > 0).select("item_id", "location_id", "bucket", qty.cast("double").alias("qty"), F.greatest(F.date_sub(need, lead_days), F.lit(today).cast("date")).alias("order_date"))


def action_class(available, demand, zone):
    """EXPEDITE below zero, RELEASE at zero with demand, RESCHEDULE in a near zone, else a low RELEASE."""
    return F.when(available < 0, "EXPEDITE_HIGH").when((available == 0) & (demand > 0), "RELEASE_MEDIUM").when(zone != "LIQUID", "RESCHEDULE").otherwise("RELEASE_LOW")


def reorder_class(lead, runway):
    """NO_SOURCE, RECOVERABLE, TIGHT (up to two weeks late) or CRITICAL, by the days of margin."""
    margin = runway - lead
    return F.when(lead.isNull(), "NO_SOURCE").when(margin >= 0, "RECOVERABLE").when(margin >= -14, "TIGHT").otherwise("CRITICAL")
