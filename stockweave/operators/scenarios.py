"""Scenarios: forks of a plan's nodes and edges, overrides that keep the value they replace, differences, promotion, comparison.

Nodes have node_id, the business key KEY, and fields; a node of a fork is another than its original's, but has its key. Keys are compared null-safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written
from .hierarchy import refuse

KEY = ("node_type", "item_id", "location_id", "span_start", "sequence")
DIFFED = ("closing", "opening", "inflows", "outflows", "has_shortage", "shortage_qty")


def other(rows: DataFrame) -> DataFrame:
    """Rows with their key's columns under other names, for the right side of a join by SAME."""
    return rows.withColumnsRenamed({k: f"_key_{k}" for k in KEY})


SAME = " and ".join(f"{k} <=> _key_{k}" for k in KEY)


def fork(nodes: DataFrame, edges: DataFrame, scenario: str) -> tuple[DataFrame, DataFrame]:
    """Copies of the active nodes and of the edges between them, with ids of the scenario's own; nothing that has been computed for a node is dirty or lost.

    An id is the hash of the scenario and the original's, so that a fork made again is the same. Edges that lead to or
    from what is no active node raise.
    """
    own = lambda c: F.sha2(F.concat_ws(":", F.lit(scenario), c), 256)
    live = nodes.where("active")
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id"))
    refuse(ends.join(live.select("node_id"), "node_id", "left_anti").select("node_id").distinct(), "edges without an active node")
    return live.withColumn("node_id", own(F.col("node_id"))), edges.withColumns({"from_id": own(F.col("from_id")), "to_id": own(F.col("to_id"))})


def recorded(nodes: DataFrame, changes: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """The overrides of a scenario's nodes: (node_id, field_name, old_value, new_value), from changes (node_id, KEY, field_name, value, at).

    A change is for the node of that id, or else for all active nodes of its key. The old value is the one before the first change of
    a field, the new one the last change's (of one moment the largest). Fields that aren't allowed raise; changes of no node are left out.
    """
    refuse(changes.where(~F.col("field_name").isin(list(allowed))).select("field_name").distinct(), "fields that can't be overridden")
    changes = written(changes)
    live = nodes.where("active")
    direct = changes.join(live.select("node_id"), "node_id").select("node_id", "field_name", "value", "at")
    rest = changes.join(live.select("node_id"), "node_id", "left_anti")
    by_key = rest.join(other(live.select(F.col("node_id").alias("of"), *KEY)), F.expr(SAME)).select(F.col("of").alias("node_id"), "field_name", "value", "at")
    last = direct.unionByName(by_key).groupBy("node_id", "field_name").agg(F.max(F.struct("at", "value"))["value"].alias("new_value"))
    old = F.coalesce(*(F.when(F.col("field_name") == f, F.col(f).cast("string")) for f in allowed))
    return last.join(live.select("node_id", *allowed), "node_id").select("node_id", "field_name", old.alias("old_value"), "new_value")


def overridden(nodes: DataFrame, ledger: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The nodes with their overrides, and `is_dirty` where there is any."""
    kinds = dict(nodes.dtypes)
    wide = ledger.groupBy("node_id").agg(*(F.max(F.when(F.col("field_name") == f, F.struct(F.lit(1).alias("set"), "new_value"))).alias(f"_{f}") for f in fields))
    out = nodes.join(wide, "node_id", "left")
    value = lambda f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["new_value"].try_cast(kinds[f])).otherwise(F.col(f))
    dirty = reduce(lambda a, b: a | b, (F.col(f"_{f}").isNotNull() for f in fields))
    return out.select(*(value(c).alias(c) if c in fields else F.col(c) for c in nodes.columns if c != "is_dirty"), dirty.alias("is_dirty"))


def _one_each(nodes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One node of each key, that of the largest id."""
    return nodes.groupBy(*KEY).agg(F.max_by(F.struct("node_id", *(F.col(f).cast("string").alias(f) for f in fields)), "node_id").alias("n")).select(*KEY, "n")


def difference(base: DataFrame, scenario: DataFrame, fields: Sequence[str] = DIFFED) -> DataFrame:
    """(KEY, node_id, field_name, base_value, scenario_value) of every field that differs between nodes of a key, as text. What one side lacks is null there."""
    a, b = _one_each(base, fields).withColumnRenamed("n", "a"), _one_each(scenario, fields).withColumnRenamed("n", "b")
    both = a.join(other(b), F.expr(SAME), "full_outer").select(*(F.coalesce(k, f"_key_{k}").alias(k) for k in KEY), "a", "b")
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col("a")[f].alias("base_value"), F.col("b")[f].alias("scenario_value")) for f in fields))
    node = F.coalesce(F.col("b.node_id"), F.col("a.node_id"))
    return both.select(*KEY, node.alias("node_id"), F.explode(F.filter(each, lambda e: ~e["base_value"].eqNullSafe(e["scenario_value"]))).alias("e")).select(*KEY, "node_id", "e.*")


def _matched(base: DataFrame, scenario: DataFrame, ledger: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each override with the active nodes of the base that have its node's key, and their present value."""
    live = base.where("active")
    own = ledger.join(scenario.select("node_id", *KEY), "node_id").drop("node_id")
    both = own.join(other(live.select(F.col("node_id").alias("of"), *KEY, *(F.col(f).cast("string").alias(f"_{f}") for f in fields))), F.expr(SAME))
    now = F.coalesce(*(F.when(F.col("field_name") == f, F.col(f"_{f}")) for f in fields))
    return both.select(F.col("of").alias("node_id"), "field_name", F.col("old_value").alias("expected"), now.alias("actual"), "new_value")


def conflicts(base: DataFrame, scenario: DataFrame, ledger: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(node_id, field_name, expected, actual): fields of the base that have changed since they were overridden."""
    return _matched(base, scenario, ledger, fields).where(~F.col("expected").eqNullSafe(F.col("actual"))).drop("new_value")


def promoted(base: DataFrame, scenario: DataFrame, ledger: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The base with a scenario's overrides. If any is in conflict, that raises and nothing is changed; overrides of nodes that the base no longer has are left out."""
    found = written(_matched(base, scenario, ledger, fields))
    refuse(found.where(~F.col("expected").eqNullSafe(F.col("actual"))).select("node_id", "field_name", "expected", "actual"), "the base has changed")
    return overridden(base, found.select("node_id", "field_name", "new_value"), fields)


def compared(figures: DataFrame, order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Figures (plan, names) of two to five plans, and each less those of the reference, as `delta_...`: that is 'base', or the first of `order` if there is no base.

    Fewer or more plans, one named twice, and plans without figures raise.
    """
    if not 2 <= len(order) <= 5 or len(set(order)) != len(order):
        raise ValueError(f"two to five different plans are compared, not {list(order)}")
    rows = written(figures.where(F.col("plan").isin(list(order))))
    absent = set(order) - {r.plan for r in rows.select("plan").collect()}
    if absent:
        raise ValueError(f"no such plans: {sorted(absent)}")
    reference = "base" if "base" in order else order[0]
    first = F.first(F.when(F.col("plan") == reference, F.struct(*names)), ignorenulls=True).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # five rows at most
    both = rows.withColumn("_of", first)
    return both.select("plan", *names, *(F.round(F.col(n) - F.col("_of")[n], 6).alias(f"delta_{n}") for n in names))
