"""Dates, buckets and spans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day: Column) -> Column:
    """The Monday of the day's week."""
    return F.date_trunc("week", day).cast("date")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def bucket_end(start: Column, grain: str) -> Column:
    """Exclusive end of a bucket."""
    return {"day": F.date_add(start, 1), "week": F.date_add(start, 7), "month": F.add_months(F.trunc(start, "month"), 1)}[grain]


def week_index(day: Column, start: Column) -> Column:
    """Weeks from the horizon's start; past days fall in week 0."""
    return F.greatest(F.lit(0), F.floor(F.datediff(day, start) / 7)).cast("int")


def lead_weeks(days: Column) -> Column:
    """Whole weeks of a lead time; none or zero is 30 days."""
    return F.ceil(F.coalesce(F.nullif(days, F.lit(0)), F.lit(30)) / 7).cast("int")


def overlap_days(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Days that two half-open spans share."""
    return F.greatest(F.lit(0), F.datediff(F.least(end, other_end), F.greatest(start, other_start)))


def prorated(qty: Column, start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """The share of a span's quantity that falls in another span; spans of no days count nothing."""
    days = F.datediff(end, start)
    return F.when(days > 0, qty / days * overlap_days(start, end, other_start, other_end)).otherwise(F.lit(0.0))


def transition_weight(day: Column, start: Column, end: Column, curve: Column, first: Column, last: Column) -> Column:
    """Weight of a phase transition on a day: linear, step or sigmoid; without dates the first weight."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.datediff(day, start) / F.datediff(end, start)))
    smooth = 3 * share * share - 2 * share * share * share
    moved = F.when(curve == "sigmoid", smooth).otherwise(share)
    between = F.when(curve == "step", F.when(day >= end, last).otherwise(first)).otherwise(first + (last - first) * moved)
    return F.when(start.isNull() | end.isNull() | (day <= start), first).when(day >= end, last).otherwise(between)


def iso_label(day: Column) -> Column:
    """Calendar year and ISO week, as `1998-W02`."""
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def zone(day: Column, today: Column, frozen: int, slashed: int) -> Column:
    """FROZEN, SLASHED or LIQUID by the days ahead."""
    ahead = F.datediff(day, today)
    return F.when(ahead <= frozen, "FROZEN").when(ahead <= slashed, "SLASHED").otherwise("LIQUID")
