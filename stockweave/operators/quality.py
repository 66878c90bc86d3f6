"""Data quality: layered rules over staged rows, statistics over time, batch diffs, versioned parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issue(code: str, field: str, when: Column, severity: str = "error") -> Column:
    """An issue struct where the condition holds, else null."""
    return F.when(when, F.struct(F.lit(code).alias("rule_code"), F.lit(field).alias("field_name"), F.lit(severity).alias("severity")))


def check_rows(rows: DataFrame, key: str, rules: list[Column]) -> DataFrame:
    """One row per issue: all rules are evaluated in one pass."""
    return rows.select(key, F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("i")).select(key, "i.*")


def structural(fields: Mapping[str, str]) -> list[Column]:
    """Level 1: mandatory fields and their types; a missing field isn't checked further."""
    out = []
    for name, kind in fields.items():
        text = F.trim(F.col(name))
        missing = F.coalesce(text, F.lit("")) == ""
        bad = {
            "date": F.try_to_date(text).isNull(),
            "positive": F.coalesce(text.try_cast("double") <= 0, F.lit(True)),
            "non_negative": F.coalesce(text.try_cast("double") < 0, F.lit(True)),
            "int": text.try_cast("long").isNull(),
        }.get(kind, F.lit(False))
        out += [issue("L1_MISSING", name, missing), issue("L1_TYPE", name, ~missing & bad)]
    return out


def amount(field: str, most: float) -> list[Column]:
    """Level 3: a quantity above zero, and not above what is plausible; what isn't a number is level 1's."""
    value = F.trim(F.col(field)).try_cast("double")
    return [issue("L3_QUANTITY_NONPOSITIVE", field, value <= 0), issue("L3_QUANTITY_SUSPICIOUS", field, value > most, "warning")]


def dates_within(field: str, first: str, last: str) -> list[Column]:
    """Level 3: a date in a plausible range."""
    day = F.try_to_date(F.trim(F.col(field)))
    return [issue("L3_DATE_OUT_OF_RANGE", field, (day < F.lit(first).cast("date")) | (day > F.lit(last).cast("date")), "warning")]


def not_before(start: str, end: str) -> list[Column]:
    """Level 3: a span that doesn't end before it begins."""
    return [issue("L3_DATE_RANGE_INVERTED", end, F.try_to_date(F.trim(F.col(end))) < F.try_to_date(F.trim(F.col(start))))]


def batch_similarity(batch: DataFrame, before: DataFrame, fields: list[str], most: float = 0.95) -> DataFrame:
    """The share of a batch's distinct rows that the batch before had too, and whether it is over `most`: the batch was sent twice."""
    prints = lambda rows: rows.select(F.xxhash64(*(normal(F.col(f)) for f in fields)).alias("print")).distinct()
    both = prints(batch).join(prints(before).withColumn("seen", F.lit(True)), "print", "left")
    share = F.count("seen") / F.count("*")
    return both.agg(F.count("*").alias("n"), share.alias("similarity"), (share > most).alias("duplicate"))


def unknown_references(rows: DataFrame, key: str, reference: DataFrame, to: str) -> DataFrame:
    """Level 2: rows whose reference doesn't exist."""
    return rows.join(reference.select(F.col(to).alias(key)), key, "left_anti")


def duplicates_in_batch(rows: DataFrame, key: str) -> DataFrame:
    """Level 4: ids that a batch has more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def index_quartiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles by index (n div 4, 3n div 4) of groups of four values or more, and the fences of 1.5 ranges.

    Values are numbered in their order, so that a large group is sorted (and spilled), never gathered.
    """
    placed = rows.where(F.col(value).isNotNull()).select(group, value, F.row_number().over(Window.partitionBy(group).orderBy(value)).alias("at"), F.count("*").over(Window.partitionBy(group)).alias("n")).where("n >= 4")
    at = lambda place: F.max(F.when(F.col("at") == place + 1, F.col(value)))
    out = placed.groupBy(group).agg(at(F.floor(F.col("n") / 4)).alias("q1"), at(F.floor(3 * F.col("n") / 4)).alias("q3"))
    return out.withColumn("low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))


def price_outliers(rows: DataFrame, group: str, value: str) -> DataFrame:
    fences = index_quartiles(rows, group, value)
    return rows.join(fences, group).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def drifted(now: DataFrame, history: DataFrame, key: str, value: str) -> DataFrame:
    """Values more than three sample deviations from their history's mean (any change, if it never varied)."""
    stats = history.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).where("n >= 3")
    far = F.when(F.col("sd") == 0, F.col(value) != F.col("mean")).otherwise(F.abs(F.col(value) - F.col("mean")) > 3 * F.col("sd"))
    return now.join(stats, key).where(far)


def impact(shortages: Column, weight: float) -> Column:
    return F.round(weight * (1 + F.log1p(shortages)), 4)


def normal(value: Column) -> Column:
    """For comparing: null as empty, else the trimmed text."""
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def batch_diff(batch: DataFrame, canonical: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """insert, update, noop or delete for every key of either side."""
    a = batch.select(F.col(key), F.struct(*[normal(F.col(f)).alias(f) for f in fields]).alias("new"))
    b = canonical.select(F.col(key), F.struct(*[normal(F.col(f)).alias(f) for f in fields]).alias("old"))
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("new") == F.col("old"), "noop").otherwise("update")
    return a.join(b, key, "full_outer").select(key, kind.alias("action"))


def diff_summary(diff: DataFrame, most_deleted: float = 0.2) -> DataFrame:
    """Counts, and whether the share of deletions needs force."""
    of = lambda a: F.count_if(F.col("action") == a)
    ratio = of("delete") / F.greatest(F.count("*") - of("insert"), F.lit(1))
    return diff.agg(of("insert").alias("inserts"), of("update").alias("updates"), of("noop").alias("noops"), of("delete").alias("deletes"), F.round(ratio, 6).alias("deletion_ratio"), (ratio > most_deleted).alias("needs_force"))


def versioned(current: DataFrame, incoming: DataFrame, key: str, fields: list[str], today: str) -> DataFrame:
    """SCD2: the rows after applying a feed, with effective_from and effective_to (null: current).

    Unchanged keys stay; a change on the day a version began is made in place; others
    close it today and open a new one; new keys begin today.
    """
    day = F.lit(today).cast("date")
    new = incoming.select(key, F.struct(*fields).alias("new"))
    old = current.select(key, F.struct(*fields).alias("old"), "effective_from")
    both = old.join(new, key, "full_outer").withColumn(
        "action",
        F.when(F.col("old").isNull(), "created").when(F.col("new").isNull() | (F.col("new") == F.col("old")), "noop").when(F.col("effective_from") == day, "in_place").otherwise("rotated"),
    )
    none = F.lit(None).cast("date")
    row = lambda values, start, end: F.struct(F.col(values).alias("v"), start.alias("effective_from"), end.alias("effective_to"))
    rows = F.when(F.col("action") == "created", F.array(row("new", day, none))).when(F.col("action") == "noop", F.array(row("old", F.col("effective_from"), none))).when(F.col("action") == "in_place", F.array(row("new", F.col("effective_from"), none)))
    rows = rows.otherwise(F.array(row("old", F.col("effective_from"), day), row("new", day, none)))
    return both.select(key, "action", F.explode(rows).alias("r")).select(key, "action", "r.v.*", "r.effective_from", "r.effective_to")


def overlay(base: DataFrame, overrides: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Parameters with scenario overrides: an exact location beats an item-wide one beats the base.

    `overrides` has item_id, location_id (null: item-wide), field_name, value; `fields` maps names to types.
    """
    wide = [F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in fields]
    exact = overrides.where("location_id is not null").groupBy("item_id", "location_id").agg(*wide)
    general = overrides.where("location_id is null").groupBy("item_id").agg(*wide)
    out = base.alias("b").join(exact.alias("x"), ["item_id", "location_id"], "left").join(general.alias("g"), "item_id", "left")
    chosen = [F.coalesce(F.col(f"x.{f}").try_cast(t), F.col(f"g.{f}").try_cast(t), F.col(f"b.{f}")).alias(f) for f, t in fields.items()]
    return out.select("item_id", "location_id", *chosen)


def reconcile(recommended: DataFrame, received: DataFrame, tolerance: float = 0.05, days: int = 7) -> DataFrame:
    """Each recommendation matched with a plausible receipt: matched only one to one, ambiguous with more, else unmatched.

    Dates meet in spans of `days` days and their neighbours, so an item of many receipts doesn't meet all its recommendations.
    """
    span = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (days + 1))
    near = (F.abs(F.col("qty") - F.col("got")) <= tolerance * F.col("qty")) & (F.abs(F.datediff("need", "arrived")) <= days)
    asked = recommended.select("*", F.explode(F.sequence(span("need") - 1, span("need") + 1)).alias("span"))
    pairs = asked.join(received.withColumn("span", span("arrived")), ["item_id", "span"]).where(near).select("recommendation_id", "receipt_id")
    of = lambda c: F.count("*").over(Window.partitionBy(c))
    counted = pairs.withColumn("n", of("recommendation_id")).withColumn("m", of("receipt_id"))
    told = counted.groupBy("recommendation_id").agg(F.max(F.greatest("n", "m")).alias("most"), F.min("receipt_id").alias("receipt_id"))
    status = F.when(F.col("most").isNull(), "unmatched").when(F.col("most") == 1, "matched").otherwise("ambiguous")
    return recommended.join(told, "recommendation_id", "left").select("recommendation_id", status.alias("status"), F.when(F.col("most") == 1, F.col("receipt_id")).alias("receipt_id"))


def outcome(acted: Column, predicted: Column, observed: Column) -> Column:
    """What became of a predicted deficit."""
    share = observed / F.nullif(predicted, F.lit(0.0))
    return F.when(~acted, "NOT_APPLICABLE").when(observed.isNull() | share.isNull(), "INDETERMINATE").when(share <= 0.05, "AVOIDED").when(share >= 0.9, "MATERIALIZED").otherwise("PARTIAL")
