"""Daily feeds: files grouped by feed and day, guards against a feed's own history, one decision a day over all feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names: a feed, its part (two digits or more) and its day.
NAME = r"^(.+?)(?:\.part(\d{2,}))?(?:_(\d{8}))?\.tsv$"
GUARDS = ("arrival_window", "volume_floor", "volume_delta", "deletion_ratio")
DELETIONS = 0.2


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """(feed, day, paths, arrived_at, length, issue) of the files of a folder by feed and day (eight digits, null if undated); paths in the order of their parts.

    Files of other names are left out; files are listed, not read. What is not one whole file, or all parts from 1 on, once each, has an issue and must
    not be loaded. Spark doesn't list empty files: they count as absent, so an empty part is missing.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.col("modificationTime").alias("at"))
    name = F.regexp_extract("path", r"[^/]+$", 0)
    piece = lambda i: F.nullif(F.regexp_extract(name, NAME, i), F.lit(""))
    named = files.select(piece(1).alias("feed"), piece(2).cast("int").alias("part"), piece(3).alias("day"), "path", "length", "at").where("feed is not null")
    parts = F.sort_array(F.collect_list(F.struct("part", "path")))
    found = named.groupBy("feed", "day").agg(parts.alias("files"), F.max("at").alias("arrived_at"), F.sum("length").alias("length"), F.count_if(F.col("part").isNull()).alias("whole"), F.countDistinct("part").alias("parts"), F.max("part").alias("last"), F.count("*").alias("n"))
    issue = (
        F.when((F.col("whole") > 1) | ((F.col("whole") == 1) & (F.col("parts") > 0)), "several files for one day")
        .when(F.col("n") > F.col("whole") + F.col("parts"), "a part twice")
        .when(F.col("parts") != F.coalesce("last", F.lit(0)), "parts are missing")
    )
    return found.select("feed", "day", F.col("files.path").alias("paths"), "arrived_at", "length", issue.alias("issue"))


def feed_days(rows: DataFrame) -> DataFrame:
    """(feed, run_date, rows, active, deleted, arrived_at, previous_rows, previous_active) by run, from rows (feed, run_date, id, at).

    A run is a day on which the feed has rows; the run before is the feed's last such day. An id counts as deleted if that had it and this hasn't.
    Ids are compared run by run, each with its own last run: no list of ids is gathered.
    """
    ids = rows.groupBy("feed", "run_date", "id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    days = ids.groupBy("feed", "run_date").agg(F.sum("n").alias("rows"), F.count("id").alias("active"), F.max("at").alias("arrived_at"))
    order = Window.partitionBy("feed").orderBy("run_date")  # a row for each day
    days = days.withColumns({"before": F.lag("run_date").over(order), "previous_rows": F.lag("rows").over(order), "previous_active": F.lag("active").over(order)})
    seen = ids.where("id is not null").withColumn("last", F.lag("run_date").over(Window.partitionBy("feed", "id").orderBy("run_date")))
    kept = seen.join(days.select("feed", "run_date", "before"), ["feed", "run_date"]).where(F.col("last") == F.col("before")).groupBy("feed", "run_date").agg(F.count("*").alias("kept"))
    out = days.join(kept, ["feed", "run_date"], "left")
    deleted = F.col("previous_active") - F.coalesce("kept", F.lit(0))
    return out.select("feed", "run_date", "rows", "active", deleted.alias("deleted"), "arrived_at", "previous_rows", "previous_active")


def deadline(cadence: str, minutes: int, day: Column) -> Column:
    """The latest moment for a feed of a cadence 'M H * * *' to come on a day; other cadences raise."""
    fields = cadence.split()
    if len(fields) != 5 or fields[2:] != ["*"] * 3 or not all(f.isdigit() for f in fields[:2]) or int(fields[0]) > 59 or int(fields[1]) > 23:
        raise ValueError(f"the cadence {cadence!r} is not of the form 'M H * * *'")
    after = (int(fields[1]) * 60 + int(fields[0]) + minutes) * 60
    return F.timestamp_add("SECOND", F.lit(after), day.cast("timestamp_ntz"))


def guards(days: DataFrame, contracts: DataFrame, due: Column, now: Column) -> DataFrame:
    """Adds the guards' verdicts to feed_days() (a missing feed has null rows): OK, FAILED or NOT_EVALUATED each, and `overall`, FAILED if any is.

    `contracts` has feed, criticality, min_rows, max_delta. A feed must come by its deadline `due`, and until then isn't judged; it must have min_rows,
    swing by max_delta of the run before at most, and keep 80 % of what was active then. Guards without a limit or a run to compare with aren't evaluated.
    """
    verdict = lambda unknown, bad: F.when(unknown, "NOT_EVALUATED").when(bad, "FAILED").otherwise("OK")
    both = days.join(contracts, "feed")
    missing, rows, before, active = F.col("arrived_at").isNull(), F.col("rows"), F.col("previous_rows"), F.col("previous_active")
    none = lambda c: F.coalesce(c, F.lit(0)) <= 0
    verdicts = {
        "arrival_window": verdict(missing & (now < due), F.coalesce(F.col("arrived_at") > due, F.lit(True))),
        "volume_floor": verdict(F.col("min_rows").isNull() | rows.isNull(), rows < F.col("min_rows")),
        "volume_delta": verdict(F.col("max_delta").isNull() | rows.isNull() | none(before), F.abs(rows - before) > F.col("max_delta") * before),
        "deletion_ratio": verdict(none(active) | F.col("deleted").isNull() | rows.isNull(), F.col("deleted") > DELETIONS * active),
    }
    out = both.withColumns(verdicts)
    failed = F.array_contains(F.array(*GUARDS), "FAILED")
    return out.withColumn("overall", F.when(failed, "FAILED").otherwise("OK"))


def daily_decision(judged: DataFrame, checks: DataFrame) -> DataFrame:
    """(run_date, status, feeds, red, open): ESCALATED if a blocking feed has failed its guards or data checks, DEGRADED if any feed isn't known to be in order, else AUTO_APPROVED.

    `checks` has feed, run_date, dq_status: 'passed', 'failed', or anything else (or nothing) for not evaluated. A criticality other than blocking or advisory raises.
    """
    sane = F.when(F.col("criticality").isin("blocking", "advisory"), F.col("criticality")).otherwise(F.raise_error(F.concat(F.lit("unknown criticality of feed "), F.col("feed"))))
    both = judged.withColumn("criticality", sane).join(checks, ["feed", "run_date"], "left")
    red = (F.col("overall") == "FAILED") | F.coalesce(F.col("dq_status") == "failed", F.lit(False))
    open_ = ~red & ~F.coalesce(F.col("dq_status") == "passed", F.lit(False))
    per = both.groupBy("run_date").agg(F.count("*").alias("feeds"), F.count_if(red).alias("red"), F.count_if(open_).alias("open"), F.count_if(red & (F.col("criticality") == "blocking")).alias("blocked"))
    status = F.when(F.col("blocked") > 0, "ESCALATED").when(F.col("red") + F.col("open") > 0, "DEGRADED").otherwise("AUTO_APPROVED")
    return per.select("run_date", status.alias("status"), "feeds", "red", "open")
