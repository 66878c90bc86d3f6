"""Registered queries on daily feeds, with the event log's types as feeds; and a feed written, read and staged. Each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import feeds
from ..sources import files
from ..sources import planning as p
from ..sources.written import folder
from .registry import STAGED, query, staged

CONTRACTS = (("view", "advisory", 55, 0.25), ("error", "advisory", None, 0.5), ("click", "advisory", 60, None), ("signup", "blocking", 40, 0.6), ("purchase", "blocking", 45, 0.4))
CADENCE, MINUTES, GROUP = "30 22 * * *", 45, 15

DAYS = f""", e AS (SELECT event_type AS feed, CAST(ts AS DATE) AS run_date, user_id // {GROUP} AS id, ts, value FROM events
), ids AS (SELECT feed, run_date, id, count(*) AS n, max(ts) AS at_ FROM e GROUP BY ALL
), runs AS (SELECT feed, run_date, CAST(sum(n) AS BIGINT) AS rows, count(id) AS active, max(at_) AS arrived_at FROM ids GROUP BY ALL
), prior AS (SELECT *, lag(run_date) OVER w AS before, lag(rows) OVER w AS previous_rows, lag(active) OVER w AS previous_active FROM runs WINDOW w AS (PARTITION BY feed ORDER BY run_date)
), fdays AS (SELECT r.* EXCLUDE (before), previous_active - (SELECT count(*) FROM ids a JOIN ids b ON a.feed = b.feed AND a.id = b.id WHERE a.feed = r.feed AND a.run_date = r.run_date AND b.run_date = r.before) AS deleted FROM prior r
), contracts(feed, criticality, min_rows, max_delta) AS (VALUES {", ".join(f"('{a}', '{b}', {'NULL' if c is None else c}, {'NULL' if m is None else m})" for a, b, c, m in CONTRACTS)}
), judged AS (SELECT feed, run_date, criticality, rows, deleted, CASE WHEN arrived_at > run_date + INTERVAL 23 HOUR + INTERVAL 15 MINUTE THEN 'FAILED' ELSE 'OK' END AS arrival_window, CASE WHEN min_rows IS NULL THEN 'NOT_EVALUATED' WHEN rows < min_rows THEN 'FAILED' ELSE 'OK' END AS volume_floor,
  CASE WHEN max_delta IS NULL OR previous_rows IS NULL THEN 'NOT_EVALUATED' WHEN abs(rows - previous_rows) > CAST(max_delta AS DOUBLE) * previous_rows THEN 'FAILED' ELSE 'OK' END AS volume_delta, CASE WHEN previous_active IS NULL THEN 'NOT_EVALUATED' WHEN deleted > 0.2 * previous_active THEN 'FAILED' ELSE 'OK' END AS deletion_ratio FROM fdays JOIN contracts USING (feed)
), verdicts AS (SELECT *, CASE WHEN 'FAILED' IN (arrival_window, volume_floor, volume_delta, deletion_ratio) THEN 'FAILED' ELSE 'OK' END AS overall FROM judged)"""


def _judged(spark, d):
    log = p.table(spark, d, "events")
    rows = log.select(F.col("event_type").alias("feed"), F.col("ts").cast("date").alias("run_date"), F.floor(F.col("user_id") / GROUP).alias("id"), F.col("ts").alias("at"))
    contracts = spark.createDataFrame(CONTRACTS, "feed string, criticality string, min_rows long, max_delta double")
    return feeds.guards(feeds.feed_days(rows), contracts, feeds.deadline(CADENCE, MINUTES, F.col("run_date")), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))


@query(f"{DAYS} SELECT feed, run_date, rows, deleted, arrival_window, volume_floor, volume_delta, deletion_ratio, overall FROM verdicts")
def feed_guards(spark, d):
    return _judged(spark, d).select("feed", "run_date", "rows", "deleted", *feeds.GUARDS, "overall")


@query(f"""{DAYS}, checks AS (SELECT feed, run_date, CASE WHEN min(value) < 0.02 THEN 'failed' WHEN min(value) < 0.2 THEN 'passed' END AS dq FROM e GROUP BY ALL
), v AS (SELECT *, overall = 'FAILED' OR coalesce(dq = 'failed', false) AS red, coalesce(dq = 'passed', false) AS green FROM verdicts JOIN checks USING (feed, run_date))
SELECT run_date, CASE WHEN bool_or(red AND criticality = 'blocking') THEN 'ESCALATED' WHEN bool_or(red OR NOT green) THEN 'DEGRADED' ELSE 'AUTO_APPROVED' END AS status, count(*) AS feeds, count(*) FILTER (red) AS red, count(*) FILTER (NOT red AND NOT green) AS open FROM v GROUP BY 1""")
def daily_decisions(spark, d):
    """One decision for each day over all feeds, with a check of each feed's smallest value as its data quality."""
    log = p.table(spark, d, "events").groupBy(F.col("event_type").alias("feed"), F.col("ts").cast("date").alias("run_date")).agg(F.min("value").alias("least"))
    checks = log.select("feed", "run_date", F.when(F.col("least") < 0.02, "failed").when(F.col("least") < 0.2, "passed").alias("dq_status"))
    return feeds.daily_decision(_judged(spark, d), checks)


@query(f"""SELECT id, item, TRY_CAST(qty AS INT) AS qty, TRY_CAST(due AS DATE) AS due, concat_ws(',', CASE WHEN TRY_CAST(qty AS INT) IS NULL THEN 'qty' END, CASE WHEN TRY_CAST(due AS DATE) IS NULL THEN 'due' END) AS errors FROM {STAGED}""")
def feed_payloads(spark, d):
    """The staged lines written as a tab-separated feed, read again by the reader's rules, numbered and typed by a contract."""
    place = f"{folder(spark)}/feeds/{uuid.uuid4().hex}.tsv"
    files.write_tsv(staged(spark, d), place)
    rows = files.stage(files.read_feed(spark, place, encoding="UTF-8"), "batch")
    typed = files.payload(rows, {"id": "bigint", "item": "string", "qty": "int", "due": "date"})
    return typed.select("id", "item", "qty", "due", F.array_join("errors", ",").alias("errors"))
