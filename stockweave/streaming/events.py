"""Structured Streaming over the event log, and recomputation of what events touch."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import projection as stock
from ..sources.written import counted, folder, written


def window_totals(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events, and their values in ten-thousandths, by tumbling window and type.

    Times have no zone and are taken as UTC, whatever the session's. Of a stream written in
    append or update mode, events more than `late` behind the latest are dropped and their state goes.
    """
    moment = F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)")
    kept = events.withColumn("ts", moment)
    totals = (kept.withWatermark("ts", late) if events.isStreaming else kept).groupBy(F.window("ts", width).alias("w"), "event_type")
    sums = totals.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("long")).alias("units"))
    return sums.select(F.expr("convert_timezone(current_timezone(), 'UTC', cast(w.start as timestamp_ntz))").alias("start"), "event_type", "n", "units")


def drained(spark: SparkSession, stream: DataFrame, place: str | None = None) -> DataFrame:
    """The result of a streaming aggregation over all that its source holds by now.

    Each micro-batch writes the whole result in a folder of its own, and only then names it the latest; the folder before last goes. State and
    results are in `place`: called again with it, the stream goes on from there, also after a driver is lost. Without it the folder is new.
    """
    place = place or f"{folder(spark)}/streams/{uuid.uuid4().hex}"
    path = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join((place, *parts)))
    files = path("result").getFileSystem(spark._jsc.hadoopConfiguration())

    def batches() -> list[int]:
        found = files.listStatus(path("result")) if files.exists(path("result")) else []
        return sorted(int(f.getPath().getName()) for f in found if files.exists(path("result", f.getPath().getName(), "_SUCCESS")))

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/result/{batch}")
        for old in batches()[:-2]:
            files.delete(path("result", str(old)), True)

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    done = batches()
    return spark.read.schema(stream.schema).parquet(f"{place}/result/{done[-1]}") if done else spark.createDataFrame([], stream.schema)


def part_of(parts: int) -> Column:
    """Which of a written plan's partitions a series is in."""
    return F.pmod(F.xxhash64(*stock.SERIES), F.lit(parts)).cast("int")


def _put_rows(rows: DataFrame, count: int, plan: str, **options: str) -> None:
    """Rows with `part`, written by it. Ranges of about a million rows, so that what a task sorts by part stays small, and a part has few files."""
    ranged = rows.repartitionByRange(max(1, -(-count // 1_000_000)), "part", *stock.SERIES)
    ranged.write.mode("overwrite").options(**options).partitionBy("part").parquet(plan)


def put_plan(series: DataFrame, plan: str, parts: int) -> None:
    """The projection of series flows, written by `part_of`: series are dealt to tasks before they become rows."""
    held, n = counted(series.withColumn("part", part_of(parts)))
    ranged = held.repartitionByRange(max(1, -(-n["rows"] // 40_000)), "part", *stock.SERIES)
    stock.project_series(ranged, "part").write.mode("overwrite").partitionBy("part").parquet(plan)


def _anew(moves: DataFrame, series: DataFrame, buckets: int, tasks: int | None) -> DataFrame:
    """The projection of the series in `series`, from their moves; these are dealt to `tasks` tasks if given, so that what a task sums stays small."""
    dealt = moves.repartition(tasks, *stock.SERIES) if tasks else moves
    return stock.project_series(stock.series_flows(dealt.join(series, list(stock.SERIES), "left_semi"), buckets))


def replanned(spark: SparkSession, changes: DataFrame, moves: DataFrame, plan: str, state: str, buckets: int, parts: int = 16, tasks: int | None = None) -> DataFrame:
    """A plan kept up to date by a stream of changed lines (series and qty at least): only partitions that changes touch are rewritten.

    `plan` is a folder of a projection, written by `part_of`, a hash of the series; the first batch on an empty folder
    writes it whole. A batch finds its series, and projects those from their moves as they are by then; the others in the same partitions are
    copied. Partitions without a change aren't read. `state` has the stream's progress: a restarted stream goes on from
    there, and a batch that is done twice writes the same. Moves of changed series are dealt to `tasks` tasks.
    """
    part = part_of(parts)
    known = spark._jvm.org.apache.hadoop.fs.Path(f"{plan}/_SUCCESS")
    files = known.getFileSystem(spark._jsc.hadoopConfiguration())

    def put(rows: DataFrame, batch: int) -> None:
        if not files.exists(known):
            put_plan(stock.series_flows(moves, buckets), plan, parts)
            return
        series = written(rows.select(*stock.SERIES, part.alias("part")).distinct())
        touched = [r.part for r in series.select("part").distinct().collect()]  # as many as `parts` at most
        if not touched:
            return
        keys = series.drop("part").hint("shuffle_hash")  # the keys are hashed; the plan's rows need no sort
        anew = _anew(moves, keys, buckets, tasks).withColumn("part", part)
        current = spark.read.parquet(plan).where(F.col("part").isin(touched))
        fresh, n = counted(current.join(keys, list(stock.SERIES), "left_anti").select(*anew.columns).unionByName(anew))  # before what it reads is replaced
        _put_rows(fresh, n["rows"], plan, partitionOverwriteMode="dynamic")

    changes.writeStream.option("checkpointLocation", state).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(plan).drop("part")


def refreshed(current: DataFrame, moves: DataFrame, dirty: DataFrame, buckets: int, tasks: int | None = None) -> DataFrame:
    """A projection after changes: series in `dirty` are projected anew from their moves, in `tasks` tasks; all others stay as they are in `current`."""
    series = dirty.select(*stock.SERIES).distinct().hint("shuffle_hash")  # the keys are hashed; the plan's rows need no sort
    return current.join(series, list(stock.SERIES), "left_anti").unionByName(_anew(moves, series, buckets, tasks))
