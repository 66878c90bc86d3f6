"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that `column` holds about `most` bytes in each slice (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the named public vocabulary file is installed."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the cluster's checkpoint folder if it names one, else (tests) one beside the warehouse."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').removesuffix('/')}/_checkpoints").removesuffix("/")


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder; its lineage is cut, and lost executors lose nothing of it."""
    place = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def published(spark: SparkSession, data: bytes, kind: str) -> str:
    """The name by which SparkFiles has these bytes on every executor. They lie in the shared folder; Spark copies them from there."""
    name = f"{kind}-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/files/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def dropped(*tables: DataFrame) -> None:
    """Delete what saved() has written for tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for place in {name.rpartition("/")[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
