"""Feeds as files: delimited and JSON readers, staging as text, typed payloads, an outbound sink."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .written import written

#: Endings of names, and the separators of a delimited feed.
ENDINGS = {"tsv": "tsv", "tab": "tsv", "csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "xlsx": "xlsx"}
SEPARATORS = (",", ";", "\t", "|")


def head(spark: SparkSession, path: str, encoding: str = "UTF-8", lines: int = 20) -> list[str]:
    """The first lines of a feed that aren't blank; as many as that at most reach the driver."""
    rows = spark.read.text(path).where("trim(value) <> ''").limit(lines).select(F.decode(F.col("value").cast("binary"), encoding).alias("line"))
    return [r.line for r in rows.collect()]


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8, or Latin-1 if some line isn't valid UTF-8. This reads the feed once, up to the first such line of each task."""
    broken = spark.read.text(path).where(~F.call_function("is_valid_utf8", F.col("value")))
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def format_of(path: str, lines: list[str]) -> str:
    """tsv, csv, json or xlsx: by the name's ending, else by the first characters; a first line with a tab is tsv."""
    end = path.rstrip("/").rpartition("/")[2].rpartition(".")
    if end[1] and end[2].lower() in ENDINGS:
        return ENDINGS[end[2].lower()]
    first = lines[0].lstrip() if lines else ""
    if first.startswith("PK\x03\x04") or first.startswith("PK\x05\x06"):
        return "xlsx"
    if first[:1] in ("[", "{"):
        return "json"
    return "tsv" if "\t" in first else "csv"


def separator_of(lines: list[str]) -> str:
    """The separator that occurs as often in each of the first lines as in the header, most often of all; else a comma."""
    counts = {sep: lines[0].count(sep) for sep in SEPARATORS} if lines else {}
    even = [sep for sep, n in counts.items() if n and all(line.count(sep) >= n for line in lines)]
    return max(even or [sep for sep in counts if counts[sep]] or [","], key=lambda sep: counts.get(sep, 0))


def headers_of(line: str, sep: str, quoted: bool) -> list[str]:
    """A header line's names, without blanks around them; an empty name, or one that occurs twice whatever its case, raises."""
    names = [c.strip() for c in next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep, quoting=csv.QUOTE_MINIMAL if quoted else csv.QUOTE_NONE))]
    if not all(names):
        raise ValueError(f"the header has an empty column at {names.index('')}")
    if len({n.lower() for n in names}) != len(names):
        raise ValueError(f"the header has a column twice: {names}")
    return names


def named(column: str) -> str:
    """A header as a field name: lower case, words joined by underscores."""
    return re.sub(r"[^0-9a-z]+", "_", column.strip().lower()).strip("_")


def renamed(rows: DataFrame) -> DataFrame:
    """Rows with their columns as field names; two that become the same raise."""
    names = [named(c) for c in rows.columns]
    if len(set(names)) != len(names) or not all(names):
        raise ValueError(f"columns aren't told apart as field names: {rows.columns}")
    return rows.toDF(*names)


#: What goes before a number or truth value outside of strings, from where the last match ended, and that value.
_NUMBER = r"""\G((?:[^"\d\-tf]++|"(?:[^"\\]++|\\.)*+")*+)(-?\d[\d.eE+\-]*+|true|false)"""


def _json_rows(spark: SparkSession, path: str, encoding: str, whole: bool) -> DataFrame:
    """The objects of a JSON feed as text fields. Numbers and truth values are put in quotes before they are parsed, so that they stay as written."""
    kinds = spark.read.option("multiLine", whole).option("encoding", encoding).option("primitivesAsString", True).json(path).schema
    fields = StructType([f for f in kinds.fields if f.name != "_corrupt_record"])
    if not fields.fields and kinds.fields:
        raise ValueError("the feed is no JSON of objects")
    line = F.regexp_replace(F.decode(F.col("value").cast("binary"), encoding), _NUMBER, '$1"$2"')
    text = spark.read.text(path, wholetext=whole).select(line.alias("line"))
    if whole:
        rows = text.select(F.explode(F.from_json("line", ArrayType(fields))).alias("o"))
    else:
        rows = text.select(F.from_json("line", fields).alias("o"))
    rows = rows.where("o is not null").select("o.*")
    nested = [isinstance(f.dataType, (ArrayType, StructType)) for f in fields.fields]
    value = lambda f, deep: F.to_json(F.col(f"`{f.name}`")) if deep else F.col(f"`{f.name}`")
    return rows.select(*(F.coalesce(F.trim(value(f, deep)), F.lit("")).alias(f.name) for f, deep in zip(fields.fields, nested, strict=True)))


def read_feed(spark: SparkSession, path: str, *, sep: str | None = None, encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """All rows of a delimited or JSON feed, every field as text without blanks around it; what is absent is ''.

    Delimited feeds name their columns in the first line that isn't blank. A row with fewer fields gets '' for the rest, fields beyond
    are dropped, and rows without any text are left out. In a tsv a quote is a character like others; elsewhere fields may be quoted, and hold
    line ends if `multi_line` (then a file is read by one task). JSON is an array of objects, or an object a line: numbers stay as they are
    written, nested values stay JSON (with their numbers in quotes), and columns are all objects' keys, by name. What is no object makes no row; an empty
    array no columns. A feed without a line, and formats that Spark doesn't read, raise.
    """
    encoding = encoding or encoding_of(spark, path)
    lines = head(spark, path, encoding)
    if not lines:
        raise ValueError("the feed is empty")
    kind = format_of(path, lines)
    if kind == "xlsx":
        raise ValueError("workbooks are not read; export them as text")
    if kind == "json":
        return _json_rows(spark, path, encoding, lines[0].lstrip().startswith("["))
    sep = "\t" if kind == "tsv" else sep or separator_of(lines)
    names = headers_of(lines[0], sep, kind != "tsv")
    schema = StructType([StructField(n, StringType()) for n in names])
    reader = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", True).option("encoding", encoding).option("multiLine", multi_line).option("mode", "PERMISSIVE")
    rows = reader.option("quote", "" if kind == "tsv" else '"').option("escape", "" if kind == "tsv" else '"').csv(path)
    text = rows.select(*(F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names))
    return text.where(F.concat(*(F.col(f"`{n}`") for n in names)) != "")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file of a feed, as it is stored; a file is hashed by one task, and may have 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def stage(rows: DataFrame, batch: str) -> DataFrame:
    """A batch as raw rows: batch_id, row_id (from 1, in file order), content (all fields as a map).

    Rows are written where they are read, and a task's rows numbered on from those of the tasks before.
    """
    pairs = [x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    bits = 33  # of a row's number within its task
    held = written(rows.select(F.monotonically_increasing_id().alias("_at"), F.create_map(*pairs).alias("content")))
    task = F.shiftright("_at", bits)
    sizes = held.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = written(sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    numbered = held.withColumn("_task", task).join(starts, "_task")
    return numbered.select(F.lit(batch).alias("batch_id"), (F.col("_start") + F.col("_at") - F.shiftleft("_task", bits) + 1).alias("row_id"), "content")


def payload(staged: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """Typed fields of staged rows and `errors`: the names of those whose text isn't of its type. Fields outside the contract are left."""
    value = {f: F.trim(F.try_element_at("content", F.lit(f))) for f in contract}
    typed = {f: value[f].try_cast(kind) for f, kind in contract.items()}
    wrong = F.filter(F.array(*(F.when(value[f].isNotNull() & (value[f] != "") & typed[f].isNull(), F.lit(f)) for f in contract)), lambda x: x.isNotNull())
    return staged.select("batch_id", "row_id", *(c.alias(f) for f, c in typed.items()), wrong.alias("errors"))


def write_tsv(rows: DataFrame, path: str) -> None:
    """Rows as tab-separated text without quotes, with a header in each part. A tab or line end inside a field raises: it would make other rows of it."""
    text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns}
    safe = lambda c, v: F.when(v.rlike("[\\t\\r\\n]"), F.raise_error(F.lit(f"a tab or line end in column {c}"))).otherwise(v)
    line = F.concat_ws("\t", *(safe(c, v) for c, v in text.items()))
    writer = rows.select(line.alias("\t".join(rows.columns))).write.option("sep", "\x01").option("header", True).option("quote", "").option("emptyValue", "")
    writer.mode("overwrite").csv(path)
