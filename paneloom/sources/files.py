"""Reading and converting input files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from paneloom.session import saved

_CORRUPT = "_corrupt_record"
_END = "\ue000"


class MissingInput(ValueError):
    """No file matches the pattern."""


def read_parquet(
    spark: SparkSession, pattern: str, schema: T.StructType | None = None
) -> DataFrame:
    """All files of a pattern as one table. With a schema no file is opened to learn it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(pattern)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"no file matches {pattern}") from error
        raise


def file_count(df: DataFrame) -> int:
    return len(df.inputFiles())


def with_file_position(spark: SparkSession, pattern: str) -> DataFrame:
    """The table with ``file_path`` and ``row_index``, which order rows that are equal
    in all columns; useful as the tie columns of a panel."""
    df = read_parquet(spark, pattern)
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; any malformed line is an error. Without a schema the types
    are inferred, which reads the file once more."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return _csv(reader, path)


def read_csv_tolerant(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with a header; lines that do not fit the schema are skipped.

    Without a schema it is inferred from all lines. Whole lines are judged, also
    when only some columns are read.
    """
    schema = _declared(spark, path, schema)
    with_bad = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    reader = (
        spark.read.schema(with_bad)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
    )
    # Only columns that are read are parsed and judged; this always holds and reads
    # all of them.
    every = F.hash(*schema.names) >= F.lit(-(2**31))
    return _csv(reader, path).where(F.col(_CORRUPT).isNull() & every).drop(_CORRUPT)


@dataclass(frozen=True)
class CsvAudit:
    """What `read_csv_tolerant` skips. ``rejected``: file_path, line (from 1), cause, text.
    ``counts``: file_path, lines, headers, blank, accepted, rejected; the last four add up to
    the lines."""

    rejected: DataFrame
    counts: DataFrame


def audit_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> CsvAudit:
    """Every line of CSV files that does not fit the schema, with its place and the cause.

    A header is the first line of a file that is not blank, as the readers take it. Causes are
    "too few fields", "too many fields", "<column> is no <type>" for the first such column, and
    "unreadable". Lines are read once; a written table keeps, for each, its order within its part
    of the file, and its text if it is rejected. Line numbers are these orders plus the lines of
    the file's parts before. Files without lines have no counts.
    """
    schema = _declared(spark, path, schema)
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"no file matches {path}") from error
        raise
    cause = _cause(schema)
    marked = saved(
        lines.select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("id"),
            F.col("value").rlike(r"\A[\x00-\x20]*\z").alias("blank"),
            "value",
        )
        .withColumn("cause", F.when(~F.col("blank"), cause))
        .withColumn("text", F.when(F.col("cause").isNotNull(), F.col("value")))
        .drop("value")
    )
    filled = F.when(~F.col("blank"), F.col("id"))
    parts = marked.groupBy("file_path", "start").agg(
        F.count("id").alias("lines"), F.min("id").alias("first"), F.min(filled).alias("filled"),
        F.count_if("blank").alias("blank"), F.count("cause").alias("rejected"),
        F.min_by("cause", filled).alias("filled_cause"),
    )
    # One row per part of a file from here on.
    before = Window.partitionBy("file_path").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    known_before = F.count("filled").over(before) > 0
    is_header = F.col("filled").isNotNull() & ~known_before
    parts = saved(
        parts.select(
            "*",
            F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"),
            F.when(is_header, F.col("filled")).alias("header"),
        )
    )
    rejected = (
        marked.where("cause IS NOT NULL")
        .drop("blank")
        .join(parts.select("file_path", "start", "before", "first", "header"), ["file_path", "start"])
        .where("header IS NULL OR id <> header")
        .select("file_path", (F.expr("before + id - first") + 1).alias("line"), "cause", "text")
    )
    wrong = F.sum(F.col("rejected") - F.when(F.expr("header IS NOT NULL AND filled_cause IS NOT NULL"), 1).otherwise(0))
    counts = (
        parts.groupBy("file_path")
        .agg(
            F.sum("lines").alias("lines"), F.count("header").alias("headers"),
            F.sum("blank").alias("blank"), wrong.alias("rejected"),
        )
        .select(
            "file_path", "lines", "headers", "blank",
            F.expr("lines - headers - blank - rejected").alias("accepted"), "rejected",
        )
    )
    return CsvAudit(rejected, counts)


def _cause(schema: T.StructType) -> Column:
    """Why the line `value` does not fit the schema; null if it does."""
    with_bad = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    typed = F.from_csv(
        "value", F.lit(_ddl(with_bad)), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    # With an end mark as the last field, where the mark stands is the number of fields.
    n = len(schema.fields)
    words = F.from_csv(
        F.concat("value", F.lit("," + _END)), F.lit(", ".join(f"w{i} string" for i in range(n + 1))),
        {"mode": "PERMISSIVE"},
    )
    word = [F.coalesce(words[f"w{i}"], F.lit("")) for i in range(n + 1)]
    early, hidden = (
        F.exists(F.array(*word), found)
        for found in (lambda w: w == _END, lambda w: F.endswith(w, F.lit(_END)))
    )
    cause = F.lit("unreadable")
    for i, field in reversed(list(enumerate(schema.fields))):
        lost = (word[i] != "") & typed[field.name].isNull()
        kind = field.dataType.simpleString()
        cause = F.when(lost, F.lit(f"{field.name} is no {kind}")).otherwise(cause)
    return F.when(
        typed[_CORRUPT].isNotNull(),
        F.when(word[n] == _END, cause)
        .when(early, "too few fields")
        .when(hidden, "unreadable")  # inside a quote that is never closed
        .otherwise("too many fields"),
    )


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _declared(
    spark: SparkSession, path: str, schema: T.StructType | str | None
) -> T.StructType:
    """The schema, inferred from all lines where there is none."""
    if schema is None:
        return _csv(spark.read.option("header", True).option("inferSchema", True), path).schema
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _csv(reader, path: str) -> DataFrame:
    try:
        return reader.csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"no file matches {path}") from error
        raise


def csv_to_parquet(
    spark: SparkSession,
    csv_path: str,
    out_path: str,
    schema: T.StructType | str | None = None,
    tolerant: bool = False,
    rows_per_file: int | None = None,
) -> DataFrame:
    """Converts CSV to snappy Parquet, one file per task, and returns the stored table.

    ``rows_per_file`` cuts long files; an existing output folder is replaced.
    """
    read = read_csv_tolerant if tolerant else read_csv
    writer = read(spark, csv_path, schema).write.mode("overwrite").option("compression", "snappy")
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(out_path)
    return spark.read.parquet(out_path)
