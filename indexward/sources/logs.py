"""Event logs: one JSON object per line, or ``[time] [LEVEL] message`` text records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import log_timestamp
from ..schemas import LOG_EVENT_SCHEMA

# Layout of a text line and of its timestamp.
TEXT_LINE = r"(?s)\A\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\] \[([A-Z]+)\] (.*)\z"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


def _parse_time(text):
    """UTC text to a timestamp; null when it does not parse."""
    return F.from_utc_timestamp(F.try_to_timestamp(text, F.lit(TIME_FORMAT)), F.current_timezone())


def read_log_json(spark: SparkSession, path: str) -> DataFrame:
    """Structured events. A line that is not JSON is kept whole in ``corrupt_record``."""
    schema = T.StructType([*LOG_EVENT_SCHEMA.fields, T.StructField("corrupt_record", T.StringType(), True)])
    raw = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt_record")
    return raw.withColumn("timestamp", _parse_time(F.col("timestamp")))


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Columns ``timestamp, level, message, raw``. A line of another form keeps only ``raw``."""
    part = [F.regexp_extract(column, TEXT_LINE, i) for i in (1, 2, 3)]
    known = F.col(column).rlike(TEXT_LINE)
    return lines.select(
        F.when(known, _parse_time(part[0])).alias("timestamp"),
        F.when(known, part[1]).alias("level"),
        F.when(known, part[2]).alias("message"),
        F.col(column).alias("raw"),
    )


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """Events from text logs. A message may have line breaks: a record ends where a line begins with ``[``.

    Records are cut by the reader itself, also across the borders of its splits, so no line has to look for the one before.
    A line break at the very end of a message is taken for that of the file. Lines before the first record of a file, and
    what follows a line break and a ``[`` that begins no record, keep their raw
    text only.
    """
    text = F.regexp_replace("value", r"\r?\n\z", "")
    # The separator takes the bracket of every record but the first of a file.
    whole = F.concat(F.lit("["), text)
    return parse_log_lines(spark.read.text(path, lineSep="\n[").select(F.when(whole.rlike(TEXT_LINE), whole).otherwise(text).alias("value")))


def _event_fields(df: DataFrame):
    fields = []
    for field in LOG_EVENT_SCHEMA.fields:
        if field.name == "timestamp":
            fields.append(log_timestamp(F.col("timestamp")).alias("timestamp"))
        elif field.name in df.columns:
            fields.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return fields


def to_log_json(df: DataFrame) -> DataFrame:
    """One JSON text ``value`` per event; absent fields are left out."""
    return df.select(F.to_json(F.struct(*_event_fields(df))).alias("value"))


def to_log_text(df: DataFrame) -> DataFrame:
    """One text record ``value`` per event; line breaks in messages stay."""
    line = F.format_string("[%s] [%s] %s", log_timestamp(F.col("timestamp")), F.col("level"), F.col("message"))
    return df.select(line.alias("value"))
