"""Sinks: line protocol, CSV export and JSON documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_protocol(df: DataFrame, measurement: str, tags: list[str], fields: list[str]) -> DataFrame:
    """One column ``line``: ``measurement,tag=v,... field=v,...``; strings are quoted, nulls left out.

    A comma, space or equals sign in a tag's value, and a quote or backslash in a string, is written behind a backslash.
    """
    kinds = {f.name: f.dataType for f in df.schema}

    def pair(name: str, quote: bool) -> Column:
        value = F.col(name).cast("string")
        if quote and isinstance(kinds[name], T.StringType):
            value = F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))
        elif not quote:
            value = F.regexp_replace(value, "([ ,=])", r"\\$1")
        return F.concat(F.lit(f"{name}="), value)  # null if the value is

    tag = F.concat_ws(",", F.lit(measurement), *(pair(t, False) for t in tags))
    return df.select(F.concat_ws(" ", tag, F.concat_ws(",", *(pair(f, True) for f in fields))).alias("line"))


def write_lines(df: DataFrame, path: str, measurement: str, tags: list[str], fields: list[str], mode: str = "append") -> None:
    line_protocol(df, measurement, tags, fields).write.mode(mode).text(path)


def write_dated(df: DataFrame, path: str, time: str = "time", unit: str = "day", mode: str = "append") -> None:
    """Appends to a log laid out by day (week, month, ...): ``path/period=<its first day>``.

    Rows of a period are brought together, so that it is a file or, if large, a few.
    """
    df.withColumn("period", F.to_date(F.date_trunc(unit, time))).hint("rebalance", "period").write.partitionBy("period").mode(mode).parquet(path)


def known_first(df: DataFrame, known=("time", "symbol", "action", "price", "qty", "bot_type")) -> DataFrame:
    """Known columns in their order, then all others."""
    return df.select(*known, *(c for c in df.columns if c not in known))


def export_csv(df: DataFrame, path: str, order: str = "time", mode: str = "overwrite") -> None:
    """CSV with a header, newest rows first."""
    df.orderBy(F.desc(order)).write.mode(mode).option("header", True).csv(path)


def dated(prefix: str, day: Column) -> Column:
    """File name of a daily export."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(day, "yyyyMMdd"), F.lit(".csv"))


def export_daily(df: DataFrame, folder: str, prefix: str, order: str = "time") -> str:
    """Exports ``df`` under today's name; gives the path."""
    name = df.sparkSession.range(1).select(dated(prefix, F.current_date())).first()[0]
    export_csv(df, f"{folder}/{name}", order)
    return f"{folder}/{name}"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidewater-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_json(df: DataFrame, path: str) -> None:
    """Replaces a JSON document."""
    df.write.mode("overwrite").json(path)


def target_document(symbols: DataFrame, updated: Column) -> DataFrame:
    return symbols.agg(F.sort_array(F.collect_set("symbol")).alias("targets")).withColumn("updated", updated.cast("string"))
