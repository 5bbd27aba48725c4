"""JSON documents: configuration, target lists and process lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Targets used when no list can be read.
DEFAULT_TARGETS = ("NVDA", "TSLA", "COIN")


def parse(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """One row a document; a document that is not valid JSON gives nulls."""
    return texts.select(F.from_json(column, schema).alias("d")).select("d.*" if not schema.startswith("array") else "d")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def targets(docs: DataFrame, default=DEFAULT_TARGETS) -> DataFrame:
    """Target symbols of a list document, or the defaults where it is missing or empty."""
    fallback = F.array(*map(F.lit, default))
    one = docs.agg(F.first("targets", ignorenulls=True).alias("t"))
    return one.select(F.explode(F.when(F.size("t") > 0, F.col("t")).otherwise(fallback)).alias("symbol"))


def bots(config: DataFrame) -> DataFrame:
    """One row a bot: name, script, status, strategy, allocation (0 if not given) and the global settings."""
    rows = config.select(F.explode("bots").alias("bot", "b"), F.col("global_settings").alias("g"))
    return rows.select("bot", "b.script", "b.status", "b.strategy", F.coalesce("b.allocation", F.lit(0.0)).alias("allocation"), F.coalesce("g.market_condition", F.lit("normal")).alias("market_condition"), F.coalesce("g.emergency_stop", F.lit(False)).alias("emergency_stop"))


def processes(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a process list in JSON, with their place ``ordinal`` in it; numbers that are missing are 0."""
    p = texts.select(F.posexplode(F.from_json(column, schemas.PROCESS_LIST)).alias("ordinal", "p"))
    zero = lambda c, name: F.coalesce(F.col(f"p.pm2_env.{c}"), F.lit(0)).alias(name)
    return p.select("p.name", F.col("p.pm2_env.status").alias("status"), zero("memory", "memory"), zero("cpu", "cpu"), zero("restart_time", "restarts"), F.col("p.pm2_env.pm_uptime").alias("pm_uptime"), "ordinal")
