"""Desired against actual state of a fleet of processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def reconcile(config_bots: DataFrame, processes: DataFrame) -> DataFrame:
    """``(bot, desired, actual, command)``: launch, restart, stop or nothing; a process that is not listed is missing.

    Of processes of one name the last in the list (by ``ordinal``) counts.
    """
    actual = processes.groupBy(F.col("name").alias("bot")).agg(F.max_by("status", "ordinal").alias("actual"))
    rows = config_bots.select("bot", F.col("status").alias("desired")).join(actual, "bot", "left").withColumn("actual", F.coalesce("actual", F.lit("missing")))
    active, paused = F.col("desired") == "active", F.col("desired") == "paused"
    command = F.when(active & (F.col("actual") == "missing"), "start").when(active & F.col("actual").isin("stopped", "errored"), "restart").when(paused & (F.col("actual") == "online"), "stop")
    return rows.withColumn("command", command)


def emergency_stop(processes: DataFrame, keep: str = "supervisor") -> DataFrame:
    """Processes to stop: all that are online but the one that stops them."""
    return processes.where((F.col("status") == "online") & (F.col("name") != keep)).select(F.col("name").alias("bot"), F.lit("stop").alias("command"))


def process_metrics(processes: DataFrame, now_ms: Column, host: str) -> DataFrame:
    online = F.col("status") == "online"
    uptime = F.when(online, now_ms - F.coalesce("pm_uptime", now_ms)).otherwise(0).cast("bigint")
    return processes.select(F.lit(host).alias("host"), F.col("name").alias("bot"), F.when(online, 1).otherwise(0).alias("status_code"), "memory", "cpu", "restarts", uptime.alias("uptime"))


def playbook(spark, plays=rules.PLAYBOOK) -> DataFrame:
    return spark.createDataFrame([(r, b, s) for r, bots in plays.items() for b, s in bots.items()], "regime string, bot string, desired string")


def playbook_diff(regimes: DataFrame, config_bots: DataFrame, plays=rules.PLAYBOOK) -> DataFrame:
    """Bots of the configuration whose status the regime's playbook changes: ``(regime, bot, status, desired)``."""
    wanted = F.broadcast(playbook(regimes.sparkSession, plays))
    return regimes.select("regime").distinct().join(wanted, "regime").join(config_bots.select("bot", "status"), "bot").where("status <> desired").select("regime", "bot", "status", "desired")
