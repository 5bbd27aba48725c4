"""Joins by prefix and by nearest value, as equality joins and one ordered pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_join(rows: DataFrame, listed: DataFrame, column: str, prefix: str) -> DataFrame:
    """Every row with every entry of ``listed`` whose ``prefix`` its ``column`` begins with.

    A row is dealt out under its prefixes of the lengths that occur in the list, a handful, and meets the list by
    equality: a list of any size joins by hash or by sorting, never row against row. Null or empty prefixes match
    nothing. The columns of ``listed`` must have names of their own.
    """
    entries = listed.where(F.char_length(prefix) > 0)
    lengths = entries.agg(F.array_sort(F.collect_set(F.char_length(prefix)))).scalar()
    dealt = rows.withColumn("_length", F.explode(lengths)).where(F.col("_length") <= F.char_length(column)).withColumn("_prefix", F.left(F.col(column), F.col("_length")))
    return dealt.join(entries, F.col("_prefix") == F.col(prefix)).drop("_prefix", "_length")


def nearest(values: DataFrame, targets: DataFrame, keys: list[str], value: str, target: str, tie: list[str], score=None) -> DataFrame:
    """Every row of ``targets`` with the row of ``values`` of the same ``keys`` that is nearest to its ``target``, as ``best``; targets without any are left out.

    Values and targets are ordered together once; the value before a target and the one after it, each the least by
    ``tie`` among equal values, are all that is scored. ``score(value, target)`` is the distance, which must grow
    on either side; ties go to the least of ``tie``.
    """
    score = score or (lambda v, t: F.abs(v - t))
    # one row a value
    held = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_at")).agg(F.min(F.struct(*tie)).alias("_tie"))
    rows = held.select(*keys, "_at", F.lit(0).alias("_kind"), F.struct(F.col("_at").alias("value"), F.col("_tie").alias("tie")).alias("_value"))
    wanted = targets.where(F.col(target).isNotNull())
    asked = wanted.select(*keys, F.col(target).cast(held.schema["_at"].dataType).alias("_at"), F.lit(1).alias("_kind"), F.struct(*wanted.columns).alias("_target"))
    both = rows.unionByName(asked, allowMissingColumns=True)
    names = ", ".join(f"`{k}`" for k in keys)
    # a target comes after values that equal it
    beside = lambda f: F.expr(f"{f}(_value) IGNORE NULLS OVER (PARTITION BY {names} ORDER BY _at, _kind)")
    near = both.withColumns({"_before": beside("lag"), "_after": beside("lead")}).where("_kind = 1")
    scored = lambda c: F.when(F.col(c).isNotNull(), F.struct(score(F.col(f"{c}.value"), F.col(f"_target.`{target}`")).alias("score"), F.col(f"{c}.tie").alias("tie"), F.col(f"{c}.value").alias("value")))
    best = F.array_min(F.array_compact(F.array(scored("_before"), scored("_after"))))
    return near.select("_target.*", best.alias("best")).where("best is not null")
