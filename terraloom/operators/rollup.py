"""Statistics as states that merge: kept for each area, rolled up to regions without going back to the pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = ("n", "sum", "m2", "min", "max")


def states(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, sum, m2 (squared deviations from the mean, added up), min, max of each group's values; nulls don't count."""
    v = F.col(value).cast("double")
    return values.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("sum"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def merged(found: DataFrame, keys: list[str]) -> DataFrame:
    """The states of larger groups. Deviations are moved to the common mean, so that nothing cancels out."""
    means = found.groupBy(*keys).agg((F.sum("sum") / F.sum("n")).alias("__mean"))
    same = found.withColumn("__one", F.lit(1)).join(means.withColumn("__one", F.lit(1)), [*keys, "__one"])
    off = F.col("sum") / F.col("n") - F.col("__mean")
    return same.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max")
    )


def statistics(found: DataFrame) -> DataFrame:
    """mean, min, max, std (of the population) in place of the states."""
    rest = [c for c in found.columns if c not in STATE]
    return found.select(*rest, "n", (F.col("sum") / F.col("n")).alias("mean"), "min", "max", F.sqrt(F.col("m2") / F.col("n")).alias("std"))


def rollup(found: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of every group by keys, by keys but the last, and so on to all together; keys that were left out are null.

    Each level is merged from the one below it, so the finest states are read once. Groups without values have no row, not even all
    together.
    """
    out, level = None, merged(found, keys)
    for k in range(len(keys), -1, -1):
        if k < len(keys):
            level = merged(level, keys[:k])
        blank = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in keys[k:]]
        rows = statistics(level.where(F.col("n") > 0)).select(*keys[:k], *blank, F.lit(k).alias("level"), "n", "mean", "min", "max", "std")
        out = rows if out is None else out.unionByName(rows)
    return out
