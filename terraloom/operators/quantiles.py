"""Exact quantiles of many groups at once, without holding a group's values anywhere.

Every wanted rank of every group starts from the range of the group's values. A pass counts the values of each range in BUCKETS
equal parts (counts are added up before they are shuffled) and narrows the range to the least and the greatest value of the part
that holds the rank. As both ends of a range are values that occur and fall into different parts, every pass makes it
smaller. When at most HELD values are left in a range, or only one distinct value, they are sorted and the rank is read off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.sources.staging import stage

#: Parts of a range in one pass; and how many values of a range may be sorted in one place.
BUCKETS, HELD = 1024, 10_000


def _place(value: Column) -> Column:
    """A number that grows with the value, by its sign and its power of two."""
    return F.when(value == 0, 0.0).otherwise(F.signum(value) * (F.log2(F.abs(value)) + 1100))


def _part(value: Column, low: Column, high: Column) -> Column:
    """The part of a range (low < high) in which a value lies: low in the first, high in the last.

    Ranges that hold zero or spread over more than two powers of two are cut by powers, the others evenly. So a range is down
    to two powers after two or three passes, and to a single value after six more.
    """
    spread = (low <= 0) & (high >= 0) | (F.greatest(F.abs(low), F.abs(high)) / 4 > F.least(F.abs(low), F.abs(high)))
    by = lambda f: (f(value) - f(low)) / F.nullif(f(high) - f(low), F.lit(0.0))
    share = F.when(spread, by(_place)).otherwise(by(lambda v: v))
    return F.when(value == high, BUCKETS - 1).otherwise(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).cast("int")


def exact_quantiles(values: DataFrame, keys: list[str], value: str, shares: list[float], held: int = HELD) -> DataFrame:
    """keys, q (an array of doubles): of each group the quantiles at shares from 0 to 1, between two values by straight line.

    Null values don't count; groups without others are left out. Values must be finite. values is read once for each pass.
    """
    given = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    size = given.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    places = F.array(*((F.col("__n") - 1) * F.lit(float(p)) for p in shares))
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda at: F.array(F.floor(at), F.ceil(at)))))
    sizes = stage(size.withColumn("__places", places))
    todo = sizes.select(*keys, F.explode(ranks).alias("__rank"), F.lit(0).cast("long").alias("__below"), "__n", "__low", "__high")
    done = []
    while True:
        todo = stage(todo)
        wide = (F.col("__n") > held) & (F.col("__low") < F.col("__high"))
        done.append(todo.where(~wide))
        todo = todo.where(wide)
        if todo.isEmpty():
            break
        ranges = todo.select(*keys, "__low", "__high").distinct()
        range_ = [*keys, "__low", "__high"]
        inside = given.join(ranges, keys).where(F.col("__v").between(F.col("__low"), F.col("__high")))
        counted = inside.groupBy(*range_, _part(F.col("__v"), F.col("__low"), F.col("__high")).alias("__part")).agg(F.count("*").alias("__count"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))
        before = F.sum("__count").over(Window.partitionBy(*range_).orderBy("__part")) - F.col("__count")
        parts = counted.withColumn("__before", before)
        own = F.col("__rank") - F.col("__below")
        held_by = todo.drop("__n").join(parts, range_).where((own >= F.col("__before")) & (own < F.col("__before") + F.col("__count")))
        todo = held_by.select(*keys, "__rank", (F.col("__below") + F.col("__before")).alias("__below"), F.col("__count").alias("__n"), F.col("__from").alias("__low"), F.col("__to").alias("__high"))
    left = reduce(DataFrame.unionByName, done)
    single = left.where(F.col("__low") == F.col("__high")).select(*keys, "__rank", F.col("__low").alias("__value"))
    several = left.where(F.col("__low") < F.col("__high"))
    near = given.join(several.select(*keys, "__low", "__high", "__below").distinct(), keys).where(F.col("__v").between(F.col("__low"), F.col("__high")))
    sorted_ = near.groupBy(*keys, "__low", "__high", "__below").agg(F.sort_array(F.collect_list("__v")).alias("__all"))  # held values at most
    read = several.join(sorted_, [*keys, "__low", "__high", "__below"]).select(*keys, "__rank", F.get("__all", (F.col("__rank") - F.col("__below")).cast("int")).alias("__value"))
    found = single.unionByName(read).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__at"))

    def between(place: Column) -> Column:
        low, high = F.floor(place), F.ceil(place)
        near_, far = F.col("__at")[low], F.col("__at")[high]
        return F.when(low == high, near_).otherwise((high - place) * near_ + (place - low) * far)

    return sizes.select(*keys, "__places").join(found, keys).select(*keys, F.transform("__places", between).alias("q"))
