"""Running statistics strictly before a moment, and the latest earlier row: as-of joins in one or two shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the stretches of time into which a key's history is cut, in the unit of the time column.
WIDTH = 86_400_000_000


def running_before(events: DataFrame, probes: DataFrame, keys: list[str], time: str, flags: dict[str, str], last: dict[str, str] | None = None, width: int = WIDTH) -> DataFrame:
    """For each probe, how many events of its key came strictly earlier.

    ``flags`` names a boolean event column for each count to make, ``last`` for each latest time.
    A key's rows are cut into stretches of time, so that no task gets a whole key: within a stretch
    a window counts, and what came in earlier stretches is added from their totals, which are few.
    """
    last = last or {}
    stretch = F.floor(F.col(time) / width).cast("long")
    own = [c for c in probes.columns if c not in (*keys, time)]
    side = probes.select(*keys, time, F.struct(*own, F.lit(1).alias("__is")).alias("__row"))
    every = events.select(*keys, time, *{*flags.values(), *last.values()}).unionByName(side, allowMissingColumns=True).withColumn("__stretch", stretch)
    inside = Window.partitionBy(*keys, "__stretch").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    mark = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    every = every.withColumns({f"__c_{n}": F.coalesce(F.sum(mark(c)).over(inside), F.lit(0)) for n, c in flags.items()} | {f"__l_{n}": F.max(F.when(F.col(c), F.col(time))).over(inside) for n, c in last.items()})
    totals = events.withColumn("__stretch", stretch).groupBy(*keys, "__stretch").agg(*(F.sum(mark(c)).alias(f"__t_{n}") for n, c in flags.items()), *(F.max(F.when(F.col(c), F.col(time))).alias(f"__m_{n}") for n, c in last.items()))
    at = probes.select(*keys, stretch.alias("__stretch")).distinct()
    both = at.join(totals, [*keys, "__stretch"], "full")
    before = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = both.select(*keys, "__stretch", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in flags), *(F.max(f"__m_{n}").over(before).alias(f"__m_{n}") for n in last))
    found = every.where("__row.__is = 1").join(earlier, [*keys, "__stretch"], "left")
    return found.select(
        *keys,
        time,
        *(F.col(f"__row.{c}").alias(c) for c in own),
        *((F.col(f"__c_{n}") + F.coalesce(f"__t_{n}", F.lit(0))).alias(n) for n in flags),
        *(F.greatest(f"__l_{n}", f"__m_{n}").alias(n) for n in last),
    )


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """For each row of ``left``, ``value`` of the latest row of ``right`` with the same keys strictly earlier; null if none.

    Of several right rows at that time, the least value. As in ``running_before``, a key's rows are cut
    into stretches of time: a window looks back within a stretch, and what it doesn't find comes from
    the last row of the stretches before.
    """
    own = [c for c in left.columns if c not in (*keys, time)]
    stretch = F.floor(F.col(time) / width).cast("long").alias("__stretch")
    a = left.select(*keys, time, F.struct(*own, F.lit(1).alias("__is")).alias("__row"), stretch)
    # at most one row for each key and time
    b = right.groupBy(*keys, time).agg(F.min(value).alias("__value"))
    b = b.select(*keys, time, F.struct(F.col(time).alias("__t"), F.col("__value").alias("__v")).alias("__hit"), stretch)
    inside = Window.partitionBy(*keys, "__stretch").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    every = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.max("__hit").over(inside)).where("__row.__is = 1")
    ends = a.select(*keys, "__stretch").distinct().join(b.groupBy(*keys, "__stretch").agg(F.max("__hit").alias("__end")), [*keys, "__stretch"], "full")
    before = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__stretch", F.max("__end").over(before).alias("__before"))
    found = every.join(ends, [*keys, "__stretch"], "left").withColumn("__last", F.coalesce("__last", "__before"))
    return found.select(*keys, time, *(F.col(f"__row.{c}").alias(c) for c in own), F.col("__last.__v").alias(out), F.col("__last.__t").alias(f"{out}_at"))
