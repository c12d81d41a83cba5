"""Exact order statistics and running maxima of groups of any size, without a group in one task.

``at_ranks`` narrows an interval of values around each wanted rank: a round counts the values of every open interval in
BUCKETS equal parts (counts, least and greatest value add up before the shuffle), takes the part that holds the rank, and
goes on inside its own least and greatest value, until these are equal. A round costs one scan of two columns, and moves at
most BUCKETS rows for each interval and task.

``running_max`` cuts the rows, in the order of key and time, into ranges of equal size; a range knows the running maximum
inside it, and the maxima of all ranges before it, within the key, are carried in. A key that has half of all rows is
only more ranges.

Edge cases: null and NaN values have no rank; an empty group has no row; ranks below 0 and above the last are the first
and the last; a null group is a group; rows of a null key are carried among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.storage import SMALL_ROWS, written

BUCKETS = 256


def _inside(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows with the intervals of their group; the open intervals are small unless there are very many groups."""
    small = open_.count() <= SMALL_ROWS
    return rows.join(F.broadcast(open_) if small else open_, rows["g"].eqNullSafe(open_["of"])).where(F.col("v").between(F.col("lo"), F.col("hi"))).drop("of")


def at_ranks(rows: DataFrame, group: Column, value: Column, ranks: dict[str, Column]) -> DataFrame:
    """g, n and a column for each wanted rank (from 0, an expression over n) of each group's sorted values."""
    rows = rows.select(group.alias("g"), value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = written(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.greatest(rank.cast("long"), F.lit(0)), F.col("n") - 1).alias("k")) for name, rank in ranks.items())))
    state = written(sizes.withColumn("x", wanted).select("g", "x.name", "x.k", "lo", "hi"), "ranks")
    done = None
    while True:
        closed = state.where("lo = hi").select("g", "name", F.col("lo").alias("value"))
        done = closed if done is None else done.unionByName(closed)
        open_ = state.where("lo < hi").withColumnRenamed("g", "of")
        if open_.isEmpty():
            break
        # an interval may be wider than the greatest double
        wide = F.col("hi") - F.col("lo")
        part = F.when(wide == float("inf"), (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise((F.col("v") - F.col("lo")) / wide)
        inside = _inside(rows, open_).withColumn("bucket", F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)))
        counts = inside.groupBy("g", "name", "k", "bucket").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("c").over(Window.partitionBy("g", "name").orderBy("bucket")) - F.col("c")  # at most BUCKETS rows
        placed = counts.withColumn("before", before).where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("c")))
        state = written(placed.select("g", "name", (F.col("k") - F.col("before")).alias("k"), "lo", "hi"), "ranks")
    values = done.groupBy("g").agg(*(F.max(F.when(F.col("name") == x, F.col("value"))).alias(x) for x in ranks))
    return sizes.select(F.col("g").alias("of"), "n").join(values, F.col("of").eqNullSafe(F.col("g"))).drop("of")


def nearest(percent: int) -> Column:
    """Rank at ceil(n * percent / 100), in whole numbers."""
    return F.expr(f"(n * {percent} + 99) div 100 - 1")


def percentiles(rows: DataFrame, group: str, value: str, kinds: dict[str, tuple[str, int]]) -> DataFrame:
    """group, n and the named percentiles: ``nearest`` rank, ``floor`` of (n - 1) * percent, or ``linear`` between neighbours."""
    ranks: dict[str, Column] = {}
    for name, (kind, percent) in kinds.items():
        low = F.expr(f"((n - 1) * {percent}) div 100")
        ranks |= {f"{name}_lo": low, f"{name}_hi": F.expr(f"((n - 1) * {percent} + 99) div 100")} if kind == "linear" else {name: low if kind == "floor" else nearest(percent)}
    found = at_ranks(rows, F.col(group), F.col(value), ranks)

    def column(name: str) -> Column:
        kind, percent = kinds[name]
        if kind != "linear":
            return F.col(name)
        return F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (F.expr(f"((n - 1) * {percent}) % 100") / 100)

    return found.select(F.col("g").alias(group), "n", *(column(x).alias(x) for x in kinds))


def running_max(rows: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Rows with the greatest ``value`` so far in the order of their key. ``order`` tells all rows of a key apart."""
    place = [F.col(key), *order]
    ranges = written(rows.repartitionByRange(*place).withColumn("__range", F.spark_partition_id()), "ranges")
    own = ranges.groupBy(key, "__range").agg(F.max(value).alias("own"))
    # a row for each range that a key meets
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(F.col(key).alias("__key"), F.col("__range").alias("__of"), F.max("own").over(earlier).alias("__carried")).where("__carried is not null")
    inside = Window.partitionBy(key, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranges.withColumn("__local", F.max(value).over(inside))
    joined = local.join(carried, local[key].eqNullSafe(carried["__key"]) & (local["__range"] == carried["__of"]), "left")
    return joined.withColumn(name, F.greatest("__local", "__carried")).drop("__range", "__key", "__of", "__local", "__carried")
