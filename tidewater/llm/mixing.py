"""Mixing sources to target weights, in DataFrame operations alone.

A first pass counts each document's words and sums them by source. Sources, in the order of their code points with null
last, take the weights in turn and share all words by them; a source stops at ``most`` times its own words, and what it
leaves is shared by the others' weights until none is above. target / source size is the source's repetition rate: each of
its documents is taken floor(rate) times, and once more if its own number, hashed from its id and the source's seed, is
below the rate's fraction. Of SEEDS seeds a source takes the one whose words come nearest to its target; the candidates'
sums are made in one aggregation over (source, words), never by gathering a source.

A source's sums are pre-aggregated before the shuffle, and rates go to the documents by a broadcast where the sources are
few enough and by a join that adaptive execution splits otherwise, so one hot source is no single task's work. Sources are
numbered in ranges, so any number of them passes.

Edge cases: a null or empty text has no words and is taken none or more times at no cost; a source without words has the
target 0; a null source is a source of its own, last; a null doc_id draws like any id; rows that repeat a doc_id draw
alike; an empty table gives an empty result; other columns are ignored by ``shares`` and kept by ``emitted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.store import BROADCAST_ROWS, written

WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its words.
MOST = 3
SEEDS = 16
_WORDS = r"[^\x20\x09-\x0D]+"
_FRACTION = 2.0**-53


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: Column) -> Column:
    """A number in [0, 1) of 53 bits, hashed from an id and a seed."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, seed), 11).cast("double") * _FRACTION


def numbered(sources: DataFrame) -> DataFrame:
    """Place of each source (from 0) by code point, null last: ranges are sorted alone and begin after those before them."""
    order = [F.col("source").isNull(), F.col("source")]
    ranges = written(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "source-ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranges.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("place", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) with target: the level that fills all words, sources at their limit left out.

    Each round is a sum of two numbers; the level only rises, so it ends with the last source that meets its limit.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    found = written(numbered(sources).withColumn("weight", weight), "sources")
    limit = most * F.col("source_size").cast("double")
    level, total = 0.0, found.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("weight") * level >= limit
        gone, left = found.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if not left:
            break
        rise = (total - (gone or 0.0)) / left
        if rise <= level:
            break
        level = rise
    return found.select("source", "source_size", F.least(F.col("weight") * level, limit).alias("target"))


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def copies(doc_id: Column, rate: Column, seed: Column) -> Column:
    return (F.floor(rate) + (uniform(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with what their source has; a null source meets the null one."""
    own = sources.select(F.col("source").alias("__of"), *[x for x in sources.columns if x != "source"])
    small = sources.count() <= BROADCAST_ROWS
    at = (F.coalesce(rows["source"], F.lit("")) == F.coalesce(own["__of"], F.lit(""))) & (rows["source"].isNull() == own["__of"].isNull())
    return rows.join(F.broadcast(own) if small else own.hint("merge"), at).drop("__of")


def rates(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, sizes: DataFrame | None = None) -> DataFrame:
    """(source, source_size, target, rate, seed) of each source of ``docs`` (doc_id, text, source)."""
    sizes = measured(docs) if sizes is None else sizes
    sources = written(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumn("rate", _rate()), "targets")
    drawn = _with_sources(sizes.where("size > 0"), sources)
    sums = [F.sum(F.col("size") * copies(F.col("doc_id"), F.col("rate"), F.lit(s))).cast("double").alias(f"taken{s}") for s in range(SEEDS)]
    tried = drawn.groupBy("source", "target").agg(*sums)
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"taken{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS))))["seed"]
    tried = tried.select("source", nearest.alias("seed"))
    return written(_with_sources(sources, tried).unionByName(sources.where("source_size = 0").withColumn("seed", F.lit(0))), "rates")


def measured(docs: DataFrame) -> DataFrame:
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")), "sizes")


def shares(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken (words), copies, source, rate."""
    sizes = measured(docs)
    found = _with_sources(sizes, rates(docs, weights, most, sizes)).withColumn("copies", copies(F.col("doc_id"), F.col("rate"), F.col("seed")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source", "rate")


def emitted(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """The mixed corpus itself: the rows of ``docs``, each as often as it is taken, with their own columns."""
    found = rates(docs, weights, most).select(F.col("source").alias("__of"), F.col("rate").alias("__rate"), F.col("seed").alias("__seed"))
    names = {x: f"c{i}" for i, x in enumerate(docs.columns)}  # by number meanwhile, so that none of their names clashes
    joined = _with_sources(docs.toDF(*names.values()).withColumn("source", F.col(names["source"]).cast("string")), found.withColumnRenamed("__of", "source"))
    times = copies(F.col(names["doc_id"]).cast("long"), F.col("__rate"), F.col("__seed")).cast("int")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))).select(*(F.col(c).alias(x) for x, c in names.items()))
