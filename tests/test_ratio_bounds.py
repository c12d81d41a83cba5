"""Bounds of resampled medians against a plain version; draws stay in the tasks that make them."""

import hashlib
import math
import statistics

from pyspark.sql import functions as F

from tidewater.operators import metrics


def plain(rows, resamples, seed):
    for group in {g for g, _, _ in rows}:
        r = [x for g, _, x in sorted(rows, key=lambda y: y[1]) if g == group and x is not None]
        if r:
            draw = lambda s, n: r[int(hashlib.md5(f"{seed}:{s}:{n}".encode()).hexdigest()[:8], 16) % len(r)]
            m = sorted(statistics.median(draw(s, n + 1) for n in range(len(r))) for s in range(resamples))
            yield group, len(r), statistics.median(r), *((m[math.ceil(p * resamples) - 1] for p in (0.025, 0.975)) if len(r) >= 3 else (None, None))


def test_ratio_bounds(spark):
    rows = [(g, k, None if k % 9 == 4 else float((k * 37 + g) % 101) / (g + 1)) for g, n in ((0, 400), (1, 2), (2, 3), (3, 30), (4, 1)) for k in range(n)]
    found = metrics.ratio_bounds(spark.createDataFrame(rows, "bench int, trial int, ratio double"), "bench", "trial", "ratio", resamples=37, seed=5)
    assert sorted(map(tuple, found.collect()), key=lambda x: x[0]) == sorted(plain(rows, 37, 5), key=lambda x: x[0])


def test_draws_are_spread_and_not_shuffled(spark):
    few = spark.range(3000).select((F.col("id") % 2).alias("bench"), F.col("id").alias("trial"), F.rand(1).alias("ratio"))
    found = metrics.ratio_bounds(few, "bench", "trial", "ratio", resamples=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "draw" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
