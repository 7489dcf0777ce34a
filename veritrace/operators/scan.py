"""Running aggregates and exact percentiles of groups of any size: a hot group is many tasks.

A scan sorts by group and order in ranges, so one group may span many of them; sums within a range
go on from the totals of the group's ranges before it. A percentile is found by selection: bins of
the values between two known ones are counted until few are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritrace.storage import materialize

#: Bins of one round of the selection, and values that are few enough to be sorted.
BINS, FEW = 256, 10_000


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)), F.lit(True))


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], number: str, peers: bool = False) -> DataFrame:
    """rows with their number in their group, from 1 by order, and running sums of columns; a null is added as 0.

    A null group is a group; nulls of the order come last. With peers, rows of equal order all have the
    last one's number and sums, as in SQL's default frame; without, order must be total for a defined
    result. No rows give no rows.
    """
    own, terms = rows.columns, {f"_s{i}": F.coalesce(x, F.lit(0)) for i, x in enumerate(sums.values())}
    along = [F.col(c).asc_nulls_last() for c in order]
    at = rows.withColumns(terms).repartitionByRange(*by, *along).sortWithinPartitions(*by, *along)
    at = materialize(at.withColumn("_place", F.monotonically_increasing_id()), "sorted").withColumn("_range", F.shiftright("_place", 33))
    # a group has a row for each range it spans
    totals = at.groupBy(*by, "_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(c) for c in terms))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    past = {"_n": "_bn"} | {c: f"_b{c}" for c in terms}
    keys = [f"_g{i}" for i in range(len(by))]
    totals = totals.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col("_range").alias("_r"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(p) for c, p in past.items()))
    # rows of equal order are in one range
    here = W.partitionBy(*by, "_range")
    here = here.orderBy(*along).rangeBetween(W.unboundedPreceding, W.currentRow) if peers else here.orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = at.withColumns({"_k": F.count("*").over(here)} | {f"_l{c}": F.sum(c).over(here) for c in terms})
    j = local.join(totals, (F.col("_range") == F.col("_r")) & _same(by, keys))
    return j.select(*own, (F.col("_k") + F.col("_bn")).alias(number), *((F.col(f"_l{c}") + F.col(f"_b{c}")).alias(n) for n, c in zip(sums, terms, strict=True)))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(*by, n, q, percentile): exact percentiles of the values that are not null, linearly interpolated, a row for each share q.

    A rank is sought between two values: their bins are counted, with the least and largest value of
    each, and the bin that holds the rank is gone into, until it is one value or has FEW of them,
    which are sorted. So no task has more than FEW values of a rank, whatever the group.
    """
    v = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    keys = [f"_g{i}" for i in range(len(by))]
    renamed = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    n = v.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    n = n.withColumn("q", F.explode(F.array(*map(F.lit, shares)))).withColumn("at", F.col("q") * (F.col("n") - 1))
    ranks = F.explode(F.array_distinct(F.array(F.floor("at").cast("long"), F.ceil("at").cast("long"))))
    left = n.select(*renamed, "n", "q", "at", ranks.alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), "lo", "hi")
    left, ids = materialize(left, "ranks"), [*keys, "n", "q", "at", "rank"]
    large = (F.col("m") > FEW) & (F.col("lo") < F.col("hi"))
    while not left.where(large).isEmpty():
        # half widths, as the difference of two doubles may be infinite
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bins = v.join(left.where(large), _same(by, keys) & F.col("_v").between(F.col("lo"), F.col("hi")))
        bins = bins.groupBy(*ids, "below", F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin")).agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = W.partitionBy(*ids).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("below", F.col("below") + F.coalesce(F.sum("m").over(before), F.lit(0)))
        held = bins.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("m")))
        left = materialize(left.where(~large).union(held.select(*left.columns)), "ranks")
    few = v.join(left.where("lo < hi"), _same(by, keys) & F.col("_v").between(F.col("lo"), F.col("hi")))
    few = few.withColumn("_k", F.row_number().over(W.partitionBy(*ids).orderBy("_v")) - 1 + F.col("below")).where("_k = rank")
    found = left.where("lo = hi").select(*ids, F.col("lo").alias("_v")).union(few.select(*ids, "_v"))
    low, high = F.min_by("_v", "rank"), F.max_by("_v", "rank")
    weigh = F.when(low == high, low).otherwise((F.ceil("at") - F.col("at")) * low + (F.col("at") - F.floor("at")) * high)
    return found.groupBy(*keys, "n", "q", "at").agg(weigh.alias("percentile")).select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), "n", "q", "percentile")
