"""Comparing a table's rows with another's, block by block, without a cross join or a hot group.

Both sides are dealt by hash into blocks of a bounded number of rows; every two blocks that may hold
partners meet once, in a task of their own, where numpy compares them. The number of blocks follows
from the tables' sizes, or each group's, so more rows are more tasks, not larger ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.storage import materialize

#: Rows of a block.
BLOCK = 2_000
#: Rows of a table of groups, narrow rows, that may be broadcast.
FEW = 100_000


def _fresh(df: DataFrame) -> DataFrame:
    """Columns of their own, so that two sides from one table are not taken for one another."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def meet(left: DataFrame, right: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """The rows that compare(left rows, right rows) gives for every two blocks of equal `by`; empty sides meet nothing."""
    number = lambda c: (1 + F.floor((c - 1) / block)).cast("int")
    if by:  # a group's blocks follow from its own rows on either side; groups that one side lacks, or null, meet nothing
        sizes = left.groupBy(*by).agg(number(F.count("*")).alias("_m")).join(right.groupBy(*by).agg(number(F.count("*")).alias("_n")), [*by])
        sizes = materialize(sizes, "sizes")
        few = F.broadcast(sizes) if sizes.count() <= FEW else sizes
        x, y = left.join(few, [*by]), _fresh(right.join(few, [*by]))
    else:
        m, n = (1 + df.count() // block for df in (left, right))
        x, y = (df.withColumns({"_m": F.lit(m).cast("int"), "_n": F.lit(n).cast("int")}) for df in (left, _fresh(right)))
    x = x.withColumn("_i", F.pmod(F.xxhash64(*left.columns), "_m").cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    y = y.withColumn("_j", F.pmod(F.xxhash64(*right.columns), "_n").cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return compare(a, b)[names] if len(a) and len(b) else pd.DataFrame(columns=names)

    names = [x.split()[0] for x in schema.split(", ")]
    keys = [*by, "_i", "_j"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(run, schema)


def meet_within(rows: DataFrame, compare: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str, by: tuple[str, ...], blocks: Column) -> DataFrame:
    """The rows that compare gives for every two blocks of a group, once for the two, and for each block alone (block, None).

    blocks is an aggregate: how many blocks a group has. Null groups meet nothing.
    """
    sizes = materialize(rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(blocks)).cast("int").alias("_m")), "sizes")
    few = F.broadcast(sizes) if sizes.count() <= FEW else sizes
    x = rows.join(few, [*by]).withColumn("_b", F.pmod(F.xxhash64(*rows.columns), "_m").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    x = x.select(*rows.columns, "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def run(t: pa.Table) -> pa.Table:
        i, j = t["_i"][0], t["_j"][0]
        return compare(t, None) if i == j else compare(t.filter(pc.equal(t["_b"], i)), t.filter(pc.equal(t["_b"], j)))

    return x.groupBy(*by, "_i", "_j").applyInArrow(run, schema)


def vectors(column: pd.Series) -> np.ndarray:
    """Rows of equal length in double precision."""
    return np.stack([np.asarray(x, np.float64) for x in column])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero, so its cosine with any is 0."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)
