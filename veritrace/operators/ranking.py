"""Caps, prefixes, top lists and numbering, each with a final tie-breaker and a partition of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritrace.functions import columns as C
from veritrace.functions import fixed
from veritrace.operators.scan import running


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int | Column, rank: str = "_r") -> DataFrame:
    """The first n rows of each group; n may be a column."""
    out = df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)
    return out.drop(rank) if rank == "_r" else out


def cap_signals(signals: DataFrame, by: str = "doc_id", cap: int = fixed.SIGNALS_A_DOC) -> DataFrame:
    """The cap most severe, then surest signals of each document; at or below the cap all stay."""
    return first_rows(signals, [by], [C.severity_rank("severity").desc(), F.col("confidence_score").desc(), F.col("ord").asc()], cap)


def cap_documents(documents: DataFrame, by: str = "source", order: str = "ord", cap: int = fixed.DOCS_A_SOURCE) -> DataFrame:
    return first_rows(documents, [by], [F.col(order).asc()], cap)


def budget_prefix(rows: DataFrame, by: str, order: str, prior: int | Column = 0) -> DataFrame:
    """What the calls left after prior and reserved ones allow, in order."""
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    return first_rows(rows, [by], [F.col(order).asc()], F.greatest(F.lit(0), F.lit(fixed.MAX_CALLS - fixed.RESERVED_CALLS) - prior))


def newest_by_form(filings: DataFrame, by: str, form: str, order: list[Column], limits: dict[str, int]) -> DataFrame:
    """The newest filings of each form up to the form's limit; other forms go."""
    dim = filings.sparkSession.createDataFrame(list(limits.items()), f"{form} string, most int")
    return first_rows(filings.join(F.broadcast(dim), form), [by, form], order, F.col("most")).drop("most")  # a row for each form asked for


def number_signals(signals: DataFrame, by: str = "run_id") -> DataFrame:
    """signal_num from 1: risks first, then strengths, each in order."""
    positive = (F.col("signal_polarity") == "POSITIVE").cast("int")
    return signals.withColumn("signal_num", F.row_number().over(W.partitionBy(by).orderBy(positive, "ord")))


def by_severity(signals: DataFrame) -> DataFrame:
    return signals.orderBy(C.severity_rank("severity").desc(), F.col("confidence_score").desc(), F.col("ord").asc())


def signals_page(signals: DataFrame, category: str | None = None, severity: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of signals in order; the filters are in any case."""
    out = signals
    if category:
        out = out.where(F.col("risk_category") == category.upper())
    if severity:
        out = out.where(F.col("severity") == severity.upper())
    return out.orderBy("ord").offset(offset).limit(limit)


def ordered_distinct(df: DataFrame, by: list[str], key: str, order: str = "ord") -> DataFrame:
    """The first row of each key."""
    return first_rows(df, [*by, key], [F.col(order).asc()], 1)


def running_max(df: DataFrame, by: str, order: list[str], column: str, out: str) -> DataFrame:
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.max(column).over(w))


def guardrail_trip(calls: DataFrame, by: str, order: list[str], cost: str = "cost_usd", per_usd: int = 1) -> DataFrame:
    """Running calls and cost of each run and whether a limit is met; rows have their cost, per_usd of which are a dollar.

    Costs are added as they are and the sum is turned into dollars, so that rounding does not move the
    limit more than the sum does. Rows of equal order count together; before a first known cost it is null.
    """
    known = F.col(cost).isNotNull().cast("long")
    out = running(calls, [by], order, {"cost": F.col(cost), "_known": known}, "calls", peers=True)
    out = out.withColumn("cost", F.when(F.col("_known") > 0, F.col("cost") / per_usd)).drop("_known")
    return out.withColumn("halted", C.guardrail_exceeded("calls", "cost", F.lit(0.0)))


def last_writes(updates: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """The last value of each key, the last of ties by the order's later columns."""
    return updates.groupBy(*by).agg(F.max_by(column, F.struct(*order)).alias(column))
