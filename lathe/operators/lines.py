"""Documents as ordered lines; islands, forward fills and as-of look-ups over them.

All windows are partitioned by document_id (and more), so one exchange on document_id serves a whole pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lathe.functions.text import strip


def doc_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """document_id, line_no (from 0), line."""
    return docs.select("document_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def by_line(*more: str):
    return W.partitionBy("document_id", *more).orderBy("line_no")


def is_table_row(line: Column | str) -> Column:
    """PRD1: stripped, begins and ends with a bar, and more than a lone bar."""
    return strip(line).rlike(r"(?s)^\|.*\|$")


def is_separator_row(line: Column | str) -> Column:
    """PRD2: every cell is dashes with optional colons."""
    return strip(line).rlike(r"^\|(?:\s*:?-+:?\s*\|)+$")


def islands(lines: DataFrame, flag: Column, name: str = "island") -> DataFrame:
    """Adds the number of the run of consecutive lines with the flag that a line belongs to (null without the flag)."""
    marked = lines.withColumn("__flag", flag)
    run = F.col("line_no") - F.row_number().over(by_line("__flag"))
    return marked.withColumn(name, F.when(F.col("__flag"), run)).drop("__flag")


def next_where(flag: Column) -> Column:
    """JOIN4: the line_no of the first later line with the flag."""
    return F.first(F.when(flag, F.col("line_no")), ignorenulls=True).over(by_line().rowsBetween(1, W.unboundedFollowing))


def last_where(flag: Column, value: Column) -> Column:
    """Forward fill: value at the latest line so far with the flag."""
    return F.last(F.when(flag, value), ignorenulls=True).over(by_line().rowsBetween(W.unboundedPreceding, 0))


def ordered(value: Column | str, order: Column | str = "line_no") -> Column:
    """Aggregate: array of values in the given order, whatever the exchange did."""
    value = F.col(value) if isinstance(value, str) else value
    order = F.col(order) if isinstance(order, str) else order
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def started(lines: DataFrame, is_start: Column, order: list[str]) -> DataFrame:
    """SRC4b: keeps lines from the first with is_start on."""
    seen = F.max(is_start.cast("int")).over(W.partitionBy("document_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("__on", seen).where("__on = 1").drop("__on")
