"""Intervals over time: months, years, equal parts, sliding windows, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag.functions import dates
from postbag.sinks.shared import written


def per_interval(messages: DataFrame, grain: str = "month") -> DataFrame:
    """(start, end, n) for each month or year from the first message to the last, empty
    ones included; the first begins with the first message."""
    ok = messages.where(dates.is_valid(F.col("date")))
    span = ok.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    step = {"month": "interval 1 month", "year": "interval 1 year"}[grain]
    grid = span.where("a is not null").select("a", F.explode(F.expr(f"sequence(date_trunc('{grain}', a), date_trunc('{grain}', b), {step})")).alias("p"))
    n = ok.groupBy(F.date_trunc(grain, "date").alias("p")).agg(F.countDistinct("doc_id").alias("n"))
    return grid.join(n, "p", "left").select(F.greatest("p", "a").alias("start"), F.expr(f"p + {step}").alias("end"), F.coalesce("n", F.lit(0)).alias("n"))


def equal_parts(messages: DataFrame, parts: int) -> DataFrame:
    """(part, n): messages in `parts` spans of equal length between the first and the last date."""
    ok = messages.where(dates.is_valid(F.col("date"))).select("doc_id", F.unix_micros(F.col("date").cast("timestamp")).alias("t"))
    span = ok.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    at = F.least(F.lit(parts - 1), F.expr(f"(t - a) div greatest(1, (b - a) div {parts})"))
    return ok.join(F.broadcast(span), how="cross").groupBy(at.cast("int").alias("part")).agg(F.countDistinct("doc_id").alias("n"))  # one row on the right


def sliding(messages: DataFrame, months: int, step: int) -> DataFrame:
    """(start, end, n): windows of `months` months, the last one ending with the last
    message's month, each `step` months before the next, back to the first message.

    A message counts in every window that holds it.  Messages are counted by month
    first, so what is spread over windows is a row a month.
    """
    ok = messages.where(dates.is_valid(F.col("date")))
    per = ok.groupBy(dates.month(F.col("date")).alias("m")).agg(F.countDistinct("doc_id").alias("n"))
    span = per.agg(F.min("m").alias("a"), F.max("m").alias("b"))
    back = f"sequence(0, cast(months_between(b, a) as int), {step})"
    ends = span.where("a is not null").select(F.explode(F.expr(f"transform({back}, i -> add_months(b, -i))")).alias("last"))
    windows = ends.select(F.add_months("last", -(months - 1)).alias("start"), F.add_months("last", 1).alias("end"))
    # months of each window: an equi-join, not a range join
    spread = windows.select("start", "end", F.explode(F.expr("sequence(cast(start as timestamp), cast(end as timestamp) - interval 1 day, interval 1 month)")).alias("m"))
    return spread.join(per, "m", "left").groupBy("start", "end").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def shares(histogram: DataFrame, count: str = "n") -> DataFrame:
    """A histogram with each count's share of all."""
    total = histogram.agg(F.sum(count).alias("_all"))
    return histogram.join(F.broadcast(total), how="cross").withColumn("share", F.col(count) / F.col("_all")).drop("_all")  # one row on the right


def least_frequency(n: Column, percent: float) -> Column:
    """Occurrences from which a term counts: a share of the messages, from 2 to 5."""
    return F.greatest(F.lit(2), F.least(F.lit(5), F.floor(n * percent / 100))).cast("int")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Ranks from 1 in the order of columns that tell all rows apart, without one task or one bucket for many rows.

    Rows are dealt by ranges of the whole order and written sorted; a rank is the place in
    the file and the rows of the files before.  Only a row a file is summed up in one task.
    """
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(cut.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = sizes.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_low")).alias("_before"))
    return placed.join(before, "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_before")
