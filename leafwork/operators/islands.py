"""Gaps-and-islands and best-match joins, which most layout operators are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, by: list[str], order: list, breaks: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a run ends before each row where ``breaks`` (it may use ``lag`` over the same order) holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__break", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def over(by: list[str], order: list) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def best_match(left: DataFrame, right: DataFrame, keys: list[str], score: Column, least: Column, left_id: list[str], value: Column, seq: str, how: str = "inner") -> DataFrame:
    """For each row of ``left``, ``value`` of the row of ``right`` with the largest score that satisfies ``least``.

    One equi-join by page and one aggregate; of equal scores the smallest ``seq`` wins.
    """
    found = best_of(left.join(right, keys).where(least), [*keys, *left_id], score, value, seq)
    return left.join(found, [*keys, *left_id], "left") if how == "left" else found


def best_of(pairs: DataFrame, by: list[str], score: Column, value: Column, seq: str) -> DataFrame:
    """``(*by, owner, score)``: of the pairs of each ``by``, ``value`` of the one with the largest score; the smallest ``seq`` of equals."""
    found = pairs.groupBy(*by).agg(F.max_by(F.struct(value.alias("owner"), score.alias("score")), F.struct(score, -F.col(seq))).alias("m"))
    return found.select(*by, "m.owner", "m.score")
