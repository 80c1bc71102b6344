"""Queries that find whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.operators import tables
from leafwork.sources import derived as D


def borderless_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of orders found again from the places of their words; one line a table."""
    g = D.grid(spark, sf_dir)
    t = tables.borderless_tables(g)
    return t.select("doc_id", F.size("grid").alias("rows"), F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "\n").alias("grid"))


def definition_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as terms with explanations that wrap, between rules."""
    p = D.table(spark, sf_dir, "part").select((F.col("p_partkey") / 8).cast("long").alias("doc_id"), (F.col("p_partkey") % 8).cast("int").alias("r"), "p_brand", "p_name", "p_type", "p_partkey")
    p = p.withColumn("y", 100.0 + 40 * F.col("r"))
    cell = lambda i, t, x, dy: F.struct((F.col("r") * 3 + i).cast("long").alias("seq"), t.alias("text"), F.lit(x).alias("x0"), (F.col("y") + dy).alias("y0"), (F.lit(x) + 4.0 * F.length(t)).alias("x1"), (F.col("y") + dy + 10).alias("y1"))
    key = F.concat(F.lit("K"), F.col("p_partkey").cast("string"))
    spans = p.select("doc_id", F.lit(1).alias("page"), F.explode(F.array(cell(0, key, 50.0, 0.0), cell(1, F.col("p_name"), 150.0, 0.0), cell(2, F.col("p_type"), 150.0, 14.0))).alias("s")).select("doc_id", "page", "s.*")
    ends = spans.groupBy("doc_id", "page").agg(F.min("y0").alias("a"), F.max("y1").alias("b"))
    rules = ends.select("doc_id", "page", F.explode(F.array(F.col("a") - 4, F.col("b") + 3)).alias("y0")).select("doc_id", "page", F.lit(45.0).alias("x0"), "y0", F.lit(500.0).alias("x1"), (F.col("y0") + 1).alias("y1"))
    t = tables.definition_tables(spans, rules)
    return t.select("doc_id", F.size("grid").alias("rows"), F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "\n").alias("grid"))


QUERIES = {f.__name__: f for f in (borderless_tables, definition_tables)}
SQL = {
    "borderless_tables": f"WITH {D.GRID}, r AS (SELECT doc_id, rank, string_agg(text, '|' ORDER BY c) AS line FROM w_grid GROUP BY ALL) SELECT doc_id, CAST(count(*) AS INTEGER) AS rows, string_agg(line, chr(10) ORDER BY rank) AS grid FROM r GROUP BY doc_id HAVING count(*) >= 3",
    "definition_tables": "WITH p AS (SELECT p_partkey // 8 AS doc_id, p_partkey % 8 AS r, 'K' || p_partkey || '|' || p_name || ' ' || p_type AS line FROM part) SELECT doc_id, CAST(count(*) AS INTEGER) AS rows, string_agg(line, chr(10) ORDER BY r) AS grid FROM p GROUP BY doc_id HAVING count(*) >= 3",
}
