"""Boilerplate lines by site-relative frequency (operator 10).

Documents are grouped by host. A line (trimmed of spaces) is boilerplate on a host if more than ``ratio`` of the host's
pages contain it and it stands on more than one of them (a line of one page alone repeats nothing, and would otherwise go
from every host of fewer than 1/ratio pages); such lines are dropped from every page of that host.

Scale: one pass over the lines as 64-bit hashes, with map-side combine, finds the boilerplate of each host. A host can
have at most (mean lines a page)/ratio of such lines whatever its size, so the result is tiny; as one row per host it is
broadcast if its measured size is below ``broadcast_bytes``, and joined by host with a shuffle otherwise. The texts then
never leave their partition.

Edge cases: a null host is a host of its own; a null text stays null and has no lines, but its page counts; blank lines are
never boilerplate and stay; a line that repeats within a page counts once; a page whose lines all go keeps an empty text;
a share of exactly ``ratio`` isn't more than it, so the line stays; texts are read whole whatever their length; repeated
rows are pages of their own; an empty table stays empty; other columns pass through and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import common
from leafwork.session import cut

RATIO = 0.05
BROADCAST_BYTES = 32 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, text_col: str = "text", host: Column | None = None, ratio: float = RATIO) -> DataFrame:
    """``(host, bad)``: for each host with any, the hashes of its boilerplate lines in ascending order."""
    host = F.col("source") if host is None else host
    pages = docs.select(host.cast("string").alias("host"), F.col(text_col).alias("text"))
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    hashes = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))
    seen = pages.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    often = seen.join(total, seen["host"].eqNullSafe(total["host"])).where(F.col("n") > ratio * F.col("pages")).select(seen["host"], "line")
    return often.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("bad"))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host: Column | None = None, ratio: float = RATIO, broadcast_bytes: int = BROADCAST_BYTES, count_col: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text_col``; ``count_col`` gets the number of them if it is named."""
    host = F.col("source") if host is None else host
    site, lines = common.fresh("host", "bad")
    bad = cut(boilerplate(docs, text_col, host, ratio).select(F.col("host").alias(site), F.col("bad").alias(lines)))
    size = bad.agg(F.sum(F.size(lines) * 8 + 64)).first()[0] or 0
    side = F.broadcast(bad) if size <= broadcast_bytes else bad.hint("merge")
    joined = docs.join(side, host.cast("string").eqNullSafe(F.col(site)), "left")
    split = _lines(F.col(text_col))
    kept = F.filter(split, lambda x: ~F.array_contains(F.col(lines), F.xxhash64(F.trim(x))) | (F.trim(x) == ""))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    gone = F.when(F.col(lines).isNull() | F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(split) - F.size(kept))
    out = [text.alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*out, *([gone.alias(count_col)] if count_col else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs, count_col="n_dropped")


SQL = f"""
WITH lines AS (
  SELECT DISTINCT doc_id, source, trim(l) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM documents)
  WHERE trim(l) <> ''
), total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT source, line FROM (SELECT source, line, count(*) AS n FROM lines GROUP BY ALL) JOIN total USING (source)
  WHERE n > 1 AND n > {RATIO} * pages
), kept AS (
  SELECT d.doc_id, d.source, d.i, d.l, b.line IS NOT NULL AS gone
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l,
               unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) d
  LEFT JOIN bad b ON b.source = d.source AND b.line = trim(d.l)
)
SELECT doc_id, source, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
       CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_dropped
FROM kept GROUP BY doc_id, source
"""
