"""Readers of page primitives: nested raw pages, drawings, recognised words, gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import geom

CHAR = "struct<c:string,gid:int,ox:double,oy:double,x0:double,y0:double,x1:double,y1:double>"
SPAN = f"struct<font:string,size:double,color:int,flags:int,chars:array<{CHAR}>>"
RAW = f"doc_id string, page int, width double, height double, blocks array<struct<type:int,lines:array<struct<spans:array<{SPAN}>>>>>"
DRAWING = "doc_id string, page int, seq bigint, kind string, x0 double, y0 double, x1 double, y1 double, fill array<double>, stroke array<double>"
OCR = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
GOLD = "pages array<struct<id:string,pdf:string,page:int,doc_type:string,blocks:array<string>,table:array<array<string>>>>"


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).json(path)


def glyphs(raw: DataFrame) -> DataFrame:
    """A row a character with its place in the page; symbol fonts' Latin letters are left out."""
    b = raw.select("doc_id", "page", F.posexplode("blocks").alias("block_no", "b")).where("b.type = 0")
    ln = b.select("doc_id", "page", "block_no", F.posexplode("b.lines").alias("line_no", "l"))
    s = ln.select("doc_id", "page", "block_no", "line_no", F.posexplode("l.spans").alias("span_no", "s"))
    g = s.select("doc_id", "page", "block_no", "line_no", "span_no", "s.font", "s.size", "s.color", "s.flags", F.posexplode("s.chars").alias("glyph_no", "g")).select("*", "g.*").drop("g")
    symbol = F.lower("font").rlike("dingbat|wingding|webding") & F.col("c").rlike("^[A-Za-z]$")
    return g.where(~F.coalesce(symbol, F.lit(False)))


def spans(glyph_rows: DataFrame) -> DataFrame:
    """Characters joined by span; blank spans go, and those without width that hold only vowel marks."""
    key = ["doc_id", "page", "block_no", "line_no", "span_no"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_no", "c"))), lambda x: x["c"]), "")
    s = glyph_rows.groupBy(*key, "font", "size", "color", "flags").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    marks = (F.col("x1") <= F.col("x0")) & F.col("text").rlike("^[ً-ٟ]+$")
    return s.where((F.trim("text") != "") & ~marks)


def fills(drawings: DataFrame, page_area: float = 595.0 * 842.0) -> DataFrame:
    """Painted shapes: filled, or stroked with a colour that isn't near white; none that covers most of the page."""
    white = lambda c: geom.near_white(c[0], c[1], c[2])
    stroked = (F.col("kind") == "s") | ((F.col("kind") == "fs") & white(F.col("fill")) & ~white(F.col("stroke")))
    d = drawings.where(F.col("kind").isin("f", "s", "fs")).withColumn("is_stroke", stroked).withColumn("rgb", F.when(stroked, F.col("stroke")).otherwise(F.col("fill")))
    d = d.where(F.col("rgb").isNotNull() & ~white(F.col("rgb")) & (geom.area() < 0.6 * page_area))
    return d.select("doc_id", "page", "seq", "x0", "y0", "x1", "y1", F.col("rgb")[0].alias("r"), F.col("rgb")[1].alias("g"), F.col("rgb")[2].alias("b"), "is_stroke")


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of recognised pages from tab-separated files: those with a confidence and a text."""
    return spark.read.schema(OCR).option("sep", "\t").option("header", True).option("quote", "").csv(path).where("conf >= 0 and trim(text) <> ''")


def gold_pages(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pages; those without blocks are left out."""
    return spark.read.schema(GOLD).option("multiLine", True).json(path).select(F.explode("pages").alias("p")).select("p.*").where(F.size("blocks") > 0)
