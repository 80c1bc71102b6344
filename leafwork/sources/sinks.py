"""Writers of rendered pages: JSON lines, Markdown and an HTML site, each file written by the task that holds its page."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_json(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def _write(rows: Iterator[Row], folder: str) -> None:
    for r in rows:
        out = Path(folder) / str(r["doc_id"])
        out.mkdir(parents=True, exist_ok=True)
        (out / r["name"]).write_text(r["content"], encoding="utf-8")


def write_markdown(pages: DataFrame, folder: str) -> None:
    """``page_0001.md`` and so on a document, from ``(doc_id, page, markdown)``; the folder is one that all executors share."""
    named = pages.select("doc_id", F.format_string("page_%04d.md", "page").alias("name"), F.col("markdown").alias("content"))
    named.foreachPartition(lambda rows: _write(rows, folder))


def html_site(pages: DataFrame) -> DataFrame:
    """``(doc_id, name, content)`` from ``(doc_id, page, html)``: pages that link to their neighbours, and an index."""
    w = Window.partitionBy("doc_id").orderBy("page")
    link = lambda page, label: F.when(page.isNotNull(), F.format_string(f'<a href="page_%04d.html">{label}</a>', page)).otherwise("")
    nav = F.concat(F.lit("<nav>"), link(F.lag("page").over(w), "previous"), F.lit(' <a href="index.html">index</a> '), link(F.lead("page").over(w), "next"), F.lit("</nav>"))
    head = F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><link rel="stylesheet" href="styles.css"></head><body>')
    each = pages.select("doc_id", F.format_string("page_%04d.html", "page").alias("name"), F.concat(head, nav, F.col("html"), nav, F.lit("</body></html>")).alias("content"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: F.format_string('<li><a href="page_%04d.html">%d</a></li>', p, p)), "")
    index = pages.groupBy("doc_id").agg(F.concat(head, F.lit("<ol>"), items, F.lit("</ol></body></html>")).alias("content")).select("doc_id", F.lit("index.html").alias("name"), "content")
    style = pages.select("doc_id").distinct().select("doc_id", F.lit("styles.css").alias("name"), F.lit("body{max-width:50em;margin:auto}table{border-collapse:collapse}td,th{border:1px solid}").alias("content"))
    return each.unionByName(index).unionByName(style)


def write_html(pages: DataFrame, folder: str) -> None:
    html_site(pages).foreachPartition(lambda rows: _write(rows, folder))
