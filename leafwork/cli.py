"""Command line: ``parse``, ``styles`` and ``audit`` over a folder of tables."""

from __future__ import annotations

import argparse

from leafwork.plans import blocks
from leafwork.session import build_session, ship
from leafwork.sources import sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="leafwork", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for name in ("parse", "styles", "audit"):
        v = verbs.add_parser(name)
        v.add_argument("tables", help="folder with the Parquet tables")
        if name == "parse":
            v.add_argument("--json")
            v.add_argument("--md")
            v.add_argument("--html")
    a = p.parse_args(argv)
    spark = build_session()
    ship(spark)
    if a.verb == "styles":
        blocks.style_census(spark, a.tables).orderBy("chars", ascending=False).show(50, truncate=False)
    elif a.verb == "audit":
        blocks.review_rate(spark, a.tables).show()
    else:
        if a.md:
            sinks.write_markdown(blocks.page_markdown(spark, a.tables), a.md)
        if a.html:
            sinks.write_html(blocks.page_html(spark, a.tables), a.html)
        if a.json:
            sinks.write_json(blocks.page_markdown(spark, a.tables), a.json)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
