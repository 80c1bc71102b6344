import json

from leafwork.sources import readers, sinks
from leafwork.streaming import landing

PAGE = {
    "doc_id": "d", "page": 1, "width": 595.0, "height": 842.0,
    "blocks": [{"type": 0, "lines": [{"spans": [
        {"font": "Serif-Bold", "size": 12.0, "color": 255, "flags": 16, "chars": [{"c": c, "x0": 10.0 + i, "y0": 0.0, "x1": 11.0 + i, "y1": 9.0} for i, c in enumerate("Hi")]},
        {"font": "Wingdings", "size": 12.0, "color": 0, "flags": 0, "chars": [{"c": "n", "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}]},
        {"font": "Serif", "size": 12.0, "color": 0, "flags": 0, "chars": [{"c": " ", "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}]},
    ]}]}, {"type": 1, "lines": []}],
}


def test_raw_pages_to_spans(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(PAGE))
    got = readers.spans(readers.glyphs(readers.raw_pages(spark, str(tmp_path)))).collect()
    assert [(r["text"], r["x0"], r["x1"]) for r in got] == [("Hi", 10.0, 12.0)]


def test_stream_of_a_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(PAGE))
    landing.census(spark, str(tmp_path / "in"), str(tmp_path / "state"), "styles").awaitTermination(60)
    got = {r["style"]: r["chars"] for r in spark.table("styles").collect()}
    assert got == {"Serif-Bold|12.0|0000ff|B": 2, "Serif|12.0|000000|": 1}


def test_fills_keep_what_is_painted(spark):
    white, red = [1.0, 1.0, 1.0], [1.0, 0.0, 0.0]
    rows = [("d", 1, i, k, 0.0, 0.0, w, 50.0, f, s) for i, (k, w, f, s) in enumerate([("f", 50.0, red, None), ("f", 50.0, white, None), ("fs", 50.0, white, red), ("s", 50.0, None, red), ("f", 9000.0, red, None), ("x", 5.0, red, None)])]
    got = {r["seq"]: r["is_stroke"] for r in readers.fills(spark.createDataFrame(rows, readers.DRAWING)).collect()}
    assert got == {0: False, 2: True, 3: True}


def test_sites_link_neighbours(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "<p>a</p>"), (1, 2, "<p>b</p>")], "doc_id long, page int, html string")
    sinks.write_html(pages, str(tmp_path))
    assert {p.name for p in (tmp_path / "1").iterdir()} == {"index.html", "styles.css", "page_0001.html", "page_0002.html"}
    assert 'page_0002.html">next' in (tmp_path / "1/page_0001.html").read_text()
