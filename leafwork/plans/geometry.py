"""Queries over fills, images and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafwork.functions import geom
from leafwork.operators.graph import components
from leafwork.sources import derived as D

PG = ["doc_id", "page"]


def _prefixed(df: DataFrame, p: str, *keep: str) -> DataFrame:
    return df.select(*PG, *[F.col(c).alias(f"{p}{c}") for c in ("seq", "x0", "y0", "x1", "y1", *keep)])


def fill_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.fills(spark, sf_dir)
    return f.select(*PG, "seq", geom.is_rule().alias("is_rule"), geom.is_chip().alias("is_chip"), geom.is_panel().alias("is_panel"))


_RULE = "(least(x1 - x0, y1 - y0) < 3 AND greatest(x1 - x0, y1 - y0) > 20)"
_CLASS = f"""{_RULE} AS is_rule,
  NOT {_RULE} AND CASE WHEN y1 - y0 > 0 THEN (x1 - x0) / (y1 - y0) ELSE 999 END BETWEEN 0.5500001 AND 1.7999999 AND (x1 - x0) * (y1 - y0) > 40 AND (x1 - x0) * (y1 - y0) < 900 AS is_chip,
  NOT {_RULE} AND (x1 - x0) * (y1 - y0) >= 900 AS is_panel"""


def near_white_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills that count: not near white, and not most of a page of 595 by 842."""
    f = D.fills(spark, sf_dir)
    kept = f.where(~geom.near_white(F.col("r"), F.col("g"), F.col("b")) & (geom.area() < 0.6 * 595 * 842))
    return kept.select(*PG, "seq", geom.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


_HEX = "'#' || " + " || ".join(f"lpad(lower(to_hex(CAST(round_even(least(greatest({c}, 0), 1) * 255, 0) AS BIGINT))), 2, '0')" for c in "rgb")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.fills(spark, sf_dir)
    return _prefixed(f, "a_").join(_prefixed(f, "b_"), PG)


def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.rint(geom.containment("a_", "b_") * 1_000_000).cast("long")
    return _pairs(spark, sf_dir).where("a_seq <> b_seq").select(*PG, "a_seq", "b_seq", score.alias("millionths")).where("millionths > 0")


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.rint(geom.iou("a_", "b_") * 1_000_000).cast("long")
    return _pairs(spark, sf_dir).where("a_seq < b_seq").select(*PG, "a_seq", "b_seq", score.alias("millionths")).where("millionths > 0")


_INTER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_A, _B = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"


def collinear_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal rules of a document in 2-point buckets, each with its full extent."""
    f = D.fills(spark, sf_dir).where(geom.is_rule() & (F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")))
    bucket = (F.rint((F.col("y0") + F.col("y1")) / 2 / 2) * 2).cast("long")
    by_bucket = f.groupBy((F.col("doc_id") % 40).alias("sheet"), bucket.alias("y"))
    return by_bucket.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"))


def rule_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of a document that overlap once padded by 8, as connected components: the smallest number names a cluster."""
    f = D.fills(spark, sf_dir)
    pairs = _prefixed(f, "a_").join(_prefixed(f, "b_"), PG).where("a_seq < b_seq").where(geom.intersects("a_", "b_", 8.0))
    key = lambda c: F.col("doc_id") * 10 + F.col(c)
    found = components(pairs.select(key("a_seq").alias("a"), key("b_seq").alias("b")))
    return f.select((F.col("doc_id") * 10 + F.col("seq")).alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


_CLUSTERS = f"""WITH RECURSIVE {D.FILLS}, e AS (
  SELECT a.doc_id * 10 + a.seq AS a, b.doc_id * 10 + b.seq AS b FROM w_fills a JOIN w_fills b USING (doc_id, page)
  WHERE a.seq <> b.seq AND a.x0 < b.x1 + 16 AND b.x0 < a.x1 + 16 AND a.y0 < b.y1 + 16 AND b.y0 < a.y1 + 16
), r AS (SELECT doc_id * 10 + seq AS node, doc_id * 10 + seq AS other FROM w_fills UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node, min(other) AS cluster FROM r GROUP BY node"""


def image_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed images (fills of at least 3000) that overlap, merged: the union box and whether it is a composite."""
    f = D.fills(spark, sf_dir).where(geom.area() >= 3000)
    pairs = _prefixed(f, "a_").join(_prefixed(f, "b_"), PG).where("a_seq < b_seq").where(geom.intersects("a_", "b_"))
    key = lambda c: F.col("doc_id") * 10 + F.col(c)
    found = components(pairs.select(key("a_seq").alias("a"), key("b_seq").alias("b")))
    named = f.withColumn("node", key("seq")).join(found, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    return named.groupBy("doc_id", "cluster").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.count("*") > 1).alias("composite"))


_IMAGES = f"""WITH RECURSIVE {D.FILLS}, i AS (SELECT *, doc_id * 10 + seq AS node FROM w_fills WHERE (x1 - x0) * (y1 - y0) >= 3000), e AS (
  SELECT a.node AS a, b.node AS b FROM i a JOIN i b USING (doc_id) WHERE a.seq <> b.seq AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
), r AS (SELECT node, node AS other FROM i UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT node, min(other) AS cluster FROM r GROUP BY node)
SELECT doc_id, cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) > 1 AS composite FROM i JOIN c USING (node) GROUP BY doc_id, cluster"""


def panel_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five colours, in order, of a sheet's panels."""
    f = D.fills(spark, sf_dir).where(geom.is_panel())
    return f.groupBy((F.col("doc_id") % 40).alias("sheet")).agg(F.array_join(F.slice(F.array_sort(F.collect_set(geom.hex_colour(F.col("r"), F.col("g"), F.col("b")))), 1, 5), ",").alias("colours"))


def panel_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of at least 2000 that don't lie, by more than 0.92, in a larger one that is kept: an ordered fold a page."""
    f = D.fills(spark, sf_dir).where(geom.is_panel() & (geom.area() >= 2000))
    item = F.struct((-geom.area()).alias("k"), F.col("seq").alias("seq"), "x0", "y0", "x1", "y1")
    pages = f.groupBy(*PG).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def inside(a: F.Column, b: F.Column) -> F.Column:
        w, h = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        return F.when((w > 0) & (h > 0), w * h / -a["k"]).otherwise(F.lit(0.0)) > 0.92

    kept = F.aggregate("items", F.slice("items", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: inside(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    return pages.select(*PG, F.explode(kept).alias("p")).select(*PG, "p.seq", "p.x0", "p.y0", "p.x1", "p.y1")


def nation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagram a region: a box for it above one for each of its nations."""
    n, r = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "region")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    boxes = n.select(F.col("n_regionkey").alias("doc_id"), place.alias("seq"), F.col("n_name").alias("label"), (20.0 + 110 * (place - 1)).alias("x0"), F.lit(200.0).alias("y0"))
    tops = r.select(F.col("r_regionkey").alias("doc_id"), F.lit(0).alias("seq"), F.col("r_name").alias("label"), F.lit(250.0).alias("x0"), F.lit(40.0).alias("y0"))
    both = tops.unionByName(boxes)
    return both.select("doc_id", F.lit(1).alias("page"), "seq", "label", "x0", "y0", (F.col("x0") + 90).alias("x1"), (F.col("y0") + 30).alias("y1"))


_NATIONS = """w_boxes AS (
  SELECT doc_id, 1 AS page, seq, label, x0, y0, x0 + 90 AS x1, y0 + 30 AS y1 FROM (
    SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 0 AS seq, r_name AS label, 250.0::DOUBLE AS x0, 40.0::DOUBLE AS y0 FROM region
    UNION ALL SELECT n_regionkey, CAST(place AS INTEGER), n_name, 20.0::DOUBLE + 110 * (place - 1), 200.0::DOUBLE
    FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation))
)"""


def connector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A straight line from the foot of each top box to the head of each box under it."""
    b = nation_boxes(spark, sf_dir)
    top = b.where("seq = 0").select("doc_id", ((F.col("x0") + F.col("x1")) / 2).alias("tx"), F.col("y1").alias("ty"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    low = b.where("seq > 0").join(top, "doc_id")
    return low.select("doc_id", "page", "seq", F.array(pt(F.col("tx"), F.col("ty")), pt((F.col("x0") + F.col("x1")) / 2, F.col("y0"))).alias("points"))


def diagram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that straight lines connect: each end belongs to the first box, padded by 10, that holds it."""
    boxes = nation_boxes(spark, sf_dir).select("doc_id", F.col("seq").alias("box"), "label", "x0", "y0", "x1", "y1")
    ends = connector_lines(spark, sf_dir).where(geom.straight(F.col("points"))).select("doc_id", F.col("seq").alias("line"), F.posexplode("points").alias("end", "p"))
    pad = 10.0
    hit = ends.join(boxes, "doc_id").where((F.col("p.x") >= F.col("x0") - pad) & (F.col("p.x") <= F.col("x1") + pad) & (F.col("p.y") >= F.col("y0") - pad) & (F.col("p.y") <= F.col("y1") + pad))
    first = hit.groupBy("doc_id", "line", "end").agg(F.min_by("label", "box").alias("label"))
    labels = first.groupBy("doc_id", "line").agg(F.array_sort(F.collect_set("label")).alias("l")).where(F.size("l") >= 2)
    return labels.select("doc_id", F.col("l")[0].alias("a"), F.col("l")[1].alias("b")).distinct()


_EDGES = f"""WITH {_NATIONS}, ends AS (
  SELECT t.doc_id, b.seq AS line, unnest([0, 1]) AS i, unnest([(t.x0 + t.x1) / 2, (b.x0 + b.x1) / 2]) AS x, unnest([t.y1, b.y0]) AS y
  FROM w_boxes t JOIN w_boxes b USING (doc_id) WHERE t.seq = 0 AND b.seq > 0
), hit AS (SELECT e.doc_id, line, i, arg_min(label, w.seq) AS label FROM ends e JOIN w_boxes w ON w.doc_id = e.doc_id
  AND x BETWEEN x0 - 10 AND x1 + 10 AND y BETWEEN y0 - 10 AND y1 + 10 GROUP BY ALL)
SELECT DISTINCT doc_id, min(label) AS a, max(label) AS b FROM hit GROUP BY doc_id, line HAVING count(DISTINCT label) >= 2"""


def mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each diagram as a Mermaid flowchart: nodes A, B, .. in order of place, then links."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    name = F.when(place < 26, F.char(65 + place)).otherwise(F.concat(F.lit("N"), place.cast("string")))
    nodes = nation_boxes(spark, sf_dir).withColumn("id", name)
    lines = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("    "), "id", F.lit('["'), "label", F.lit('"]')).alias("t")))).alias("n"))
    ids = nodes.select("doc_id", "label", "id")
    e = diagram_edges(spark, sf_dir)
    e = e.join(ids.select("doc_id", F.col("label").alias("a"), F.col("id").alias("ia")), ["doc_id", "a"]).join(ids.select("doc_id", F.col("label").alias("b"), F.col("id").alias("ib")), ["doc_id", "b"])
    links = e.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("    "), F.least("ia", "ib"), F.lit(" --- "), F.greatest("ia", "ib")))).alias("e"))
    return lines.join(links, "doc_id", "left").select("doc_id", F.concat_ws("\n", F.lit("graph TD"), F.col("n.t"), F.col("e")).alias("chart"))


_MERMAID = _EDGES.replace("SELECT DISTINCT doc_id, min(label)", ", ed AS (SELECT DISTINCT doc_id, min(label)") + """),
ids AS (SELECT *, chr(CAST(64 + row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INTEGER)) AS id FROM w_boxes),
n AS (SELECT doc_id, string_agg('    ' || id || '["' || label || '"]', chr(10) ORDER BY seq) AS t FROM ids GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY l) AS t FROM (SELECT ed.doc_id, '    ' || least(p.id, q.id) || ' --- ' || greatest(p.id, q.id) AS l
  FROM ed JOIN ids p ON p.doc_id = ed.doc_id AND p.label = ed.a JOIN ids q ON q.doc_id = ed.doc_id AND q.label = ed.b) GROUP BY doc_id)
SELECT n.doc_id, 'graph TD' || chr(10) || n.t || coalesce(chr(10) || k.t, '') AS chart FROM n LEFT JOIN k USING (doc_id)"""
_MERMAID = _MERMAID.replace("GROUP BY ALL)\n,", "GROUP BY ALL),")


def shape_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each box: all spans centred in it, by line and place; else the nearest one within 60 points."""
    boxes = nation_boxes(spark, sf_dir)
    spans = boxes.where("seq % 3 <> 1").select("doc_id", F.col("seq").alias("s"), F.explode(F.array(F.struct((F.col("x0") + 20).alias("cx"), (F.col("y0") + 10).alias("cy"), F.substring("label", 1, 4).alias("t")), F.struct((F.col("x0") + 60).alias("cx"), (F.col("y0") + 10).alias("cy"), F.substring("label", 5, 40).alias("t")))).alias("p")).select("doc_id", "s", "p.*")
    j = boxes.join(spans, "doc_id")
    inside = (F.col("cx") >= F.col("x0") - 2) & (F.col("cx") <= F.col("x1") + 2) & (F.col("cy") >= F.col("y0") - 2) & (F.col("cy") <= F.col("y1") + 2)
    d = F.sqrt(F.pow(F.col("cx") - (F.col("x0") + F.col("x1")) / 2, 2) + F.pow(F.col("cy") - (F.col("y0") + F.col("y1")) / 2, 2))
    own = F.array_sort(F.collect_list(F.when(inside, F.struct(F.rint("cy").alias("y"), "cx", "t"))))
    g = j.groupBy("doc_id", "seq").agg(own.alias("own"), F.min_by(F.when(d < 60, F.col("t")), F.struct(d, "s", "cx")).alias("near"))
    return g.select("doc_id", "seq", F.coalesce(F.nullif(F.array_join("own.t", " "), F.lit("")), F.col("near"), F.lit("")).alias("label"))


_LABELS = f"""WITH {_NATIONS}, sp AS (
  SELECT doc_id, seq AS s, unnest([x0 + 20, x0 + 60]) AS cx, unnest([y0 + 10, y0 + 10]) AS cy, unnest([substr(label, 1, 4), substr(label, 5, 40)]) AS t FROM w_boxes WHERE seq % 3 <> 1
), j AS (SELECT b.*, sp.s, cx, cy, t, cx BETWEEN x0 - 2 AND x1 + 2 AND cy BETWEEN y0 - 2 AND y1 + 2 AS inside,
  sqrt(pow(cx - (x0 + x1) / 2, 2) + pow(cy - (y0 + y1) / 2, 2)) AS d FROM w_boxes b JOIN sp USING (doc_id))
SELECT doc_id, seq, coalesce(nullif(string_agg(t, ' ' ORDER BY round_even(cy, 0), cx, t) FILTER (WHERE inside), ''),
  first(CASE WHEN d < 60 THEN t END ORDER BY d, s, cx), '') AS label FROM j GROUP BY doc_id, seq"""


def box_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are boxes: corners only, and not flat. Every fourth one gets a point that is no corner."""
    f = D.fills(spark, sf_dir)
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    odd = F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y0").alias("y"))
    points = F.array(pt("x0", "y0"), pt("x1", "y0"), F.when(F.col("doc_id") % 4 == 0, odd).otherwise(pt("x1", "y1")), pt("x0", "y1"))
    return f.select("doc_id", "seq", geom.is_box(points).alias("is_box"), geom.straight(F.slice(points, 1, 3)).alias("is_straight"))


_BOXES = f"""WITH {D.FILLS}, p AS (SELECT *, doc_id % 4 = 0 AS odd, x1 - x0 AS w, y1 - y0 AS h FROM w_fills)
SELECT doc_id, seq, least(w, h) >= 3 AND (NOT odd OR w <= 0.1) AS is_box,
  CASE WHEN odd THEN w + w / 2 <= 1.3 * (w / 2) ELSE w + h <= 1.3::DOUBLE * sqrt(w * w + h * h) END AS is_straight FROM p"""


QUERIES = {f.__name__: f for f in (fill_classification, near_white_filter, containment_pairs, iou_pairs, collinear_rules, rule_clusters, image_clusters, panel_colours, panel_regions, diagram_edges, mermaid, shape_labels, box_shapes)}
SQL = {
    "fill_classification": f"WITH {D.FILLS} SELECT doc_id, page, seq, {_CLASS} FROM w_fills",
    "near_white_filter": f"WITH {D.FILLS} SELECT doc_id, page, seq, {_HEX} AS colour FROM w_fills WHERE NOT (r > 0.96 AND g > 0.96 AND b > 0.96) AND (x1 - x0) * (y1 - y0) < 0.6 * 595 * 842",
    "containment_pairs": f"WITH {D.FILLS} SELECT * FROM (SELECT doc_id, page, a.seq AS a_seq, b.seq AS b_seq, CAST(round_even({_INTER} / {_A} * 1000000, 0) AS BIGINT) AS millionths FROM w_fills a JOIN w_fills b USING (doc_id, page) WHERE a.seq <> b.seq) WHERE millionths > 0",
    "iou_pairs": f"WITH {D.FILLS} SELECT * FROM (SELECT doc_id, page, a.seq AS a_seq, b.seq AS b_seq, CAST(round_even({_INTER} / ({_A} + {_B} - {_INTER}) * 1000000, 0) AS BIGINT) AS millionths FROM w_fills a JOIN w_fills b USING (doc_id, page) WHERE a.seq < b.seq) WHERE millionths > 0",
    "collinear_rules": f"WITH {D.FILLS} SELECT doc_id % 40 AS sheet, CAST(round_even((y0 + y1) / 4, 0) * 2 AS BIGINT) AS y, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM w_fills WHERE {_RULE} AND x1 - x0 >= y1 - y0 GROUP BY ALL",
    "rule_clusters": _CLUSTERS,
    "image_clusters": _IMAGES,
    "panel_colours": f"WITH {D.FILLS} SELECT sheet, array_to_string(list_sort(list(DISTINCT c))[1:5], ',') AS colours FROM (SELECT doc_id % 40 AS sheet, {_HEX} AS c FROM w_fills WHERE NOT {_RULE} AND (x1 - x0) * (y1 - y0) >= 900) GROUP BY sheet",
    "diagram_edges": _EDGES,
    "mermaid": _MERMAID,
    "shape_labels": _LABELS,
    "box_shapes": _BOXES,
}
