import unicodedata

from pyspark.sql import functions as F

from leafwork.functions import geom
from leafwork.functions import script as S
from leafwork.operators.graph import components


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_all_presentation_forms(spark):
    text = "".join(S.FORMS)
    assert one(spark, S.deshape(F.col("t")), t=text) == "".join(unicodedata.normalize("NFKC", c) for c in text)


def test_normalize_turns_ligatures_as_one(spark):
    logical = "في هذا النص كان الذي قد مع السؤال"
    backwards = logical[::-1]
    got = one(spark, S.normalize(F.col("t")), t=backwards)
    assert got["text"] == logical and got["was_reversed"] and not got["had_forms"]
    assert one(spark, S.normalize(F.col("t")), t=logical)["was_reversed"] is False


def test_reverse_keeps_latin_runs(spark):
    assert one(spark, S.reverse_runs(F.col("t")), t="ab2021 (cd") == "cd) ab2021"


def test_numeric_cells_and_markers(spark):
    for t, want in (("1,234.50", True), ("(12)%", True), ("—", True), ("$", True), ("a1", False), ("", False), ("( )", False)):
        assert one(spark, S.numeric_cell(F.col("t")), t=t) is want, t
    for t, want in (("•", True), ("(12)", True), ("3.", True), ("a)", True), ("1-2", True), ("1234.", False), ("ab)", False)):
        assert one(spark, S.list_marker(F.col("t")), t=t) is want, t


def test_geometry_boundaries(spark):
    box = dict(x0=0.0, y0=0.0, x1=30.0, y1=30.0)
    assert one(spark, geom.is_panel(), **box) and not one(spark, geom.is_chip(), **box)
    assert one(spark, geom.is_rule(), x0=0.0, y0=0.0, x1=21.0, y1=2.0)
    assert not one(spark, geom.is_rule(), x0=0.0, y0=0.0, x1=20.0, y1=2.0)
    touching = dict(ax0=0.0, ay0=0.0, ax1=10.0, ay1=10.0, bx0=10.0, by0=0.0, bx1=20.0, by1=10.0)
    assert one(spark, geom.containment("a", "b"), **touching) == 0 and one(spark, geom.iou("a", "b"), **touching) == 0
    assert one(spark, geom.hex_colour(F.lit(1.2), F.lit(0.5), F.lit(-1.0))) == "#ff8000"


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
