"""Queries that score results and tell hard pages; repair of glyphs and of blocks drawn twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafwork.functions import geom
from leafwork.operators import score
from leafwork.operators.edits import likeness
from leafwork.plans import blocks, layout
from leafwork.sources import derived as D

PG = ["doc_id", "page"]


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids of all tables, and predictions that lose a row or garble a cell by the number of the table."""
    g = blocks._grids(spark, sf_dir)
    rows = F.slice("grid", F.lit(1), F.size("grid") - (F.col("doc_id") % 2).cast("int"))
    return g.select("doc_id", "grid", F.transform(rows, lambda r, i: F.when((i == 0) & (F.col("doc_id") % 3 == 0), F.transform(r, lambda c, j: F.when(j == 0, F.lit("?")).otherwise(c))).otherwise(r)).alias("pred"))


def teds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _damaged(spark, sf_dir)
    d = d.select("doc_id", score.teds_column(F.col("pred"), F.col("grid")).alias("t"))
    return d.select("doc_id", *[F.rint(F.col(f"t.{c}") * 1_000_000).cast("long").alias(c) for c in ("teds", "structure")])


def cell_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damaged(spark, sf_dir).select("doc_id", F.rint(score.cells_column(F.col("pred"), F.col("grid")) * 1_000_000).cast("long").alias("cells"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents as gold, and as prediction backwards or without the first by the number of the document."""
    d = D.table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "").alias("gold"))
    n = F.size("gold")
    turned = F.when(F.col("doc_id") % 3 == 0, F.reverse("gold")).when((F.col("doc_id") % 3 == 1) & (n > 1), F.slice("gold", F.lit(2), n - 1)).otherwise(F.col("gold"))
    return d.withColumn("pred", turned)


def reading_order_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("doc_id", F.rint(score.order_column(F.col("pred"), F.col("gold")) * 1_000_000).cast("long").alias("order"))


def space_glyph_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs that stand for a space: of at least five samples of a font's glyph in a document, 60 % read as white space."""
    chars = D.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("font"), F.col("doc_id") % 3).alias("font"), F.posexplode(F.split("text", "")).alias("i", "c"))
    gid = F.when(F.col("c").isin(" ", "\n"), 3).otherwise(F.ascii("c") % 97 + 4)
    read = F.when((gid == 3) & (F.col("i") % 5 == 0), "x").otherwise(F.col("c"))
    tally = chars.where("c <> ''").select("doc_id", "font", gid.alias("gid"), read.alias("c")).groupBy("doc_id", "font", "gid")
    return tally.agg(F.count("*").alias("n"), F.sum(F.col("c").isin(" ", "\n").cast("int")).alias("blank")).where("n >= 5 and blank >= 0.6 * n").select("doc_id", "font", "gid", "n", "blank")


def duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of blocks that are drawn twice: boxes alike (0.5) and the same letters (0.92)."""
    p = layout.paragraphs(spark, sf_dir).select("doc_id", (F.col("page") * 2 + F.col("col")).alias("col"), "page", "x0", "y0", "x1", "y1", "text")
    b = p.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).where("copy = 0 or doc_id % 3 = 0").select("doc_id", "page", (F.col("col") * 2 + F.col("copy")).alias("block"), (F.col("x0") + 4 * F.col("copy")).alias("x0"), (F.col("y0") + 3 * F.col("copy")).alias("y0"), (F.col("x1") + 4 * F.col("copy")).alias("x1"), (F.col("y1") + 3 * F.col("copy")).alias("y1"), F.regexp_replace(F.lower("text"), r"\P{L}", "").alias("letters"))
    side = lambda q: b.select("doc_id", "page", *[F.col(c).alias(q + c) for c in ("block", "x0", "y0", "x1", "y1", "letters")])
    near = side("a_").join(side("b_"), ["doc_id", "page"]).where("a_block < b_block").where(geom.iou("a_", "b_") >= 0.5).select("doc_id", "a_block", "b_block", "a_letters", "b_letters")
    text = lambda c: F.array_join(F.collect_list(c), "").alias(c)
    both = near.groupBy("doc_id", "a_block", "b_block").agg(text("a_letters"), text("b_letters"))
    sim = both.select("doc_id", "a_block", "b_block", score.letters_column(F.col("a_letters"), F.col("b_letters")).alias("s")).select("doc_id", "a_block", "b_block", "s.*").where("u > 0")
    return sim.where("i >= 0.92 * u").select("doc_id", "a_block", "b_block")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each page that it is hard: sparse text, many small blocks, repeated lines, panels over text."""
    p = layout.paragraphs(spark, sf_dir).groupBy(*PG).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("blocks"), F.sum("n_lines").alias("lines"))
    t = layout.text_lines(spark, sf_dir).where(F.length("text") >= 12).groupBy(*PG).agg((F.count("*") - F.count_distinct("text")).alias("again"))
    o = layout.span_owner(spark, sf_dir).groupBy(*PG).agg(F.count("*").alias("covered"))
    s = p.join(t, PG, "left").join(o, PG, "left").na.fill(0, ["again", "covered"])
    flags = {"sparse": F.col("chars") < 200, "fragmented": F.col("blocks") * 3 > F.col("lines") * 2, "repeated": F.col("again") > 0, "covered": F.col("covered") > 20}
    return s.select(*PG, *[f.alias(k) for k, f in flags.items()])


def hardness_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["sparse", "fragmented", "repeated", "covered"]
    fired = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    s = _signals(spark, sf_dir).withColumn("fired", fired)
    return s.select(*PG, F.array_join("fired", ",").alias("fired"), F.size("fired").alias("consensus"))


_SIGNALS = f"""WITH {D.WORDS}, {layout.LINES}, {layout.PARAS}, {D.FILLS}, {layout._PANELS},
p AS (SELECT doc_id, page, sum(length(text)) AS chars, count(*) AS blocks, sum(n_lines) AS lines FROM w_paras GROUP BY ALL),
t AS (SELECT doc_id, page, count(*) - count(DISTINCT text) AS again FROM w_lines WHERE length(text) >= 12 GROUP BY ALL),
o AS (SELECT doc_id, page, count(DISTINCT seq) AS covered FROM w_words JOIN w_panels USING (doc_id, page) WHERE {layout._SHARE} > 0.6 GROUP BY ALL),
s AS (SELECT doc_id, page, chars < 200 AS sparse, blocks * 3 > lines * 2 AS fragmented, coalesce(again, 0) > 0 AS repeated, coalesce(covered, 0) > 20 AS covered FROM p LEFT JOIN t USING (doc_id, page) LEFT JOIN o USING (doc_id, page))"""


def hardness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which each signal fires."""
    s = _signals(spark, sf_dir)
    return s.unpivot(PG, ["sparse", "fragmented", "repeated", "covered"], "signal", "fires").groupBy("signal").agg(F.sum(F.col("fires").cast("int")).alias("pages"))


def hardest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten pages on which most signals agree."""
    return hardness_consensus(spark, sf_dir).orderBy(F.desc("consensus"), "doc_id", "page").limit(10)


def parser_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean likeness of three ways to give a document's lines in ASCII, overall and by language."""
    ways = {"whole": lambda t: t, "lower": str.lower, "words": lambda t: " ".join(reversed(t.split(" ")))}
    p = likeness(D.ascii_documents(spark, sf_dir, "lang"), "lang", ways).withColumnRenamed("way", "parser")
    cube = p.groupingSets([["parser"], ["parser", "lang"]], "parser", "lang").agg((F.sum("total") / F.sum("n")).alias("score"), F.sum("n").alias("n"))
    return cube.select("parser", F.coalesce("lang", F.lit("all")).alias("doc_type"), F.rint(F.col("score") * 100_000).cast("long").alias("score"), "n")


def invariant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard counts: presentation forms left in repaired text, tables that aren't rectangular, empty pages."""
    from leafwork.functions import script as S

    forms = D.arabic(spark, sf_dir).select(F.count_if(S.has_forms(S.deshape(F.col("text")))).alias("n")).select(F.lit("presentation_forms").alias("name"), "n")
    ragged = blocks._grids(spark, sf_dir).select(F.count_if(F.size(F.array_distinct(F.transform("grid", lambda r: F.size(r)))) > 1).alias("n")).select(F.lit("ragged_tables").alias("name"), "n")
    pages = layout.born_digital_pages(spark, sf_dir).select(F.count_if(F.col("chars") == 0).alias("empty_pages"), F.count_if(~F.col("born_digital")).alias("needs_ocr"))
    return forms.unionByName(ragged).unionByName(pages.unpivot([], ["empty_pages", "needs_ocr"], "name", "n"))


def pixmap_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three commonest colours, in 32 steps a channel, of pictures made from the vectors of embeddings.

    Steps are counted in single precision, as the vectors are: a value just under a step counts to it.
    """
    px = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.posexplode("embedding").alias("i", "v")).withColumn("bucket", (F.floor((F.col("v") + F.lit(4).cast("float")) * F.lit(32).cast("float")) / 8).cast("int"))
    n = px.groupBy("vec_id", "bucket").agg(F.count("*").alias("n"))
    r = n.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("n"), F.asc_nulls_last("bucket"))))
    return r.where("place <= 3").select("vec_id", "place", "bucket", "n")


QUERIES = {f.__name__: f for f in (teds, cell_score, reading_order_score, space_glyph_consensus, duplicate_blocks, hardness_consensus, hardness_report, hardest_pages, parser_matrix, invariant_summary, pixmap_colours)}
_FIRED = "SELECT doc_id, page, array_to_string(f, ',') AS fired, CAST(len(f) AS INTEGER) AS consensus FROM (SELECT doc_id, page, list_filter([CASE WHEN sparse THEN 'sparse' END, CASE WHEN fragmented THEN 'fragmented' END, CASE WHEN repeated THEN 'repeated' END, CASE WHEN covered THEN 'covered' END], lambda x: x IS NOT NULL) AS f FROM s)"
SQL = {
    "space_glyph_consensus": "WITH c AS (SELECT doc_id, 'font' || doc_id % 3 AS font, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''), g AS (SELECT doc_id, font, i, c, CAST(CASE WHEN c IN (' ', chr(10)) THEN 3 ELSE ord(c) % 97 + 4 END AS INTEGER) AS gid FROM c) SELECT doc_id, font, gid, count(*) AS n, CAST(sum(CAST((CASE WHEN gid = 3 AND i % 5 = 0 THEN 'x' ELSE c END) IN (' ', chr(10)) AS INTEGER)) AS BIGINT) AS blank FROM g GROUP BY ALL HAVING count(*) >= 5 AND blank >= 0.6 * n",
    "duplicate_blocks": f"""{layout._P}, b AS (SELECT doc_id, page, (page * 2 + col) * 2 + copy AS block, x0 + 4 * copy AS x0, y0 + 3 * copy AS y0, x1 + 4 * copy AS x1, y1 + 3 * copy AS y1, regexp_replace(lower(text), '\\P{{L}}', '', 'g') AS letters
  FROM w_paras, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR doc_id % 3 = 0),
n AS (SELECT doc_id, a.block AS a_block, b.block AS b_block, a.letters AS al, b.letters AS bl FROM b a JOIN b USING (doc_id, page) WHERE a.block < b.block AND {"greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"} >= 0.5 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {"greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"})),
x AS (SELECT doc_id, a_block, b_block, c, sum(m) AS m, sum(k) AS k FROM (SELECT doc_id, a_block, b_block, unnest(string_split(al, '')) AS c, 1 AS m, 0 AS k FROM n UNION ALL SELECT doc_id, a_block, b_block, unnest(string_split(bl, '')), 0, 1 FROM n) WHERE c <> '' GROUP BY ALL)
SELECT doc_id, a_block, b_block FROM x GROUP BY ALL HAVING sum(least(m, k)) >= 0.92 * sum(greatest(m, k))""",
    "hardness_consensus": f"{_SIGNALS} {_FIRED}",
    "hardness_report": f"{_SIGNALS} SELECT signal, CAST(sum(CAST(f AS INTEGER)) AS BIGINT) AS pages FROM (SELECT unnest(['sparse', 'fragmented', 'repeated', 'covered']) AS signal, unnest([sparse, fragmented, repeated, covered]) AS f FROM s) GROUP BY signal",
    "hardest_pages": f"{_SIGNALS} {_FIRED} ORDER BY consensus DESC, doc_id, page LIMIT 10",
    "parser_matrix": r"WITH d AS (SELECT lang, unnest(string_split(regexp_replace(text, '[^\n\x20-\x7e]+', ' ', 'g'), chr(10))) AS gold FROM documents), p AS (SELECT lang, gold, unnest(['whole', 'lower', 'words']) AS parser, unnest([gold, lower(gold), array_to_string(list_reverse(string_split(gold, ' ')), ' ')]) AS t FROM d), s AS (SELECT *, 1 - levenshtein(gold, t)::DOUBLE / greatest(length(gold), length(t), 1) AS score FROM p) SELECT parser, coalesce(lang, 'all') AS doc_type, CAST(round_even(avg(score) * 100000, 0) AS BIGINT) AS score, count(*) AS n FROM s GROUP BY GROUPING SETS ((parser), (parser, lang))",
    "invariant_summary": f"SELECT 'presentation_forms' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'ragged_tables', count(*) FILTER (WHERE k > 1) FROM ({blocks._GRIDS} SELECT doc_id, count(DISTINCT len(cells)) AS k FROM r GROUP BY doc_id) UNION ALL SELECT 'empty_pages', count(*) FILTER (WHERE chars = 0) FROM ({layout.SQL['born_digital_pages']}) UNION ALL SELECT 'needs_ocr', count(*) FILTER (WHERE NOT born_digital) FROM ({layout.SQL['born_digital_pages']})",
    "pixmap_colours": "SELECT vec_id, place, bucket, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, bucket) AS INTEGER) AS place FROM (SELECT vec_id, CAST(trunc(floor((v + 4) * 32) / 8) AS INTEGER) AS bucket, count(*) AS n FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY ALL)) WHERE place <= 3",
}
