"""Queries over text: right-to-left repair, predicates, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafwork.functions import script as S
from leafwork.operators.bidi import bidi_lines
from leafwork.operators.edits import next_line_scores
from leafwork.sources import derived as D


def _t() -> F.Column:
    return F.col("text")


def is_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.arabic(spark, sf_dir).select("doc_id", S.is_arabic(_t()).alias("arabic"), S.has_forms(_t()).alias("forms"))


def deshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.arabic(spark, sf_dir).select("doc_id", S.deshape(_t()).alias("text"))


def orientation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.arabic(spark, sf_dir).select("doc_id", S.orientations(_t()).alias("o")).select("doc_id", "o.*")


def reverse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.arabic(spark, sf_dir).select("doc_id", S.reverse_runs(_t()).alias("text"))


def digit_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.concat(F.translate(F.col("n_chars").cast("string"), "0123456789", S.EASTERN[:10]), F.lit("-"), F.translate(F.col("doc_id").cast("string"), "0123456789", S.EASTERN[10:]))
    return D.table(spark, sf_dir, "documents").select("doc_id", mixed.alias("raw"), S.fold_digits(mixed).alias("folded"))


def mirror_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("("), "text", F.lit(")[x]{<y>}«")).alias("raw"))
    return d.select("doc_id", F.translate("raw", S.FRONT, S.BACK).alias("mirrored"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.arabic(spark, sf_dir).select("doc_id", S.normalize(_t(), western_digits=True).alias("n")).select("doc_id", "n.*")


def _map_sql() -> str:
    return "MAP {" + ", ".join(f"'{a}': '{b.replace(chr(39), chr(39) * 2)}'" for a, b in S.FORMS.items()) + "}"


def _deshape_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[\\x{{fb50}}-\\x{{fdff}}\\x{{fe70}}-\\x{{feff}}]') THEN array_to_string(list_transform(string_split({c}, ''), lambda ch: coalesce(m[ch], ch)), '') ELSE {c} END"


_MAP = f"fm AS (SELECT {_map_sql()} AS m)"


def _is_arabic_sql(c: str) -> str:
    hits = f"len(regexp_extract_all(regexp_replace({c}, '[\\x{{064b}}-\\x{{065f}}\\x{{0660}}-\\x{{066d}}\\x{{0670}}\\x{{060c}}\\x{{061b}}\\x{{061f}}]', '', 'g'), '[\\x{{0600}}-\\x{{06ff}}\\x{{0750}}-\\x{{077f}}\\x{{fb50}}-\\x{{fdff}}\\x{{fe70}}-\\x{{fefc}}]'))"
    return f"(len(regexp_extract_all({c}, '\\p{{L}}')) > 0 AND {hits} >= 0.25 * len(regexp_extract_all({c}, '\\p{{L}}')))"


def _reverse_sql(c: str) -> str:
    return f"translate(array_to_string(list_reverse(regexp_extract_all({c}, '(?s)[0-9A-Za-z][-/:,.0-9A-Za-z]*|.')), ''), '{S.FRONT}', '{S.BACK}')"


def _orientation_sql(c: str) -> str:
    words = ", ".join(f"'{w}'" for w in S.FREQUENT)
    one = f"(CASE WHEN list_contains([{words}], w) THEN 3 ELSE 0 END) + (CASE WHEN length(w) > 3 AND starts_with(w, 'ال') THEN 1 ELSE 0 END) - (CASE WHEN length(w) > 3 AND ends_with(w, 'لا') THEN 1 ELSE 0 END)"
    tokens = f"list_transform(regexp_extract_all({c}, '[\\x{{0600}}-\\x{{06ff}}\\x{{0750}}-\\x{{077f}}]+'), lambda t: regexp_replace(t, '[\\x{{064b}}-\\x{{0652}}\\x{{0670}}\\x{{0640}}]', '', 'g'))"
    return f"CAST(coalesce(list_sum(list_transform({tokens}, lambda w: {one})), 0) AS INTEGER)"


_W = r"[\s\x{a0}]"


def _punctuation_sql(c: str) -> str:
    """Two common table expressions, p1 and p2, from rows of ``c``."""
    lead, tail = r"(?s)^([?؟!:؛،.]+)\s*(.+)$", r"(?s)^\.\s*(.*?)([\x{0660}-\x{0669}0-9]{1,2})\.?$"
    t = f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"
    strip = lambda x: f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"
    a, b = f"regexp_extract(t, '{lead}', 1)", f"regexp_extract(t, '{lead}', 2)"
    d, e = f"regexp_extract(t, '{tail}', 1)", f"regexp_extract(t, '{tail}', 2)"
    return f"""p0 AS (SELECT *, {t} AS t FROM base),
p1 AS (SELECT * EXCLUDE (t), CASE WHEN {a} <> '' AND {_is_arabic_sql(b)} THEN {strip(b)} || {a} ELSE t END AS t FROM p0),
p2 AS (SELECT * EXCLUDE (t), CASE WHEN {e} <> '' AND {_is_arabic_sql(d)} THEN {e} || '. ' || {strip(d)} || '.' ELSE t END AS t FROM p1)"""


_NORMALIZE = f"""WITH {D.ARABIC}, {_MAP}, pr AS (SELECT doc_id, text, regexp_matches(text, '[\\x{{fb50}}-\\x{{fdff}}\\x{{fe70}}-\\x{{feff}}]') AS had_forms, {_deshape_sql("text")} AS probe FROM w_arabic, fm),
rv AS (SELECT *, {_is_arabic_sql("probe")} AND {_orientation_sql(_reverse_sql("probe"))} > {_orientation_sql("probe")} AS was_reversed FROM pr),
fl AS (SELECT *, CASE WHEN was_reversed THEN {_reverse_sql("text")} ELSE text END AS f FROM rv),
base AS (SELECT doc_id, had_forms, was_reversed, {_deshape_sql("f")} AS s FROM fl, fm), {_punctuation_sql("s")}
SELECT doc_id, had_forms, was_reversed, trim(regexp_replace(translate(replace(t, chr(1600), ''), '{S.EASTERN}', '01234567890123456789'), '[ \\t\\x{{a0}}]+', ' ', 'g')) AS text FROM p2"""


def numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.grid(spark, sf_dir)
    odd = F.when(F.col("rank") == 7, F.lit("—")).when((F.col("c") == 0) & (F.col("rank") == 6), F.lit("$")).otherwise(_t())
    return g.select("doc_id", "seq", S.numeric_cell(odd).alias("numeric"))


def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    made = F.array(F.concat(F.lit("("), (n % 120).cast("string"), F.lit(")")), F.concat((n % 2000).cast("string"), F.lit(".")), F.concat(F.substring("text", 1, 1), F.lit(")")), F.substring("text", 1, 2), F.lit("•"), F.concat((n % 90).cast("string"), F.lit("-"), (n % 7).cast("string")))
    return d.select("doc_id", F.posexplode(made).alias("i", "label")).select("doc_id", "i", "label", S.list_marker(F.col("label")).alias("marker"))


def chip_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array((F.col("n_chars") % 3000).cast("string"), F.translate((F.col("doc_id") % 200).cast("string"), "0123456789", S.EASTERN[:10]), F.lit("x1"))).alias("label"))
    return d.select("doc_id", "label", S.chip_number(F.col("label")).alias("number"))


def bidi_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sixty glyphs in logical order.

    Glyphs stand 5 points apart by place, words 6 more. A line without a right-to-left glyph reads by rising place. Else it
    reads by falling place, runs of left-to-right glyphs within it read rising, and brackets outside of them are mirrored. A
    neutral belongs to such a run if the nearest strong glyphs on both sides do.
    """
    return bidi_lines(D.arabic(spark, sf_dir))


_BIDI = f"""WITH {D.ARABIC}, ch AS (SELECT *, x // 60 AS no FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, '')))) AS x FROM w_arabic WHERE text <> '')),
g AS (SELECT *, CASE WHEN regexp_matches(c, '[\\x{{0590}}-\\x{{08ff}}\\x{{fb1d}}-\\x{{fdff}}\\x{{fe70}}-\\x{{feff}}]') THEN 'R' WHEN regexp_matches(c, '[A-Za-z\\x{{c0}}-\\x{{024f}}0-9]') THEN 'L' ELSE 'N' END AS k FROM ch),
h AS (SELECT *, max(k = 'R') OVER (PARTITION BY doc_id, no) AS rtl, last_value(nullif(k, 'N') IGNORE NULLS) OVER (PARTITION BY doc_id, no ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS b,
  first_value(nullif(k, 'N') IGNORE NULLS) OVER (PARTITION BY doc_id, no ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM g),
r AS (SELECT *, CASE WHEN k <> 'N' THEN k WHEN b = 'L' AND a = 'L' THEN 'L' ELSE 'R' END AS r FROM h),
i AS (SELECT *, CASE WHEN lag(r) OVER (PARTITION BY doc_id, no ORDER BY x DESC) <> r THEN 1 ELSE 0 END AS br FROM r),
n AS (SELECT *, sum(br) OVER (PARTITION BY doc_id, no ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS run FROM i)
SELECT doc_id, no, string_agg(CASE WHEN rtl AND r = 'R' THEN translate(c, '{S.FRONT}', '{S.BACK}') ELSE c END, '' ORDER BY CASE WHEN rtl THEN run ELSE 0 END, CASE WHEN rtl AND r = 'R' THEN -x ELSE x END) AS line FROM n GROUP BY doc_id, no"""


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each document and of the one after it, with counts on either side."""
    d = D.table(spark, sf_dir, "documents")
    letters = d.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}"), F.lit(0))).alias("c")).groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    other = letters.select((F.col("doc_id") - 1).alias("doc_id"), "c", F.col("n").alias("m"))
    ids = d.select("doc_id").join(d.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id", "left_semi")
    return letters.join(other, ["doc_id", "c"], "full").join(ids, "doc_id", "left_semi").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


_BAGS = r"""l AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}')) AS c FROM documents) GROUP BY ALL),
bags AS (SELECT coalesce(a.doc_id, b.doc_id - 1) AS doc_id, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS m FROM l a FULL JOIN l b ON b.doc_id - 1 = a.doc_id AND a.c = b.c
  WHERE coalesce(a.doc_id, b.doc_id - 1) IN (SELECT doc_id FROM documents) AND coalesce(a.doc_id, b.doc_id - 1) + 1 IN (SELECT doc_id FROM documents))"""


def letter_bag_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bags(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.least("n", "m")).alias("both"), F.sum(F.greatest("n", "m")).alias("any"))
    return b.select("doc_id", F.rint(F.col("both") / F.col("any") * 1_000_000).cast("long").alias("millionths"))


def coverage_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bags(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.least("n", "m")).alias("kept"), F.sum(F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("extra"), F.sum("n").alias("source")).where("source > 0")
    share = lambda c: F.rint(F.col(c) / F.col("source") * 1_000_000).cast("long")
    return b.select("doc_id", share("kept").alias("coverage"), share("extra").alias("excess"))


def edit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness by edits of each line and the one after it, in ASCII, in millionths."""
    return next_line_scores(D.ascii_documents(spark, sf_dir, "doc_id"))


def repeated_span_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span whose words repeat a shorter run of words becomes as many spans of equal width."""
    p = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.col("p_type"), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("text"), (F.col("p_size") * 4.0).alias("width"))
    w = F.split("text", " ")
    p = p.withColumn("w", w).withColumn("n", F.size(w))
    period = lambda k: (F.col("n") % k == 0) & (F.array_join(F.flatten(F.array_repeat(F.slice("w", 1, k), (F.col("n") / k).cast("int"))), " ") == F.col("text"))
    k = F.array_min(F.filter(F.sequence(F.lit(1), F.col("n")), period))
    p = p.withColumn("k", k).withColumn("times", (F.col("n") / F.col("k")).cast("int"))
    return p.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("i"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("text"), (F.col("width") / F.col("times")).alias("width"))


_SPLIT = """WITH p AS (SELECT p_partkey AS doc_id, rtrim(repeat(p_type || ' ', CAST(p_partkey % 4 + 1 AS INTEGER))) AS text, p_size * 4.0::DOUBLE AS width FROM part),
w AS (SELECT *, string_split(text, ' ') AS w FROM p), k AS (SELECT *, list_min(list_filter(range(1, len(w) + 1), lambda k: len(w) % k = 0 AND rtrim(repeat(array_to_string(w[1:k], ' ') || ' ', len(w) // k)) = text)) AS k FROM w)
SELECT doc_id, CAST(unnest(range(len(w) // k)) AS INTEGER) AS i, array_to_string(w[1:k], ' ') AS text, width / (len(w) // k) AS width FROM k"""


QUERIES = {f.__name__: f for f in (is_arabic, deshape, orientation_score, reverse_runs, digit_folding, mirror_brackets, normalize_text, numeric_cells, list_markers, chip_numbers, bidi_line_text, letter_bag_jaccard, coverage_excess, edit_score, repeated_span_split)}
_NUM = r"regexp_matches(t, '^[-—–+,.()%¥£€$٠-٩۰-۹0-9\s]+$') AND (regexp_matches(t, '[0-9٠-٩۰-۹]') OR contains('$€£¥%—–-', t))"
SQL = {
    "is_arabic": f"WITH {D.ARABIC} SELECT doc_id, {_is_arabic_sql('text')} AS arabic, regexp_matches(text, '[\\x{{fb50}}-\\x{{fdff}}\\x{{fe70}}-\\x{{feff}}]') AS forms FROM w_arabic",
    "deshape": f"WITH {D.ARABIC}, {_MAP} SELECT doc_id, {_deshape_sql('text')} AS text FROM w_arabic, fm",
    "orientation_score": f"WITH {D.ARABIC}, {_MAP}, d AS (SELECT doc_id, {_deshape_sql('text')} AS t FROM w_arabic, fm) SELECT doc_id, {_orientation_sql('t')} AS forward, {_orientation_sql(_reverse_sql('t'))} AS backward FROM d",
    "reverse_runs": f"WITH {D.ARABIC} SELECT doc_id, {_reverse_sql('text')} AS text FROM w_arabic",
    "digit_folding": f"SELECT doc_id, translate(CAST(n_chars AS VARCHAR), '0123456789', '{S.EASTERN[:10]}') || '-' || translate(CAST(doc_id AS VARCHAR), '0123456789', '{S.EASTERN[10:]}') AS raw, n_chars || '-' || doc_id AS folded FROM documents",
    "mirror_brackets": f"SELECT doc_id, translate('(' || text || ')[x]{{<y>}}«', '{S.FRONT}', '{S.BACK}') AS mirrored FROM documents",
    "normalize_text": _NORMALIZE,
    "numeric_cells": f"WITH {D.GRID} SELECT doc_id, seq, t <> '' AND {_NUM} AS numeric FROM (SELECT doc_id, seq, trim(CASE WHEN rank = 7 THEN '—' WHEN c = 0 AND rank = 6 THEN '$' ELSE text END) AS t FROM w_grid)",
    "list_markers": r"SELECT doc_id, i, label, regexp_matches(regexp_replace(label, '^\s+|\s+$', '', 'g'), '^[-*oO—–·∙▫▪○●◦‣•]$|^\(?[0-9]{1,3}(?:[).]|[—–-][0-9]{1,3})?$|^\(?[A-Za-z][).]$') AS marker FROM (SELECT doc_id, CAST(unnest(range(6)) AS INTEGER) AS i, unnest(['(' || doc_id % 120 || ')', doc_id % 2000 || '.', substr(text, 1, 1) || ')', substr(text, 1, 2), '•', doc_id % 90 || '-' || doc_id % 7]) AS label FROM documents)",
    "chip_numbers": f"SELECT doc_id, label, CASE WHEN regexp_matches(label, '^[0-9٠-٩۰-۹\\s]{{1,3}}$') THEN TRY_CAST(trim(translate(label, '{S.EASTERN}', '01234567890123456789')) AS INTEGER) END AS number FROM (SELECT doc_id, unnest([CAST(n_chars % 3000 AS VARCHAR), translate(CAST(doc_id % 200 AS VARCHAR), '0123456789', '{S.EASTERN[:10]}'), 'x1']) AS label FROM documents)",
    "bidi_line_text": _BIDI,
    "letter_bag_jaccard": f"WITH {_BAGS} SELECT doc_id, CAST(round_even(sum(least(n, m))::DOUBLE / sum(greatest(n, m)) * 1000000, 0) AS BIGINT) AS millionths FROM bags GROUP BY doc_id",
    "coverage_excess": f"WITH {_BAGS} SELECT doc_id, CAST(round_even(sum(least(n, m))::DOUBLE / sum(n) * 1000000, 0) AS BIGINT) AS coverage, CAST(round_even(sum(greatest(m - n, 0))::DOUBLE / sum(n) * 1000000, 0) AS BIGINT) AS excess FROM bags GROUP BY doc_id HAVING sum(n) > 0",
    "edit_score": r"WITH d AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS i, unnest(s) AS a FROM (SELECT doc_id, string_split(regexp_replace(text, '[^\n\x20-\x7e]+', ' ', 'g'), chr(10)) AS s FROM documents)), j AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM d) SELECT doc_id, i, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1000000 ELSE CAST(round_even((1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) * 1000000, 0) AS BIGINT) END AS millionths FROM j WHERE b IS NOT NULL",
    "repeated_span_split": _SPLIT,
}
