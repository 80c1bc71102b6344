"""Queries whose work must grow no faster than their input: same rows as before or as SQL, and no step that blows up."""

import random

from tests.oracle import SMALL, rows_of, sql_rows

from leafwork.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, folder, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def made(n, letters, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_bidi_lines_take_no_row_a_glyph(spark, tmp_path):
    d = documents(spark, tmp_path, [None, "", "(", "a" * 60, "b" * 61, "1(a) z.", *made(80, "abc 12(),.é\n\U0001f600", 200, 1)])
    df = catalog.QUERIES["bidi_line_text"](spark, d)
    assert rows_of(df) == sql_rows(catalog.SQL["bidi_line_text"], d)
    assert "Window" not in plan(df) and "Generate" not in plan(df)


def test_mixed_glyphs_are_as_by_hand():
    import numpy as np

    from leafwork.operators.bidi import logical

    line = lambda t: "".join(map(chr, logical(np.array([ord(c) for c in t], np.uint32), np.array([len(t)])).tolist()))
    assert line("ab (c)") == "ab (c)"
    assert line("ا(ب") == "ب)ا"
    assert line("ا ab cd ب") == "ب ab cd ا"


def test_edits_are_those_of_the_plain_table():
    from leafwork.operators import edits
    from leafwork.operators.score import distance

    for top, letters in ((3, "ab"), (70, "abc é\U0001f600\0"), (300, "ab ")):
        a, b = made(60, letters, top, 2), made(60, letters, top, 3)
        a, b = a + ["", "x", "x" * 64, "x" * 65], b + ["yx", "", "y" * 64, "x" * 64]
        want = [distance(x, y) for x, y in zip(a, b)]
        assert edits.distances(a, b).tolist() == want
        pairs = [(x, y) if len(x) > len(y) else (y, x) for x, y in zip(a, b)]
        assert [edits._alone(x, y) for x, y in pairs] == want
    r = random.Random(4)
    for _ in range(300):
        x = [r.choice("ab") for _ in range(r.randint(2, 50))]
        y = x[:]
        for _ in range(r.randint(1, 3)):
            y.insert(r.randrange(len(y)), y.pop(r.randrange(len(y))))
        unlike = [i for i, (p, q) in enumerate(zip(x, y)) if p != q]
        if unlike:
            assert edits._bounded("".join(x), "".join(y), unlike) == distance(x, y) == edits.distances(["".join(x)], ["".join(y)])[0]


def test_line_scores_build_no_table_a_pair(spark, tmp_path):
    d = documents(spark, tmp_path, [None, "", "\n", "a\n\nb", "Ab é\nab", "A" * 3000 + "\n" + "a" * 2900, *made(60, "abC é\n ", 90, 5)])
    for name in ("edit_score", "parser_matrix"):
        df = catalog.QUERIES[name](spark, d)
        assert rows_of(df) == sql_rows(catalog.SQL[name], d)
        assert "levenshtein" not in plan(df)


def test_text_repair_takes_no_value_a_character(spark, tmp_path):
    d = documents(spark, tmp_path, [None, "", "(2) abc, 12.", "?abc", ". abc 12.", ".! ab", *made(80, "abcdABCD 12(),.é\n", 120, 6)])
    for name in ("normalize_text", "orientation_score", "deshape", "reverse_runs"):
        assert rows_of(catalog.QUERIES[name](spark, d)) == sql_rows(catalog.SQL[name], d), name
    for name in ("normalize_text", "orientation_score"):
        assert "transform(" not in plan(catalog.QUERIES[name](spark, d)), name


def test_repair_of_odd_texts(spark):
    from pyspark.sql import functions as F

    from leafwork.functions import repair
    from leafwork.functions import script as S

    texts = ["ﻵﻻ ab", "  x 　", "a​b", "²Ⅷ", "\U0001f600 ا", *made(100, "اله(]12. -ﻟﻻـَ \x1cab", 25, 7)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select(t, S.deshape(t).alias("d"), S.is_arabic(t).alias("a"), S.orientation(t).alias("o"), S.reverse_runs(t).alias("r"), S.strip(t).alias("s")).collect():
        x = r["t"]
        assert (r["d"], r["a"], r["o"], r["r"], r["s"]) == (repair.deshape(x), repair.is_arabic(x), repair.orientation(x), repair.reverse_runs(x), repair.strip(x)), repr(x)


def test_colours_are_counted_in_single_precision(spark, tmp_path):
    rows = [(1, [-1e-8, 0.0, 0.25, -1e-8, 3.9999999]), (2, [0.2499999999, -4.0000001, -4.5]), (3, []), (4, None), (5, [None, 0.1])]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = rows_of(catalog.QUERIES["pixmap_colours"](spark, str(tmp_path))), sql_rows(catalog.SQL["pixmap_colours"], str(tmp_path))
    assert got == want and len(got[1]) > 4


def exchanges(df):
    return [x for x in plan(df).split("\n") if "Exchange" in x and "Broadcast" not in x and "Reused" not in x]


def test_words_and_lines_shuffle_documents_only(spark, tmp_path):
    d = documents(spark, tmp_path, [None, "", " \n ", "a", "a b c d e f", "a b c d e f g", *made(40, "ab é\n😀", 9000, 8)])
    for name in ("flow_paragraphs", "page_html", "born_digital_pages", "flow_spans_anti", "span_owner", "hardness_consensus", "hardness_report", "duplicate_blocks", "line_owner", "figure_captions"):
        assert rows_of(catalog.QUERIES[name](spark, d)) == sql_rows(catalog.SQL[name], d), name
    for name, most in (("flow_paragraphs", 1), ("page_html", 1), ("flow_spans_anti", 2), ("span_owner", 2)):
        assert len(exchanges(catalog.QUERIES[name](spark, d))) <= most, name


def orders(spark, folder, lines, seed=9):
    """Lineitems of orders of the given numbers of lines; some cells unknown."""
    r = random.Random(seed)
    rows = [(o * 3 - 7, r.randint(1, 9), r.randint(1, 9), k % 5, float(r.randint(1, 50)), r.random() * 10 ** r.randint(0, 6), r.randint(0, 10) / 100, r.randint(0, 8) / 100, r.choice("ANR"), r.choice("FO")) for o, n in enumerate(lines) for k in range(n)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    seen = {}
    rows = [seen.setdefault(x[:4], x) for x in rows]
    spark.createDataFrame([x for x in seen.values()], names).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_tables_shuffle_lines_once(spark, tmp_path):
    d = orders(spark, tmp_path, [1, 2, 3, 4, 17, 40, *[random.Random(10).randint(1, 9) for _ in range(60)]])
    documents(spark, tmp_path, ["a b c", None, "x" * 70])
    for name in ("column_votes", "borderless_fill", "ruled_table_cells", "tables_to_pipes", "table_markdown", "table_grid", "table_bands", "numeric_cells", "invariant_summary"):
        df = catalog.QUERIES[name](spark, d)
        assert rows_of(df) == sql_rows(catalog.SQL[name], d), name
        if name in ("column_votes", "borderless_fill", "ruled_table_cells", "tables_to_pipes"):
            df = catalog.QUERIES[name](spark, d)
            assert len(exchanges(df)) == 1 and "Window" not in plan(df), name


def test_distances_that_need_no_table_are_those_of_the_table():
    from leafwork.operators import score

    r, told = random.Random(11), 0
    for _ in range(1500):
        g = [["".join(r.choice("ab1 ") for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 3))] for _ in range(r.randint(0, 4))]
        f = [list(x) for x in g[: r.randint(0, len(g))]]
        for _ in range(r.randint(0, 3)):
            if f and (row := r.choice(f)):
                row[r.randrange(len(row))] = r.choice(["?", "?!", " ", "", "?a", "b"])
        if r.random() < 0.5:
            f, g = g, f
        want = score.tree_distance(score.table_tree(f), score.table_tree(g))[0]
        got = score._plain_distance(f, g)
        told += got is not None
        assert got is None or abs(got - want) < 1e-9, (f, g, got, want)
        assert score._structure(tuple(map(len, f)), tuple(map(len, g))) == score.tree_distance(score.table_tree(f), score.table_tree(g), True)[0]
    assert told > 300


def test_lines_of_many_pages_are_those_of_each():
    import numpy as np

    from leafwork.operators import order

    r = np.random.default_rng(12)
    n = r.integers(1, 30, 60)
    pages = np.append(0, np.cumsum(n))
    y, size = r.integers(0, 60, pages[-1]) * r.choice([0.5, 3.0], pages[-1]), r.choice([1.0, 8.0, 12.0], pages[-1])
    y[: pages[20]] = r.integers(0, 9, pages[20]) * 18
    for factor in (0.5, 2.0):
        want = np.concatenate([order.group_lines(y[a:b], size[a:b], factor) for a, b in zip(pages, pages[1:])])
        assert (order._lines_of(y, size, pages, factor) == want).all()


def test_pages_cut_between_batches_stay_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    from leafwork.operators import order
    from leafwork.sources import derived as D

    d = documents(spark, tmp_path, [None, "a", *made(30, "ab \n", 9000, 13)])
    w = D.words(spark, d)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sorted(map(tuple, order.span_lines(w, together=True).collect()))
        assert got == sorted(map(tuple, order.span_lines(w.orderBy(F.rand(1))).collect())) and got
        assert got == sorted((x["doc_id"], x["page"], x["seq"], x["line"] % 40) for x in w.collect())
        boxes = w.select("doc_id", "page", "seq", "x0", "y0", "x1", "y1")
        places = {(x["doc_id"], x["page"], x["seq"]): x["place"] for x in order.xy_cut(boxes).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import numpy as np
    by = {}
    for x in sorted(map(tuple, boxes.collect())):
        by.setdefault(x[:2], []).append(x[2:])
    want = {(*k, rows[i][0]): place for k, rows in by.items() for place, i in enumerate(order.cut_order(np.array([q[1:] for q in rows])))}
    assert places == want
    assert "applyInPandas" not in plan(order.xy_cut(boxes)) and "FlatMapGroups" not in plan(order.xy_cut(boxes))


def test_pages_with_known_boxes_have_the_tables_of_each():
    import numpy as np

    from leafwork.operators import tables

    r = np.random.default_rng(14)
    none, one = np.zeros((0, 4)), tables.Detector(842.0)
    words = ["1", "22", "33.5", "ab", "x" * 20, "7" * 20, "Total:", "one two three four five six:", "Table 3", "table", "3 of", "—"]
    for _ in range(300):
        lines, columns = int(r.integers(1, 9)), int(r.integers(2, 5))
        text = [words[r.integers(0, 4 if r.random() < 0.9 else len(words))] for _ in range(lines * columns)]
        y = np.repeat(np.cumsum(r.choice([16, 16, 16, 70], lines)), columns) + 0.0
        x = np.tile(np.arange(columns) * 100.0, lines)
        box = np.stack([x, y, x + 50, y + 10], 1)
        want = [(t.score, t.grid) for t in tables.best_borderless(tables.Spans(text, box), none, none, 842.0)]
        assert one.grids(text, box) == want == one.grids(text, box)
    assert one.kept


def test_detectors_make_no_data_frame_a_page(spark, tmp_path):
    d = orders(spark, tmp_path, [1, 2, 3, 4, 17, *[random.Random(15).randint(1, 9) for _ in range(60)]])
    spark.read.parquet(f"{SMALL}/part.parquet").write.parquet(f"{d}/part.parquet")
    for name in ("borderless_tables", "definition_tables"):
        assert rows_of(catalog.QUERIES[name](spark, d)) == sql_rows(catalog.SQL[name], d), name
        assert "InPandas" not in plan(catalog.QUERIES[name](spark, d)), name


def test_ink_of_lines_is_that_of_boxes():
    import numpy as np

    from leafwork.operators import order

    r = np.random.default_rng(16)
    for k in range(300):
        n = int(r.integers(1, 60))
        x, y = r.uniform(-5 if k % 5 == 0 else 0, 640, n), r.integers(0, 50, n) * (18.0 if k % 2 else 7.3)
        b = np.stack([x, y, x + r.uniform(0, 90, n), y + r.choice([12.0, 9.5], n)], 1)
        want, got = np.zeros((2, 211, 298), bool)
        for x0, y0, x1, y1 in b:
            want[max(0, int(y0 / 4)) : int(y1 / 4) + 1, max(0, int(x0 / 2)) : int(x1 / 2) + 1] = True
        order._paint(got, b)
        assert (got == want).all()


def test_gutters_and_duplicates_make_no_row_a_letter(spark, tmp_path):
    import numpy as np

    from leafwork.operators import order
    from leafwork.sources import derived as D

    d = documents(spark, tmp_path, [None, "a", *made(30, "abc  \n", 9000, 17)])
    by = {}
    for x in sorted(map(tuple, D.words(spark, d).select("doc_id", "page", "seq", "x0", "y0", "x1", "y1").collect())):
        by.setdefault(x[:2], []).append(x[3:])
    q = catalog.QUERIES["page_gutters"](spark, d)
    assert {(x["doc_id"], x["page"]): x["boundaries"] for x in q.collect()} == {k: order.find_gutters(np.array(v), 595.0, 842.0) for k, v in by.items()}
    assert "InPandas" not in plan(q)
    q = catalog.QUERIES["duplicate_blocks"](spark, d)
    assert rows_of(q) == sql_rows(catalog.SQL["duplicate_blocks"], d)
    assert "split(" not in plan(q).replace("split(text", "") and "FullOuter" not in plan(q)
