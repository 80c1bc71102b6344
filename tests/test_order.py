import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafwork.operators import order, score


def test_two_columns_have_one_gutter():
    boxes = np.array([[x, y, x + 200, y + 10] for x in (40, 320) for y in range(60, 400, 14)], float)
    cuts = order.find_gutters(boxes, 595, 842)
    assert len(cuts) == 3 and 240 < cuts[1] < 320


def test_no_boxes_and_one_column():
    assert order.find_gutters(np.zeros((0, 4)), 595, 842) == [0.0, 595]
    assert len(order.find_gutters(np.array([[40, y, 500, y + 10] for y in range(60, 300, 14)], float), 595, 842)) == 2


def test_cut_reads_columns_then_lines():
    boxes = np.array([[300, 50, 500, 300], [40, 50, 250, 100], [40, 130, 250, 300]], float)
    assert order.cut_order(boxes) == [1, 2, 0]
    assert order.cut_order(boxes, rtl=True) == [0, 1, 2]


def test_gap_of_fourteen_is_enough():
    two = lambda gap: np.array([[100, 0, 110, 10], [110 + gap - 100, 0, 10 + gap, 10]], float)
    assert order.cut_order(two(14)) in ([0, 1], [1, 0])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 700), st.integers(1, 90), st.integers(1, 90)), max_size=12))
def test_cut_order_is_a_permutation(raw):
    boxes = np.array([[x, y, x + w, y + h] for x, y, w, h in raw], float).reshape(-1, 4)
    assert sorted(order.cut_order(boxes)) == list(range(len(boxes)))


def test_lines_follow_the_running_mean():
    assert order.group_lines(np.array([10.0, 14, 18, 40]), np.full(4, 10.0)).tolist() == [0, 0, 1, 2]


GRID = [["p", "q"], ["r", "s"]]


def test_teds_published_cases():
    tree = score.table_tree
    assert score.teds(tree(GRID), tree(GRID)) == 1.0
    assert abs(score.teds(tree([["p", "q"], ["r", "x"]]), tree(GRID)) - (1 - 1 / 7)) < 1e-9
    assert abs(score.teds(tree(GRID[:1]), tree(GRID)) - (1 - 3 / 7)) < 1e-9
    assert score.teds(tree(GRID[:1]), tree(GRID)) == score.teds(tree(GRID), tree(GRID[:1]))
    assert score.teds(tree([["x", "y"], ["z", "w"]]), tree(GRID), structure_only=True) == 1.0
    assert score.teds(score.html_tree("<table></table>"), tree([])) == 1.0


def test_teds_ignores_space_at_the_ends_of_cells_and_later_tables():
    assert score.teds(score.table_tree([["a ", "b"]]), score.table_tree([["a", " b"]])) == 1.0
    two = score.html_tree("<table><tr><td> a\n</td></tr></table><p>x</p><table><tr><td>b</td></tr></table>")
    assert len(two.children) == 1 and score.teds(two, score.table_tree([["a"]])) == 1.0


def test_teds_of_html():
    plain = score.html_tree("<table><tr><td>a</td><td>b</td></tr></table>")
    wrapped = score.html_tree("<table><thead><tr><th>a</th><th>b</th></tr></thead></table>")
    wide, wider = (score.html_tree(f"<table><tr><td colspan='{n}'>a</td></tr></table>") for n in (2, 3))
    assert score.teds(plain, wrapped) == 1.0
    assert score.teds(wide, wider) < 1


def test_order_and_cells():
    gold = ["alpha beta", "gamma delta", "epsilon zeta"]
    assert score.reading_order(gold, gold) == 1.0
    assert score.reading_order(gold[:2], gold) == 1 - 1 / 3
    assert score.reading_order([], []) == 1.0
    assert score.cell_score(GRID[:1], GRID) == 0.5
    assert score.edit_similarity("", "") == 1.0


def test_teds_of_many_is_teds_of_each():
    rng = np.random.default_rng(19)
    text = lambda: "".join(rng.choice(list("ab1.é"), rng.integers(0, 5)))
    grid = lambda: [[text() for _ in range(rng.integers(1, 4))] for _ in range(rng.integers(0, 4))]
    found, gold = [grid() for _ in range(150)], [grid() for _ in range(150)]
    found[:10] = gold[:10]
    for structure in (False, True):
        want = [score.teds(score.table_tree(f), score.table_tree(g), structure) for f, g in zip(found, gold)]
        assert np.abs(score.teds_of(found, gold, structure, most=7) - want).max() < 1e-12
    a, b = [text() for _ in range(300)] + ["", "x" * 50], [text() for _ in range(300)] + ["yx", "x" * 48]
    assert score.distances(a, b).tolist() == [score.distance(x, y) for x, y in zip(a, b)]


def test_claimed_is_best_of_all_left():
    rng = np.random.default_rng(20)
    text = lambda: "".join(rng.choice(list("ab "), rng.integers(0, 4)))
    for _ in range(100):
        pred, gold = [text() for _ in range(rng.integers(0, 7))], [text() for _ in range(rng.integers(0, 7))]
        left, want = set(range(len(gold))), []
        for p in pred:
            best = max(((score.edit_similarity(p, gold[g]), -g) for g in left), default=(0.0, 0))
            want.append(-best[1] if best[0] > 0.5 else -1)
            left.discard(want[-1])
        assert score.claimed(pred, gold, 0.5) == want


def test_scores_are_of_all_tables_and_documents(spark, tmp_path):
    from pyspark.sql import functions as F
    from tests.oracle import SMALL

    from leafwork.plans import blocks, quality

    for name, key, most in (("lineitem", "l_orderkey", 60), ("documents", "doc_id", 30)):
        spark.read.parquet(f"{SMALL}/{name}.parquet").where(F.col(key) <= most).write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    grids = {r["doc_id"]: [list(x) for x in r["grid"]] for r in blocks._grids(spark, d).collect()}
    pred = {}
    for i, g in grids.items():
        p = [list(r) for r in (g[:-1] if i % 2 else g)]
        if i % 3 == 0 and p:
            p[0][0] = "?"
        pred[i] = p
    tree, micro = score.table_tree, lambda x: round(x * 1_000_000)
    got = {r["doc_id"]: (r["teds"], r["structure"]) for r in quality.teds(spark, d).collect()}
    assert got == {i: tuple(micro(score.teds(tree(pred[i]), tree(g), only)) for only in (False, True)) for i, g in grids.items()} and len(got) > 10
    assert {r["doc_id"]: r["cells"] for r in quality.cell_score(spark, d).collect()} == {i: micro(score.cell_score(pred[i], g)) for i, g in grids.items()}
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        gold = [x for x in (r["text"] or "").split("\n") if x]
        turned = gold[::-1] if r["doc_id"] % 3 == 0 else gold[1:] if r["doc_id"] % 3 == 1 and len(gold) > 1 else gold
        want[r["doc_id"]] = micro(score.reading_order(turned, gold))
    assert {r["doc_id"]: r["order"] for r in quality.reading_order_score(spark, d).collect()} == want and len(want) > 10
