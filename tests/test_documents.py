"""Parsed documents, chunks and layout rules beyond what the queries show."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from papyra.operators import chunking, documents, outline, solver


def blocks_of(raw):
    return documents.page_blocks(json.dumps(raw), 0)


def test_nested_blocks_are_in_reading_order():
    raw = {"blocks": [{"id": "a", "type": "list", "blocks": [{"id": "b", "text": "1", "children": [{"id": "c", "text": "2"}]}, {"id": "d", "text": "3"}]}, {"text": "4"}]}
    got = blocks_of(raw)["blocks"]
    assert [(b["id"], b["parent_id"], b["order"]) for b in got] == [("a", "", 0), ("b", "a", 1), ("c", "b", 2), ("d", "a", 3), ("p1-b4", "", 4)]


@pytest.mark.parametrize("raw,page", [({"page_idx": 4}, 5), ({"page_index": "2"}, 3), ({"page_no": 7}, 7), ({"page": "x"}, 1), ({}, 1), ({"page_idx": None}, 1)])
def test_page_numbers(raw, page):
    assert blocks_of(raw)["page"] == page


@pytest.mark.parametrize("box,want", [([3, 4, 1, 2], [1, 2, 3, 4]), ({"x0": 0, "top": 1, "x1": "5", "bottom": 9}, [0, 1, 5, 9]), ([1, 2, 3], None), ([1, 2, 3, "z"], None), (None, None), ([1, 2, 3, float("inf")], None)])
def test_corners(box, want):
    assert documents._corners(box) == want


def test_very_deep_documents():
    raw = {"text": "leaf"}
    for _ in range(400):
        raw = {"type": "list", "blocks": [raw]}
    assert len(blocks_of({"blocks": [raw]})["blocks"]) == 401


def test_projection_refuses_double_ids(spark):
    rows = spark.createDataFrame([(1, 0, 9.0, 9.0, i, "same", "text", "t", [0.0, 0.0, 5.0, 5.0], True) for i in range(2)], "doc int, place int, width double, height double, `order` int, id string, type string, text string, bbox array<double>, translatable boolean")
    with pytest.raises(Exception, match="own id or box"):
        documents.projected(rows, "doc").collect()


def test_unsafe_archives(spark):
    rows = [(1, 0, "../x", False, 1), (2, 0, "a/b.txt", False, 1), (2, 1, "a/B.TXT", False, 1), (2, 2, "a/" + "n" * 300 + ".txt", False, 1), (3, 0, "x", False, 10)]
    got = {(r.a, r.i): (r.relative_path, r.error) for r in documents.extraction_plan(spark.createDataFrame(rows, "a int, i int, name string, directory boolean, size long"), "a", "i", most_bytes=9).collect()}
    assert got[1, 0] == (None, "unsafe path") and got[3, 0] == (None, "too many bytes")
    assert got[2, 0] == ("b.txt", None) and got[2, 1] == ("B (2).TXT", None) and len(got[2, 2][0]) <= 220


def record(kind, text, start=None, stop=None):
    return SimpleNamespace(type=kind, text=text, start=start, stop=stop)


def test_chunks_of_a_document():
    r = [record("title", "T"), record("text", "a" * 1500 + "."), record("text", "b" * 900), record("text", "c" * 900 + "."), record("image_caption", "d" * 100), record("table_cells", "e" * 100)]
    got = chunking.chunked(r, False)
    # the second body record would run over; the third goes on with its sentence
    assert [[x.text[0] for x in g] for g in got] == [["T"], ["a", "b", "c"], ["d", "e"]] or [[x.text[0] for x in g] for g in got] == [["T"], ["a"], ["b", "c"], ["d", "e"]]
    assert sorted(x.text[0] for g in got for x in g) == sorted(x.text[0] for x in r)


def test_reading_order_is_the_texts():
    r = [record("text", "late", 500, 504), record("text", "early", 0, 5), record("text", "nowhere")]
    assert [[x.text for x in g] for g in chunking.chunked(r, True)] == [["early", "late", "nowhere"]]


def test_no_records():
    assert chunking.chunked([], False) == []


@pytest.mark.parametrize("text", ["", "# only a title", "## no title\n- x", "# t\n## s", "# t\n- a\n- b"])
def test_no_stage_graph(text):
    assert outline.stage_graph(text) is None


def test_columns_by_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(p, i, float(x := rnd.choice([20, 26, 31, 60, 300, 309, 330])), 0.0, x + rnd.choice([80.0, 200.0, 220.0, 520.0]), 10.0) for p in range(30) for i in range(9)]
    got = {(r.page, r.box): r.column_key for r in solver.column_keys(spark.createDataFrame(rows, "page int, box int, x0 double, y0 double, x1 double, y1 double"), "page", 600.0).collect()}
    for p in range(30):
        mine = [r for r in rows if r[0] == p]
        fit = [r for r in mine if 72 <= r[4] - r[2] <= 492]
        widths = sorted(r[4] - r[2] for r in fit)
        n = len(widths)
        median = (widths[(n - 1) // 2] + widths[n // 2]) / 2 if n else 0
        near, anchors = max(8, min(20, median * 0.08)), []
        for x in sorted(r[2] for r in fit):
            if not anchors or abs(x - anchors[-1]) > near:
                anchors.append(x)
            else:
                anchors[-1] = (anchors[-1] + x) / 2
        for r in mine:
            wide = r[4] - r[2] > 492
            want = "full" if wide or not anchors else f"column-{min(range(len(anchors)), key=lambda k: (abs(r[2] - anchors[k]), k))}"
            assert got[p, r[1]] == want


def test_quads(spark):
    square, far, touching = [[0, 0], [2, 0], [2, 2], [0, 2]], [[5, 5], [6, 5], [6, 6], [5, 6]], [[2, 0], [4, 0], [4, 2], [2, 2]]
    diamond = [[1.0, 1.5], [2.5, 3], [1, 4.5], [-0.5, 3]]
    rows = [(0, square, far), (1, square, touching), (2, square, diamond), (3, square, square), (4, square, square[:3])]
    df = spark.createDataFrame([(i, [[float(x) for x in p] for p in a], [[float(x) for x in p] for p in b]) for i, a, b in rows], "i int, a array<array<double>>, b array<array<double>>")
    assert {r.i: r.v for r in df.select("i", solver.quads_overlap(F.col("a"), F.col("b")).alias("v")).collect()} == {0: False, 1: False, 2: True, 3: True, 4: False}


def test_uniform_style_fits_and_fills():
    paragraphs = [[(400, 8.0), (90, 8.0), (0, 8.0)], [(700, 0.0)]]
    own = solver.Streams([200, 220], [150, 190], paragraphs, solver.BODY_STYLE["sign"])
    used = []
    for width, ps in zip([200, 220], paragraphs, strict=True):
        lines, some = 0, 0
        for n, indent in ps:
            if n:
                full, first = max(6, width / (8.5 * 0.45)), max(4, (width - indent) / (8.5 * 0.45))
                lines += 1 if n <= first else 1 + int((n - first + full - 1) // full)
                some += 1
        used.append(lines * 8.5 * 1.1 + max(0, some - 1) * 0.16 * 8.5)
    assert own.used(8.5, 1.1, 0.16).tolist() == pytest.approx(used)
    font, ratio = solver.uniform_style(own, 8.4, 1.16, solver.BODY_STYLE, 6.0)
    assert 7.2 <= font <= 10.6 and ratio in (1.102, 1.137, 1.16, 1.18)
    assert any(own.fit(font - 0.01, ratio, g) for g in solver.BODY_STYLE["gaps"]) or font <= 7.2


def test_uniform_style_of_nothing():
    assert solver.uniform_style(solver.Streams([100], [50], [[]], 0.45), 8.0, 1.1, solver.BODY_STYLE, 6.0)[0] > 7
