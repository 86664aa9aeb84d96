"""Folds of pages against the same fold of one page at a time, and queries over keys and ids beyond the small tables."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from papyra.functions import markdown
from papyra.operators import layout, solver
from papyra.plans.catalogue import ORACLE, QUERIES

from .conftest import SF
from .oracle import assert_same


def with_table(tmp_path, name: str, sql: str) -> str:
    """The smallest tables, one of them another."""
    for p in Path(SF).glob("*.parquet"):
        if p.stem != name:
            (tmp_path / p.name).symlink_to(p)
    duckdb.sql(f"COPY ({sql}) TO '{tmp_path / name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


@pytest.fixture(params=[7, 10000])
def batch(spark, request):
    """Rows of an Arrow batch: pages that go on in the next one, and many in one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.unset(name)


def pages(rnd):
    """Some hundred short pages, one long, one without an id."""
    return [(p, rnd.randint(0, 7)) for p in range(300)] + [(-1, 40), (None, 5)]


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def ungrouped(df) -> bool:
    """No call of Python for each page: that took hours on millions of pages."""
    plan = df._jdf.queryExecution().toString()
    return "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_shelves(spark, batch):
    rnd = random.Random(3)
    rows = [(p, k, rnd.randint(20, 500), rnd.choice([30, 90, 300])) for p, n in pages(rnd) for k in range(n)]
    want = set()
    for page, own in by_page(rows).items():
        sheet = x = y = shelf = 0
        for _, crop, w, h in sorted(own, key=lambda r: (-r[3], -r[2], r[1])):
            if x and x + w > 688:
                x, y, shelf = 0, y + shelf + 8, 0
            if y and y + h > 976:
                sheet, x, y, shelf = sheet + 1, 0, 0, 0
            want.add((page, crop, sheet, x, y))
            x, shelf = x + w + 8, max(shelf, h)
    got = layout.shelves(spark.createDataFrame(rows, "page long, crop long, w long, h long"), "page")
    assert ungrouped(got)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(rows) and set(found) == want
    assert layout.shelves(spark.createDataFrame([], "page long, crop long, w long, h long"), "page").count() == 0


def test_retreated(spark, batch):
    rnd = random.Random(4)
    rows = []
    for p, n in pages(rnd):
        for k in range(n):
            a, b = rnd.randint(0, 300), rnd.randint(0, 300)
            rows.append((p, k, rnd.choice(["column-0", "column-1", "column-2", "full", "", None]), float(a), float(b), float(a + rnd.randint(5, 300)), float(b + rnd.randint(0, 200))))
    want = set()
    for page, own in by_page(rows).items():
        x0, x1 = [r[3] for r in own], [r[5] for r in own]
        some = [i for i, r in enumerate(own) if r[2] and r[2] != "full"]
        for n, i in enumerate(some):
            for j in some[n + 1 :]:
                a, b = (i, j) if x0[i] <= x0[j] else (j, i)
                middle = (x1[a] + x0[b]) / 2
                apart = own[i][2] == own[j][2] or min(own[i][6], own[j][6]) - max(own[i][4], own[j][4]) <= 2 or x1[a] <= x0[b]
                if not apart and middle - x0[a] >= 20 and x1[b] - middle >= 20:
                    x1[a] = x0[b] = middle
        want |= {(page, r[1], r[2], x0[i], r[4], x1[i], r[6]) for i, r in enumerate(own)}
    got = solver.retreated(spark.createDataFrame(rows, "page long, stream int, column_key string, x0 double, y0 double, x1 double, y1 double"), "page")
    assert ungrouped(got)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(rows) and set(found) == want


def test_rotated_words(spark, batch):
    rnd = random.Random(5)
    rows = []
    for p, n in pages(rnd):
        for k in range(n):
            x, y = rnd.randint(0, 6), rnd.randint(0, 12) * 5
            rows.append((p, k, rnd.choice(["Up", "Low", "high", "a b", "é", "x1", "", None]), rnd.choice([-90, -90, -90, 0, None]), rnd.random(), float(x), float(y), float(x + rnd.randint(9, 14)), float(y + rnd.choice([5, 10, 20]))))
    want, joins = set(), 0
    for page, own in by_page(rows).items():
        left = [list(r) for r in own]

        def word(r):
            return r[3] == -90 and r[2] is not None and r[2].isascii() and r[2].isalpha()

        def above(r, o):
            wide = min(r[7] - r[5], o[7] - o[5])
            return min(r[7], o[7]) - max(r[5], o[5]) >= wide * 0.7 and -0.002 <= r[6] - o[8] <= wide * 0.6

        i = 0
        while i < len(left):
            r = left[i]
            j = next((k for k, o in enumerate(left) if k != i and word(o) and above(r, o)), None) if word(r) else None
            if j is None:
                i += 1
                continue
            o = left.pop(j)
            r[2:9] = f"{r[2]} {o[2]}", r[3], min(r[4], o[4]), min(r[5], o[5]), o[6], max(r[7], o[7]), r[8]
            i, joins = i + (j > i), joins + 1
        want |= {tuple(r) for r in left}
    got = solver.rotated_words(spark.createDataFrame(rows, "page long, line int, text string, rotation int, score double, x0 double, y0 double, x1 double, y1 double"), "page")
    assert ungrouped(got) and joins > 10
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_untranslated_with_sharp_s(spark, tmp_path):
    """STRASSE is Straße in capitals, not a translation of it."""
    sf = with_table(tmp_path, "documents", "SELECT i AS doc_id, t AS text, 'de' AS lang, 's' AS source, length(t)::BIGINT AS n_chars FROM range(1, 4) r(i), (VALUES ('Die Straße ist groß.'), ('STRASSE'), ('12')) v(t)")
    assert_same(QUERIES["fl15_untranslated"](spark, sf), ORACLE["fl15_untranslated"], sf)


def test_sentence_parts_of_long_numbers(spark, tmp_path):
    sf = with_table(tmp_path, "events", "SELECT CAST(n * 10 ** k AS BIGINT) AS event_id FROM (SELECT unnest([0, 1, 7, 10, 99]) AS n), range(0, 9) r(k)")
    assert_same(QUERIES["wn08_sentence_parts"](spark, sf), ORACLE["wn08_sentence_parts"], sf)


def test_split_text_cuts_long_numbers(spark):
    """The splitter itself keeps to its limit: no number is longer than a part."""
    rows = spark.createDataFrame([("One two. " + "x" * 20 + "1234567",)], "s string").select(markdown.split_text(F.col("s"), 12).alias("p"))
    assert rows.first()["p"] == ["One two. ", "x" * 12, "x" * 8 + "1234", "567"]
