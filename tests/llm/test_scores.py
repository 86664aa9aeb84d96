"""Classifiers, vector search, mixing and packing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from papyra.llm import licenses, mixing, packing, toxicity, vector_file

from ..conftest import SF
from ..oracle import assert_same
from .conftest import prose


# --- licences


@pytest.fixture(scope="module")
def model():
    return licenses.train([x for i in range(60) for x in prose(100 + i, 120).split("\n") if x.strip()])


LICENCES = {
    "MIT": licenses.TEMPLATES["MIT"][0],
    "Apache-2.0": licenses.TEMPLATES["Apache-2.0"][1],
    "BSD": licenses.TEMPLATES["BSD"][1],
    "GPL": licenses.TEMPLATES["GPL"][0],
    "ISC": licenses.TEMPLATES["ISC"][0],
    "MPL-2.0": licenses.TEMPLATES["MPL-2.0"][0],
}


def wrapped(text: str, width: int = 60) -> str:
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


@pytest.mark.parametrize("shape", [str, wrapped, lambda t: wrapped(t, 25), lambda t: prose(3, 60) + "\n" + t + "\n" + prose(4, 60), lambda t: t.upper(), lambda t: "# " + wrapped(t).replace("\n", "\n# ")])
def test_license_paragraphs(spark, model, shape):
    """Whole licence paragraphs, on one line, hard-wrapped, in the midst of prose, as comments."""
    rows = [(i, f"{prose(i, 30)}\n\n{shape(t)}\n\n{prose(i + 9, 30)}") for i, t in enumerate(LICENCES.values())]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.family) for r in got if r.confirmed) == list(enumerate(LICENCES))
    assert not [r for r in got if not r.confirmed]


def test_license_scan(spark, docs, model):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(i, f"{prose(i, 30)}\n\n{x}\n{prose(i + 9, 30)}", "clash") for i, x in enumerate(lines)] + [(50, None, ""), (51, "", ""), (52, "the license of the library", ""), (0, lines[0], ""), (None, lines[1], "")]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, family string"), model).collect()
    assert sorted((str(r.doc_id), r.family) for r in got if r.confirmed) == [("0", "MIT"), ("0", "MIT"), ("1", "CC-BY-NC"), ("2", "Apache-2.0"), ("3", "GPL"), ("None", "CC-BY-NC")]
    for r in got:
        if r.doc_id in range(1, 4):
            text = rows[r.doc_id][1].encode()
            assert text[r.start : r.stop].strip(b".") in text and lines[r.doc_id].strip(".").encode() in text[r.start : r.stop + 1]
    assert not licenses.scanned(docs, model).collect()


@pytest.mark.parametrize("name", ["Zorbel Quantri", "Hestia", "Mooncake Data"])
def test_license_unknown(spark, model, name):
    rows = [(1, f"Licensed under the {name} License."), (2, f"Released under the {name} Public License, version 2."), (3, f"This work is licensed under the {name} Community License 1.0.")]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.family, r.confirmed) for r in got) == [(1, "unknown", False), (2, "unknown", False), (3, "unknown", False)]


def test_license_bound_is_a_bound(model):
    """A window passed over has no licence class ahead of none."""
    lines = [t.encode() for v in licenses.TEMPLATES.values() for t in v] + [prose(i, 20).encode() for i in range(50)]
    words, line = licenses.hashed(lines)
    found, size = licenses.grams(words, line), np.bincount(line, minlength=len(lines))
    start, stop = licenses.paragraph_windows(size, np.arange(len(lines)))
    may = model.windows(found, start, stop)
    for a, b, yes in zip(start, stop, may, strict=True):
        f = np.concatenate([x[min(a + k, b) : b] for k, x in enumerate(found)])
        assert yes or not model.probabilities(f, np.zeros(len(f), int), 1)[0].argmax()


def test_windows_cover_paragraphs():
    size, block = np.array([3, 50, 0, 100, 7, 7]), np.array([0, 1, 1, 2, 3, 3])
    start, stop = licenses.paragraph_windows(size, block)
    assert (stop - start <= 40).all() and (stop > start).all()
    seen = np.zeros(size.sum(), bool)
    for a, b in zip(start, stop, strict=True):
        seen[a:b] = True
    assert seen.all()


def test_license_scan_of_nothing(no_docs, model):
    assert licenses.scanned(no_docs, model).count() == 0


def test_license_query(spark):
    """op1 itself: the lines of licences that the test table's documents hold, all of them and nothing else."""
    notice = r"(?i)^(licensed under|released under|this work is licensed|spdx-license)"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import re

    want = {i for i, t in docs.items() if any(re.match(notice, x.strip()) for x in t.split("\n"))}
    got = licenses.op1_licenses(spark, SF).collect()
    found = {r.doc_id for r in got}
    precision, recall = len(found & want) / max(1, len(found)), len(found & want) / max(1, len(want))
    assert precision >= 0.9 and recall >= 0.9, (precision, recall, found ^ want)
    for r in got:
        assert docs[r.doc_id].encode()[r.start : r.stop].strip()


# --- toxicity


def toxic_rows(n=240):
    rows = []
    for i in range(n):
        y = i % 3 == 0
        words = prose(1000 + i, 60).split()
        if y:
            for k in (7, 23, 41):
                words[k] = ["idiot", "scum!", "vequ" + "aeiou"[i % 5] + "x"][k % 3]
        rows.append((i, " ".join(words), int(y)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(9000, None, ""), (9001, "", ""), (None, "x", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fitted(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [(got[i].score, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    assert 0 <= got[9000].score <= 1 and got[9000].score == got[9001].score and got[9000].toxic_spans == []
    spans = got[0].toxic_spans
    assert {rows[0][1].encode()[s.start : s.stop] for s in spans} <= {b"idiot", b"scum!", b"vequax"} and spans


def test_toxicity_learns_from_the_training_rows_alone(spark):
    """Labels of held-out rows change nothing."""
    rows = toxic_rows(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, toxic int")
        scores.append({r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()})
    assert scores[0] == scores[1]


def test_toxicity_query(spark):
    """op7 itself: a row a document, its offending offsets inside the text, the threshold applied."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = toxicity.op7_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
        assert all(docs[r.doc_id][s.start : s.stop].split() == [docs[r.doc_id][s.start : s.stop]] and s.probability > 0.5 for s in r.toxic_spans)


def test_labels_that_disagree(spark):
    """A doc_id with several labels is toxic if one says so, in whatever order they come."""
    rows = toxic_rows(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    once = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    twice = spark.createDataFrame([(i, x) for i, _, y in rows for x in ((0, y), (y, 0))[i % 2]], "doc_id long, toxic int")
    scores = [{r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fitted(docs, x)).collect()} for x in (once, twice)]
    assert scores[0] == scores[1]


def test_long_documents_are_one_chain():
    """Messages pass from row to row: as if the whole document were one."""
    rnd = np.random.default_rng(6)
    scores, moves = [rnd.normal(size=n) * 3 for n in (5, 0, 64, 65, 200, 1, 128, 1000)], rnd.normal(size=(2, 2))
    for s, odds in zip(scores, toxicity.document_odds(scores, moves), strict=True):
        assert len(s) == len(odds) and (not len(s) or np.allclose(odds, toxicity.posteriors(s[None, :], moves)[0][0]))


def test_toxicity_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fitted(docs, none)
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, model).collect())
    assert toxicity.scored(no_docs, model).count() == 0


def test_forward_backward_by_enumeration():
    from itertools import product

    rnd = np.random.default_rng(5)
    scores, moves = rnd.normal(size=(1, 6)), rnd.normal(size=(2, 2))
    odds = toxicity.posteriors(scores, moves)[0][0]
    weight = np.zeros((6, 2))
    for path in product((0, 1), repeat=6):
        w = np.exp(sum(scores[0, t] for t in range(6) if path[t]) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, y in enumerate(path):
            weight[t, y] += w
    assert np.allclose(odds, np.log(weight[:, 1] / weight[:, 0]))


# --- vectors


def vectors(seed=3, n=300, d=8):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rnd.normal(size=d)], 0) for i in range(n)]
    rows += [(n + i, rows[10][1], 0) for i in range(40)]  # one common vector
    rows += [(1000, None, 0), (1001, [None] + [0.0] * (d - 1), 0), (1002, [float("nan")] * d, 0), (1050, [float("inf")] * d, 0), (1003, [0.0] * d, 0), (None, [1.0] * d, 0), (1100, [0.0] * d, 0)]
    return rows


@pytest.mark.parametrize("k", [1, 5])
def test_top_k(spark, k):
    from pyspark.sql import functions as F

    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vector_file.top_k(df, F.col("vec_id") % 50 == 0, k).collect())
    exact = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in exact:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(exact[q], e, strict=True)), i) for i, e in exact.items() if i != q)[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_few(spark):
    from pyspark.sql import functions as F

    schema = "vec_id long, embedding array<float>"
    assert vector_file.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [3.0]), (2, [1.0, 1.0])], schema)
    got = vector_file.top_k(one, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.rank, r.query_id, r.vec_id, r.score) for r in got) == [(1, 0, 1, 196608), (2, 0, 1, 131072)]


@pytest.mark.parametrize("huge", [1e6, 1e30, -3e38])
def test_one_outlier(spark, huge):
    """Huge components are exact, and cost other vectors no bound; a score beyond a long is its end."""
    from pyspark.sql import functions as F

    rows = [*vectors(5, 400, 16)[:400], (7000, [huge] + [0.0] * 15, 0)]
    exact = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e, _ in rows}
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vector_file.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 50 == 0).collect())
    want = []
    for q in exact:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(exact[q], e, strict=True)), i) for i, e in exact.items() if i != q)[:5]
            want += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    m = np.array([exact[i] for i in range(400)] + [exact[7000]], np.float64)
    below, above = vector_file.bounds(m[:8], *vector_file._cells(m))
    kept = (above >= np.sort(below, axis=1)[:, -5:-4]).sum()
    assert kept < 8 * 40  # cells by quantile: of 401 candidates a tenth is left at most


def test_bounds_hold():
    rnd = np.random.default_rng(8)
    m = np.floor(256 * rnd.standard_t(2, (700, 12)))
    below, above = vector_file.bounds(m[:50], *vector_file._cells(m))
    true = m[:50] @ m.T
    assert (below <= true).all() and (true <= above).all()


def test_repeated_ids_of_one_vector(spark):
    """No id may keep others out: 30 rows of one id and one vector, beside others of that vector."""
    from pyspark.sql import functions as F

    rows = [(50, [1.0, 2.0])] * 30 + [(60 + i, [1.0, 2.0]) for i in range(6)] + [(1, [0.5, 0.5])]
    got = vector_file.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 3).collect()
    assert len(got) == 90 and sorted((r.rank, r.vec_id) for r in got) == sorted([(1, 60), (2, 61), (3, 62)] * 30)


def test_vector_query(spark):
    assert_same(vector_file.op9_vector_file(spark, SF), vector_file.SQL, SF)


# --- mixing


def test_mixing_query(spark):
    assert_same(mixing.op10_mixing(spark, SF), mixing.SQL, SF)


def test_mixing_of_odd_rows(spark, docs, no_docs):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r.size for r in rows)
    assert {r.source for r in rows} >= {None}
    assert mixing.mixed(no_docs).count() == 0
    again = docs.unionByName(docs.limit(5))
    assert mixing.mixed(again).count() == docs.count() + 5
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert copies == Counter({r.doc_id: r.copies_taken for r in rows if r.copies_taken})
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_rows_without_ids_are_mixed_each(spark):
    rows = [(None if i % 3 == 0 else i, prose(i, 40), f"s{i % 3}") for i in range(600)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("s0", "s1", "s2"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 45


def test_targets_are_reached(spark):
    rows = [(i, prose(i, 20 + i % 30), f"s{i % 3}") for i in range(600)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)


# --- packing


def test_packing(docs, no_docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = {i: [*t.encode(x.decode(), add_special_tokens=False).ids, 1] for i, x in texts}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.packed(docs, packing.tokenizer_path()).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for doc_id, ids in want.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert np.frombuffer(r.ids, "<u2").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert sorted(windows) == list(range(len(windows)))
    assert packing.packed(no_docs, packing.tokenizer_path()).count() == 0


def test_deficits_hold_the_mixture():
    lengths, shares = [50_000, 30_000, 20_480], [0.5, 0.3, 0.2]
    total = sum(lengths)
    used, worst = [0, 0, 0], 0.0
    filled = Counter()
    for w, q, n in packing.fill(lengths, [x / total for x in lengths], [0, 0, 0], packing.capacities(total)):
        used[q] += n
        filled[w] += n
        done = sum(used)
        worst = max(worst, max(abs(u - done * x / total) for u, x in zip(used, lengths, strict=True)))
    assert used == lengths and worst <= 2048 and shares
    assert all(filled[w] == c for w, c in enumerate(packing.capacities(total)))


@pytest.mark.parametrize("carried", [0, 5000])
def test_every_window_holds_the_mixture(carried):
    """While a queue lasts, a source has its share of each window, give or take two pieces, whatever credit it brings."""
    rnd = np.random.default_rng(4)
    lengths = rnd.integers(30_000, 60_000, 20).tolist()
    total = sum(lengths)
    shares = [x / total for x in lengths[::-1]]  # not what the queues hold, so some run dry
    credits = (carried * (np.arange(20) - 9.5) / 10).tolist()
    given, left = defaultdict(lambda: [0] * 20), list(lengths)
    for w, q, n in packing.fill(lengths, shares, credits, packing.capacities(total)):
        given[w][q] += n
    for w, size in enumerate(packing.capacities(total)):
        assert sum(given[w]) == size
        left = [a - b for a, b in zip(left, given[w], strict=True)]
        if size == 2048 and min(left) > 0:
            assert max(abs(n - s * size) for n, s in zip(given[w], shares, strict=True)) <= 2 * packing.PIECE + 1
    assert not any(left)


def test_rare_sources_wait_for_a_piece():
    lengths = [100_000, *[400] * 50]
    total = sum(lengths)
    pieces = [n for _, q, n in packing.fill(lengths, [x / total for x in lengths], [0] * 51, packing.capacities(total)) if q]
    assert sum(pieces) == 20_000 and len(pieces) < 900


def test_packing_query(spark):
    """op6 itself: every id in one piece, windows whole, every full window near the mixture."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows, windows = defaultdict(list), defaultdict(int)
    for r in packing.op6_packing(spark, SF).collect():
        rows[r.doc_id].append(r)
        windows[r.sequence_id] += r.length
    for doc_id, text in docs.items():
        ids, at = [*t.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(rows[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    assert all(n == 2048 or n & (n - 1) == 0 for n in windows.values())


def test_packing_to_given_shares(spark):
    rows = [(i, prose(i, 400), f"s{i % 2}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.packed(df, packing.tokenizer_path(), {"s0": 0.75, "s1": 0.25}).collect()
    first = Counter()
    for r in got:
        if r.sequence_id < 5:
            first[r.source] += r.length
    assert 0.6 < first["s0"] / sum(first.values()) < 0.9
