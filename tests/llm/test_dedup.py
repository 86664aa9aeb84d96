"""The three de-duplicating operators against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import jaccard, passages, phrase_dedup, suffix_dedup
from papyra.llm.common import flagged

from ..conftest import SF
from ..oracle import assert_same
from .conftest import CLASHES, SCHEMA, prose


def _suffix(df):
    import hashlib

    out = {}
    for r in suffix_dedup.deduplicated(df).collect():
        out[r.doc_id] = (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
    return out


def test_suffix_dedup(docs, texts):
    assert _suffix(docs) == suffix_dedup.brute_force(texts)


def test_phrase_dedup(docs, texts):
    rows = phrase_dedup.deduplicated(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == phrase_dedup.brute_force(texts)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].text is None and by_id[0].lang is None
    assert by_id[15]._v == "_v5" and by_id[15]._q == "_q5"  # columns of any name come through
    assert all(len(r.text.encode().split()) == r.n_words - r.n_removed for r in rows if r.text)


@pytest.mark.parametrize("words,num,den,tile", [(4, 85, 100, 4000), (5, 80, 100, 4000), (3, 60, 100, 4000), (3, 60, 100, 2)])
def test_jaccard(docs, texts, words, num, den, tile):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, words, num, den, tile).collect()}
    assert got == jaccard.brute_force(texts, words, num, den)


@pytest.mark.parametrize("operator", [suffix_dedup.deduplicated, phrase_dedup.deduplicated, jaccard.near_duplicates])
def test_empty_table(no_docs, operator):
    assert operator(no_docs).count() == 0


def _repeated(spark, docs):
    extra = [(15, "another text of the id fifteen", *[None] * (3 + len(CLASHES))), (None, docs[5][1], *[None] * (3 + len(CLASHES))), (15, docs[5][1], *[None] * (3 + len(CLASHES)))]
    return spark.createDataFrame(docs + extra, SCHEMA)


def test_repeated_and_missing_ids(spark):
    from .conftest import documents

    rows = documents()
    df = _repeated(spark, rows)
    n = len(rows) + 3
    assert suffix_dedup.deduplicated(df).count() == n
    phrases = phrase_dedup.deduplicated(df).collect()
    assert len(phrases) == n
    assert [r.n_removed for r in phrases if r.doc_id is None] == [0]  # nothing without an id is taken away
    assert [r.n_removed for r in phrases if r.doc_id == 15] == [0, 0, 0]  # versions of one id do not take from each other
    near = jaccard.near_duplicates(df).collect()
    assert len(near) == n
    assert [r.component_id for r in near if r.doc_id is None] == [None]


@pytest.mark.parametrize("part", [64, 1 << 15])
def test_shards_of_many_parts(part):
    """Sorting in parts changes nothing: shards of the test table's documents against brute force."""
    import pyarrow.parquet as pq

    rows = sorted((r["doc_id"], (r["text"] or "").encode()) for r in pq.read_table(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").to_pylist())
    rows = rows[:300]
    suffix_dedup.PART = part
    found = suffix_dedup._solve(np.array([i for i, _ in rows]), [t for _, t in rows], [])
    want = suffix_dedup.brute_force(rows)
    for (i, text), ranges in zip(rows, found, strict=True):
        assert (0 if ranges is None else int(passages.mask(len(text), ranges).sum())) == want[i][1]


@pytest.mark.parametrize("query,sql", [("op2_jaccard", jaccard.SQL), ("op3_suffix_dedup", suffix_dedup.SQL), ("op8_phrase_dedup", phrase_dedup.SQL)])
def test_queries_against_sql(spark, query, sql):
    from papyra.llm.queries import QUERIES

    assert_same(QUERIES[query](spark, SF), sql, SF)


@pytest.mark.parametrize("sf", [SF])
def test_queries_against_brute_force(spark, sf):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op3_suffix_dedup(spark, sf).collect()}
    assert got == suffix_dedup.brute_force(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup.op8_phrase_dedup(spark, sf).collect()}
    assert got == phrase_dedup.brute_force(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op2_jaccard(spark, sf).collect()}
    assert got == jaccard.brute_force(rows, 4, 85, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60))
def test_previous_smaller(values):
    got = suffix_dedup.previous_smaller(np.array(values, np.int64))
    want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
    assert got.tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80).map(lambda b: bytes(x % 2 + 97 for x in b)), st.integers(0, 3))
def test_suffix_order(data, copies):
    text = data * (copies + 1)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    for part in (1, 7, 1 << 20):
        suffix_dedup.PART = part
        assert suffix_dedup.suffix_order(np.frombuffer(text, np.uint8)).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=6), st.sampled_from([8, 11, 16, 30]), st.sampled_from([1, 3, 1 << 15]))
def test_longest_previous_factors(parts, most, part):
    owner = np.array([i // 2 for i in range(len(parts))])
    suffix_dedup.PART = part
    which, at, length = suffix_dedup.longest_previous_factors(parts, owner, most)
    want = []
    for i, p in enumerate(parts):
        for k in range(len(p) - most + 1):
            if any(p[k : k + most] in q for j, q in enumerate(parts) if owner[j] < owner[i]):
                want.append((i, k))
    assert list(zip(which.tolist(), at.tolist(), strict=True)) == want and (length == most).all()


def _nothing(ids, texts, passages):
    return [None] * len(texts)


def test_the_solvers_alone_remove(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_solve", _nothing)
    monkeypatch.setattr(phrase_dedup, "_solve", _nothing)
    assert not [r for r in suffix_dedup.deduplicated(docs).collect() if r.spans]
    assert not [r for r in phrase_dedup.deduplicated(docs).collect() if r.n_removed]


@pytest.mark.parametrize("fan,shard", [(2, 30), (1, 1)])
def test_passages_handed_on(spark, docs, texts, monkeypatch, fan, shard):
    """Many groups share passages and hand them on; automata hold few words each."""
    monkeypatch.setattr(passages, "FAN", fan)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    monkeypatch.setattr(phrase_dedup, "GROUP_BYTES", 500)
    monkeypatch.setattr(passages, "BUCKET_BYTES", 300)
    monkeypatch.setattr(phrase_dedup, "SHARD_WORDS", shard)
    common = prose(90, 60)
    rows = [(1000 + i, f"{prose(200 + i, i % 7)} {common} {prose(300 + i, i % 5)}".strip()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup.deduplicated(df).collect()} == phrase_dedup.brute_force([(i, t.encode()) for i, t in rows])
    assert _suffix(df) == suffix_dedup.brute_force([(i, t.encode()) for i, t in rows])


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, prose(1, 40), "a", 5), (2, prose(1, 40), "b", 6)], "doc_id long, text string, _id string, _q int")
    got = {r.doc_id: (r["_id"], r["_q"], r.n_removed) for r in phrase_dedup.deduplicated(df).collect()}
    assert got == {1: ("a", 5, 0), 2: ("b", 6, 40)}


def test_packed_columns_round_trip():
    x = np.array([-5, 0, 7, 1 << 40], np.int64)
    c = passages.unpack([passages.pack(id=x, v=x & 7), passages.pack(id=x[:1], v=x[:1] & 7)], "id", "v")
    assert c["id"].tolist() == [*x.tolist(), -5]


def test_any_number_of_versions(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    df = spark.range(66_000).selectExpr("9L AS doc_id", "concat('a', id) AS text")
    df = df.union(spark.createDataFrame([(1, passage), (9, "z " + passage)], df.schema)).repartition(3)
    got = phrase_dedup.deduplicated(df).where("n_removed > 0").collect()
    assert [(r.doc_id, r.n_words, r.n_removed) for r in got] == [(9, 31, 30)]
    got = suffix_dedup.deduplicated(df).where("size(spans) > 0").collect()
    assert [(r.doc_id, bytes(r.kept)) for r in got] == [(9, b"z ")]


def test_spark_hash(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 50)]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("hash(i)").collect()]
    assert passages.spark_hash(np.array(ids)).tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.integers(0, 12), st.integers(0, 12))
def test_linked_sets_share_a_key(base, drop, add):
    """The pigeonhole: sets that link agree in a key unless they are equal."""
    a = np.array(sorted(base), np.uint64)
    b = np.unique(np.concatenate((a[drop:], np.arange(add, dtype=np.uint64) * np.uint64(1234567891011))))
    both = len(np.intersect1d(a, b))
    if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
        bands = jaccard.Bands(85, 100)
        assert len(np.intersect1d(bands.keys(a), bands.keys(b)))
        for share in (2, 3, 50):  # whichever shingles are called popular
            assert len(np.intersect1d(bands.keys(a, a % share == 0), bands.keys(b, b % share == 0)))


def test_popular_shingles(spark):
    """Only what very many documents hold is popular, and every count is of all documents."""
    common = "this very passage stands in each and every document of the table"
    df = spark.createDataFrame([(i, f"{common} {' '.join(f'w{i}x{k}' for k in range(30))}") for i in range(80)], "doc_id long, text string").repartition(3)
    flags = jaccard.popular_shingles(df, 5)
    for text, popular in ((common, True), ("w3x1 w3x2 w3x3 w3x4 w3x5", False)):
        assert (flagged(flags, jaccard.shingles(text.encode(), 5)) == popular).all()
