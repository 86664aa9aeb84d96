"""The stages, each on what the one before it kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from papyra.llm import jaccard, phrase_dedup  # noqa: E402

from ..conftest import SF  # noqa: E402
from .conftest import prose  # noqa: E402


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= before
        if name == "ngram_jaccard":
            want = {i for i, (_, c) in jaccard.brute_force(held, 5, 80, 100).items() if c == i}
            assert ids == want
        if name == "substring_dedup":
            cut = phrase_dedup.brute_force(held)
            assert {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()} == {i: n - gone for i, (n, gone, _) in cut.items() if not gone or gone < n}
        before = ids
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == before


def test_near_copies_of_repeated_ids(spark):
    a, b, c, d = (prose(seed, 200) for seed in (31, 32, 33, 34))
    near = {x: x.replace(x.split()[100], "CHANGED", 1) for x in (a, c)}
    rows = [(1, a), (1, a), (1, a), (2, near[a]), (2, b), (3, c), (3, near[c]), (4, ""), (4, ""), (5, a), (5, d), (6, None), (None, a), (None, a)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _v string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, df, SF).collect()]
    one = [x for x in got if x[0] == 3]
    assert len(one) == 1 and one[0][1] in (c, near[c])
    key = lambda x: (str(x[0]), x[1] or "")
    want = [(1, a), (2, b), (4, ""), (5, d), (6, None), (None, a), (None, a)]
    assert sorted((x for x in got if x[0] != 3), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("place", range(5))
def test_stages_of_odd_rows(spark, docs, no_docs, place):
    """Nulls, empty and repeated rows, missing ids, columns of clashing names, and no rows at all."""
    name, stage = corpus_pipeline.STAGES[place]
    odd = docs.unionByName(docs.limit(4)).unionByName(docs.limit(2).selectExpr("CAST(NULL AS BIGINT) AS doc_id", *docs.columns[1:]))
    rows, given = stage(spark, odd, SF).collect(), odd.collect()
    if name == "packing":
        assert sum(r.length for r in rows if r.doc_id is None) == sum(r.doc_tokens for r in rows if r.doc_id is None and r.start == 0)
    else:
        key = lambda r: str({**r.asDict(), "text": None, "n_chars": None})
        assert {key(r) for r in rows} <= {key(r) for r in given}
        if name == "substring_dedup":
            assert sum(r.doc_id is None for r in rows) == 2
        if name == "toxicity":  # rows of one text go or stay together, with ids or without
            from collections import Counter

            kept, all_ = Counter(r.text for r in rows), Counter(r.text for r in given)
            assert all(n == all_[t] for t, n in kept.items()) and kept[None] == all_[None]
    out = stage(spark, no_docs, SF)
    assert out.count() == 0 and (name == "packing" or out.columns == no_docs.columns)


def test_toxicity_stage_by_its_operator(spark):
    from papyra.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in toxicity.scored(docs, model).collect() if r.score < toxicity.THRESHOLD}
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()} == want


def test_mixing_stage_takes_what_the_mix_says(spark):
    from collections import Counter

    from papyra.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.copies_taken for r in mixing.mixed(docs).collect() if r.copies_taken}
    assert Counter(r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()) == Counter(want)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
