"""Classes that meet by chance go by their sketches, before their shingles are read; no link is lost by it."""

import random

import numpy as np
import pytest

from papyra.llm import jaccard

from .conftest import prose
from .test_finer import apart


@pytest.mark.parametrize("num,den", [(80, 100), (85, 100), (50, 100)])
def test_linked_sets_have_sketches_that_may_link(num, den):
    rnd = np.random.default_rng(3)
    for n in [*range(1, 140), 500, 511, 512, 530, 1020, 1030, 4100, 9000]:
        pairs = [apart(rnd, n, n * (den - num) // (den + num))]
        a = pairs[0][0]
        pairs.append((a, np.sort(rnd.permutation(a)[: -(-n * num // den)])))
        pairs.append(tuple(x >> np.uint64(9) for x in pairs[0]))  # all in one range, beyond what a byte counts
        pairs.append(tuple(x >> np.uint64(9) for x in pairs[1]))
        for a, b in pairs:
            both = len(np.intersect1d(a, b))
            assert den * both >= num * (len(a) + len(b) - both)
        sides = [[x[i] for x in pairs] for i in (0, 1)]
        sizes = tuple(np.array([len(s) for s in side]) for side in sides)
        assert jaccard.may_link(sizes, tuple([jaccard.sketch(s) for s in side] for side in sides), num, den).all()


def test_sketches_tell_others_apart():
    rnd, met = np.random.default_rng(4), []
    for n in (20, 100, 400, 511, 600, 1030, 5000, 20000):
        a, b = apart(rnd, n, n * 9 // 10)
        met.append(jaccard.may_link((np.array([n]), np.array([n])), ([jaccard.sketch(a)], [jaccard.sketch(b)]), 80, 100)[0])
    assert not any(met)


def test_keys_dealt_over_tasks_lose_no_meeting():
    """Any two classes of one key are a pair, or joined by stars."""
    rnd = np.random.default_rng(5)
    for keys in (4, 60, 400):
        key, cls = rnd.integers(0, keys, 900).astype(np.uint64), rnd.integers(0, 200, 900)
        stars, sent = [], []
        for part in np.array_split(np.arange(900), 5):
            k, c, many, star, _ = jaccard._meetings(key[part], cls[part], np.zeros(len(part), bool))
            stars.append(np.stack(star))
            sent.append((k, c, many))
        *_, star, pairs = jaccard._meetings(*map(np.concatenate, zip(*sent, strict=True)))
        joined = jaccard.Joined(200)
        for a, b in np.concatenate([*stars, np.stack(star)], axis=1).T.tolist():
            joined.join(a, b)
        pairs = {*zip(*(x.tolist() for x in pairs), strict=True)}
        for k in range(keys):
            own = np.unique(cls[key == k]).tolist()
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    assert (a, b) in pairs or joined.root(a) == joined.root(b)
    assert pairs


def test_shingles_are_read_for_few_that_meet_by_chance(spark, monkeypatch):
    """Each text shares phrases with some others; few are nearly copies."""
    rnd, rows = random.Random(7), []
    phrases = [prose(100 + k, 5) for k in range(300)]
    for i in range(150):
        words = prose(2000 + i, 120).split()
        for phrase in rnd.sample(phrases, 8):
            at = rnd.randrange(0, len(words))
            words[at:at] = phrase.split()
        rows.append((len(rows), " ".join(words)))
        if i % 15 == 0:
            words[50] = "new"
            rows.append((len(rows), " ".join(words)))
    payload, seen = jaccard._payload, []

    def seeing(docs, wanted, *more):
        seen.append(wanted.count())
        return payload(docs, wanted, *more)

    monkeypatch.setattr(jaccard, "_payload", seeing)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard.brute_force([(i, t.encode()) for i, t in rows], 5, 80, 100)
    assert seen[0] <= 40
