"""Candidate groups that chance makes large are parted, and no link is lost by it."""

import random

import numpy as np
import pytest

from papyra.llm import jaccard
from papyra.llm.jaccard import Bands

from .conftest import prose


def apart(rnd, n: int, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of n hashes, of which `differ` are not the other's."""
    x = rnd.integers(0, 2**64, n + differ, np.uint64)
    return np.sort(x[:n]), np.sort(x[differ:])


@pytest.mark.parametrize("num,den", [(80, 100), (85, 100), (50, 100)])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.9])
def test_linked_sets_share_a_finer_key(num, den, share):
    rnd, bands = np.random.default_rng(1), Bands(num, den)
    for n in [*range(1, 200, 3), 400, 900, 4000]:
        a, b = apart(rnd, n, n * (den - num) // (den + num))
        if n % 2:
            b = np.sort(rnd.permutation(a)[: -(-n * num // den)])  # as many fewer as may be
        both = len(np.intersect1d(a, b))
        assert den * both >= num * (len(a) + len(b) - both)
        keys = [bands.finer(s, s % np.uint64(100) < np.uint64(100 * share)) for s in (a, b)]
        if len(keys[0]) and len(np.setxor1d(a, b)):
            assert len(np.intersect1d(*keys))


def test_sets_of_one_common_passage_share_no_finer_key():
    rnd, bands = np.random.default_rng(2), Bands(80, 100)
    met = np.zeros(2, int)
    for _ in range(50):
        a, b = apart(rnd, 4600, 4480)
        none = np.zeros(len(a), bool)
        met += [len(np.intersect1d(bands.keys(a, none), bands.keys(b, none))) > 0, len(np.intersect1d(bands.finer(a, none), bands.finer(b, none))) > 0]
    assert met[0] > 5 and met[1] <= 2


def test_large_groups_are_parted_without_loss(spark, monkeypatch):
    """Documents that quote each other's passages, some of them nearly copies."""
    rnd, rows = random.Random(6), []
    passages = [prose(k, 80).split() for k in range(12)]
    for i in range(120):
        words = prose(1000 + i, 700).split() + sum(rnd.sample(passages, 2), [])
        rows.append((len(rows), " ".join(words)))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            words = list(words)
            for _ in range(rnd.randint(1, 20)):
                words[rnd.randrange(len(words))] = "new"
            rows.append((len(rows), " ".join(words)))
    parted, seen = jaccard._parted, []

    def seeing(stash, payload, wanted, *more):
        out = parted(stash, payload, wanted, *more)
        seen.append([max((r["count"] for r in x.groupBy("group").count().collect()), default=0) for x in (wanted, out[1])])
        return out

    monkeypatch.setattr(jaccard, "_parted", seeing)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100, tile=6).collect()
    want = jaccard.brute_force([(i, t.encode()) for i, t in rows], 5, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 3 * seen[0][1] < seen[0][0]
