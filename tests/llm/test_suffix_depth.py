"""Long copies are put in order as deep as a match needs, and no deeper."""

import numpy as np

from papyra.llm import suffix_dedup

from .conftest import prose


def test_copies_are_sorted_to_the_depth_of_a_match(monkeypatch):
    long = prose(21, 500).encode()
    texts = [long, prose(22, 90).encode() + long[700:1500], long[:1000] + b"x" + long[1000:], long[100:149], long[100:150], b"", long]
    ids = np.array([5, 3, 9, 7, 8, 1, 4])
    passages = [(2, long[200:300], []), (6, long[1200:], [])]
    doubled, depths = suffix_dedup._doubled, []

    def seeing(rank, at, place, h, n):
        depths.append(h)
        return doubled(rank, at, place, h, n)

    monkeypatch.setattr(suffix_dedup, "_doubled", seeing)
    found = suffix_dedup._solve(ids, texts, passages)
    strings = [*zip(ids.tolist(), texts, strict=True), *(p[:2] for p in passages)]
    for own, text, ranges in zip(ids.tolist(), texts, found, strict=True):
        want = [k for k in range(len(text) - 49) if any(text[k : k + 50] in other for owner, other in strings if owner < own)]
        assert ([] if ranges is None else ranges[0].tolist()) == want
    assert depths and max(depths) < suffix_dedup.MATCH_BYTES
