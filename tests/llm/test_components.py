"""Components, and how many links of a group enter their rounds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from papyra.llm import components as cc
from papyra.llm import jaccard
from papyra.llm.common import Stash

from .conftest import prose


def joined(links: list[tuple[int, int]]) -> dict[int, int]:
    nodes = sorted({x for link in links for x in link})
    place, found = {x: i for i, x in enumerate(nodes)}, jaccard.Joined(len(nodes))
    for a, b in links:
        found.join(place[a], place[b])
    return {x: nodes[found.root(i)] for i, x in enumerate(nodes)}


@pytest.mark.parametrize("nodes,links", [(1, 1), (40, 20), (40, 400), (5000, 4000), (5000, 2500)])
def test_forest_has_the_components(nodes, links):
    rnd = np.random.default_rng(nodes + links)
    u, v = rnd.integers(-nodes, nodes, (2, links))
    node, least = cc.forest(u, v)
    want = {x: y for x, y in joined(list(zip(u.tolist(), v.tolist(), strict=True))).items() if x != y}
    assert dict(zip(node.tolist(), least.tolist(), strict=True)) == want and len(node) == len(want)


@pytest.mark.parametrize("held", [1 << 20, 60, 7])
def test_forests_by_parts_join_what_the_links_join(monkeypatch, held):
    monkeypatch.setattr(cc, "HELD", held)
    u, v = np.random.default_rng(9).integers(0, 90, (2, 300))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 4]) for x in (u, v)], ["u", "v"]) for i in range(0, 300, 4)]
    out = [link for b in cc._forests(batches) for link in zip(*(x.to_pylist() for x in b.columns), strict=True)]
    assert joined(out) == joined(list(zip(u.tolist(), v.tolist(), strict=True)))
    assert list(cc._forests([])) == []


def test_components_of_chains_stars_and_cliques(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(999, i) for i in range(200, 260)] + [(i, j) for i in range(300, 330) for j in range(300, 330)]
    links += [(rnd.randrange(400, 700), rnd.randrange(400, 700)) for _ in range(150)] + [(5, 5)]
    rnd.shuffle(links)
    found = cc.components(spark.createDataFrame(links, "u long, v long").repartition(3), Stash(spark, "test")).collect()
    got = {r.node: r.component for r in found}
    assert got == joined([x for x in links if x[0] != x[1]]) and len(found) == len(got)


def test_a_large_group_enters_the_rounds_with_about_one_link_a_class(spark, monkeypatch):
    """Near copies share keys around many least classes, several a copy."""
    rnd, base, rows = random.Random(8), prose(11, 400).split(), []
    for i in range(300):
        words = list(base)
        for _ in range(rnd.randint(4, 12)):
            words[rnd.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words)))
    summary, seen = cc._summary, []

    def seeing(edges):
        seen.append(summary(edges))
        return seen[-1]

    monkeypatch.setattr(cc, "_summary", seeing)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100, tile=60).collect()
    want = jaccard.brute_force([(i, t.encode()) for i, t in rows], 5, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert max(x[0] for x in seen) < 2 * len(rows)
