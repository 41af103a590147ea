"""Exact link counts against all pairs of classes."""

import random

import pytest

from tests.llm.test_jaccard_join import SCHEMA, corpus, crowd_corpus, hub_corpus, shingles
from textloom.llm.jaccard_join import JaccardJoin, link_counts


def brute_counts(rows):
    """Classes by set, over rows that may repeat an id; (doc_id, n_shingles, class_id, n_links)."""
    sets = [(d, frozenset(shingles(t))) for d, t in rows]
    least, links = {}, {}
    for d, s in sets:
        if s and d is not None:
            least[s] = min(d, least.get(s, d))
    for x in least:
        links[x] = sum(100 * len(x & y) >= 75 * len(x | y) for y in least if y is not x)
    return sorted(((d, len(s), least[s], links[s]) if s and d is not None else (d, len(s), d, 0) for d, s in sets), key=repr)


def check(spark, rows):
    found = link_counts(spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_counts(rows)


def test_links_within_a_leaders_group(spark):
    """80 near copies of one text link with each other: 3,160 links, of which connecting them needs 79."""
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(80)]
    assert {r[3] for r in brute_counts(rows)} == {79}
    check(spark, rows)


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 3)])
def test_many_groups(spark, monkeypatch, seed, block):
    monkeypatch.setattr("textloom.llm.jaccard_join.BLOCK", block)
    check(spark, corpus(seed))


@pytest.mark.parametrize(("seed", "block"), [(4, 5), (5, 1024)])
def test_hub(spark, monkeypatch, seed, block):
    monkeypatch.setattr("textloom.llm.jaccard_join.BLOCK", block)
    check(spark, hub_corpus(seed))


def test_edge_cases(spark):
    rows = corpus(3, bases=2, copies=8)
    rows += [(0, rows[1][1]), (0, rows[0][1]), (1, rows[3][1]), (None, rows[2][1]), (900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (None, "")]
    check(spark, rows)
    assert link_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rounds_of_leaders(spark, monkeypatch):
    """Copies of a text that is not there, of which no leader links with all: those left alone get further leaders."""
    monkeypatch.setattr("textloom.llm.jaccard_join.CROWD", 2)
    asked = []
    pairs = JaccardJoin._star_pairs
    monkeypatch.setattr(JaccardJoin, "_star_pairs", lambda self, *of: asked.append(of[1:]) or pairs(self, *of))
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in rng.sample(range(0, 200, 5), rng.randint(1, 9)):
            own[k] = f"own{i}-{k}"
        rows.append((i, " ".join(own)))
    links = {r[3] for r in brute_counts(rows)}
    assert min(links) < 10 < max(links)
    check(spark, rows)
    assert len(asked) > 2


@pytest.mark.parametrize("block", [1024, 30])
def test_crowds_that_do_not_link(spark, monkeypatch, block):
    monkeypatch.setattr("textloom.llm.jaccard_join.BLOCK", block)
    check(spark, crowd_corpus(4, copies=120, changes=7))
