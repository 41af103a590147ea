"""The join against all pairs, on texts with many near copies and common passages."""

import random

import numpy as np
import pytest

from textloom.llm.jaccard_join import Block, JaccardJoin, Shingler, bucket_pairs, jaccard_components, keep_one_each, least_overlap, list_pairs, prefix

SCHEMA = "doc_id long, text string, score int"


def shingles(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed, bases=6, copies=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 80, 160]))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own += passage[: rng.randint(5, 40)]
            texts.append(" ".join(own))
    texts += [" ".join(passage[: rng.randint(20, 40)]) for _ in range(10)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_all_pairs(spark, seed):
    rows = corpus(seed)
    found = jaccard_components(spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA)).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (9, "É a b c d"), (10, "é a b c d"), (11, "x " * 50_000), (12, "X\x0b" * 49_999)]
    found = sorted(map(tuple, jaccard_components(spark.createDataFrame([(d, t, 0) for d, t in rows] + [(None, "a b c d e", 0)], SCHEMA)).collect()), key=lambda r: (r[0] is None, r))
    assert found[-1] == (None, 1, None)
    assert found[:-1] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7), (8, 1, 7), (9, 1, 9), (10, 1, 10), (11, 1, 11), (12, 1, 11)]


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lists_skip_no_pair():
    """Every pair of sets that links is among the pairs of the lists, whatever the order of elements."""
    rng = np.random.default_rng(5)
    for threshold in (60, 75, 90):
        sets = []
        for _ in range(60):
            base = rng.integers(0, 2**63, size=rng.integers(1, 60)).astype(np.uint64)
            for _ in range(rng.integers(1, 6)):
                own = base.copy()
                own[rng.random(len(own)) < 0.1] = rng.integers(0, 2**63)
                sets.append(np.unique(own))
        heavy = np.sort(np.unique(np.concatenate(sets))[::3])
        times = rng.integers(2, 9, size=len(heavy)).astype(np.int32)
        e, leader, size, pos = [], [], [], []
        for i, s in enumerate(sets):
            for j, x in enumerate(prefix(s, heavy, times, threshold)):
                e.append(x), leader.append(i), size.append(len(s)), pos.append(j)
        found = set(map(tuple, bucket_pairs(np.array(e), np.array(leader), np.array(size), np.array(pos), threshold)))
        for i, x in enumerate(sets):
            for j in range(i):
                if len(np.intersect1d(x, sets[j])) >= least_overlap(len(x), len(sets[j]), threshold):
                    assert (j, i) in found


def test_a_list_of_one_leader_yields_nothing():
    x, _ = list_pairs(np.zeros(500, np.int64), np.full(500, 40), np.arange(500) % 7, 75)
    assert not len(x)


def test_shingler_forgets_without_changing_results(monkeypatch):
    monkeypatch.setattr("textloom.llm.jaccard_join._CACHED_WORDS", 3)
    s, fresh = Shingler(), Shingler()
    for text in (b"a b c d e f g h", b"x y z", b"a b c d e f g h i"):
        assert (s.elements(text) == fresh.elements(text)).all()


def hub_corpus(seed, copies=60):
    """Copies of one text with so many changes that most link with it alone, and some with nothing."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [4, 5])
def test_hub_of_copies(spark, monkeypatch, seed):
    monkeypatch.setattr("textloom.llm.jaccard_join.BLOCK", 5)
    rows = hub_corpus(seed)
    found = jaccard_components(spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA)).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_block_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, size=rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    block = Block(list(range(40)), sets)
    for x in sets[:10]:
        assert block.overlaps(x).tolist() == [len(np.intersect1d(x, y)) for y in sets]


def test_repeated_ids_with_different_texts(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    frame = spark.createDataFrame([(5, a, 0), (5, b, 1), (2, a.upper(), 2), (7, b, 3), (7, b, 3), (None, a, 4), (8, None, 5), (8, "", 6)], SCHEMA)
    found = sorted(map(tuple, jaccard_components(frame).collect()), key=repr)
    assert found == sorted([(5, 2, 2), (5, 2, 5), (2, 2, 2), (7, 2, 5), (7, 2, 5), (None, 2, None), (8, 0, 8), (8, 0, 8)], key=repr)
    kept = keep_one_each(frame.withColumnRenamed("score", "marker"))
    assert sorted((r.marker for r in kept.collect())) == [1, 2, 4, 5, 6] and kept.columns == ["doc_id", "text", "marker"]
    assert keep_one_each(frame.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [2, 5])
def test_pairs_of_hubs_are_dealt(spark, monkeypatch, seed):
    """Hubs of more than two partners go to blocks, and band groups of more than three rows are broadcast."""
    monkeypatch.setattr("textloom.llm.jaccard_join.BLOCK", 2)
    monkeypatch.setattr("textloom.llm.common.LEAST_HOT", 3)
    rows = hub_corpus(seed, 40) if seed == 5 else corpus(seed)
    found = jaccard_components(spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA)).collect()
    assert sorted(map(tuple, found)) == brute(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("textloom_texts")]


def crowd_corpus(seed, copies=200, changes=9):
    """Copies of one text that share more than half with it but do not link with it; what they have instead, many have."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for _ in range(copies):
        own = list(base)
        for k in rng.sample(range(2, 200, 5), changes):
            own[k] = f"other{k}-{rng.randrange(3)}"
        texts.append(" ".join(own))
        if rng.random() < 0.2:  # a near copy of the copy
            own[rng.randrange(200)] = "changed"
            texts.append(" ".join(own))
    texts += [texts[5] + " more", texts[0] + " more", texts[0].replace("w7", "x7")]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "block", "changes"), [(1, 1024, 9), (2, 30, 9), (3, 30, 6)])
def test_crowds_that_do_not_link_make_no_pairs(spark, monkeypatch, seed, block, changes):
    monkeypatch.setattr("textloom.llm.jaccard_join.BLOCK", block)
    made = []
    oriented = JaccardJoin._oriented
    monkeypatch.setattr(JaccardJoin, "_oriented", lambda self, pairs: made.append(pairs.count()) or oriented(self, pairs))
    rows = crowd_corpus(seed, changes=changes)
    found = jaccard_components(spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA)).collect()
    assert sorted(map(tuple, found)) == brute(rows)
    assert made[0] < 10 * len(rows)
