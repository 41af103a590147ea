"""Exact dedup and line dedup against brute force, and their edge cases."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm.exact_dedup import exact_dedup, keep_winners
from textloom.llm.line_dedup import keep_bitmaps, line_dedup

SCHEMA = "doc_id long, text string, digest string, kept int, doc long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 7, 9) for d, t in rows], SCHEMA)


def lower(text):
    return (text or "").encode().lower().decode()


def test_exact_dedup(spark):
    rows = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (None, "same"), (10, "only"), (10, "only"), (None, "void")]
    found = sorted(map(tuple, exact_dedup(frame(spark, rows)).collect()), key=repr)
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    want, stays = [], set()
    for d, t in rows:
        own = [x for x in groups[lower(t)] if x is not None]
        best = max(own) if own else None
        stay = d == best and lower(t) not in stays  # one of rows that repeat the winner
        stays |= {lower(t)} if stay else set()
        want.append((d, best, len(groups[lower(t)]), stay, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert found == sorted(want, key=repr)
    kept = keep_winners(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "kept", "doc"]
    assert sorted(map(repr, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(repr((d, t)) for (d, t), w in zip(rows, want) if w[3])
    assert exact_dedup(frame(spark, [])).collect() == [] and keep_winners(frame(spark, [])).collect() == []
    # digests and fingerprints that all texts share change nothing, nor do groups that are broadcast
    weak = exact_dedup(frame(spark, rows), digest=lambda t: F.unhex(F.lit("00")), fingerprint=lambda t: F.lit(1).cast("long"))
    assert sorted((tuple(r)[:3] + tuple(r)[4:] for r in weak.collect()), key=repr) == sorted((w[:3] + w[4:] for w in want), key=repr)


def test_exact_dedup_with_hot_groups(spark, monkeypatch):
    monkeypatch.setattr("textloom.llm.common.LEAST_HOT", 3)
    rows = [(i % 50, "hot") for i in range(200)] + [(i, f"text {i % 40}") for i in range(80)]
    found = exact_dedup(frame(spark, rows)).collect()
    assert {(r.keep_id, r.group_size) for r in found if r.group_size > 2} == {(49, 200)} and len(found) == 280
    assert sorted((r.doc_id, r.group_size) for r in found if r.kept) == sorted([(49, 200)] + [(40 + i, 2) for i in range(40)])


def test_keep_winners_with_clashing_names(spark):
    names = ["doc_id", "text", "marker", "_marker", "row", "norm", "_digest", "_print", "_keep", "salt", "id", "group_size"]
    frame = spark.createDataFrame([(7, "same", *range(10)), (7, "same", *range(10)), (7, "same", *range(10)), (5, "Same", *range(10))], ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    kept = keep_winners(frame)
    assert kept.columns == names and [(r.doc_id, r.text) for r in kept.collect()] == [(7, "same")]


def test_exact_dedup_is_native(spark):
    plan = exact_dedup(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_lines(rows, min_docs, min_chars=1, rule="common"):
    key = lambda line: line.strip(b" \t\n\x0b\x0c\r").lower()
    where = defaultdict(set)
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for p, line in enumerate((t or "").encode().split(b"\n")):
            where[key(line)].add(d)
            first.setdefault(key(line), (d, p))
    out = []
    for d, t in rows:
        lines = (t or "").encode().split(b"\n")
        long = [len(key(x).decode()) >= min_chars for x in lines]
        gone = [ok and (len(where[key(x)]) >= min_docs if rule == "common" else first[key(x)] != (d, p)) for p, (x, ok) in enumerate(zip(lines, long))]
        kept = b"\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rule", ["common", "first"])
@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_brute_force(spark, seed, rule):
    rng = random.Random(seed)
    pool = [f"Line {i}" for i in range(40)] + ["", "  ", "hot line", "HOT line\t", "É x", "é x"]
    rows = []
    for d in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 25))] + ["hot line"] * (d % 3 != 0)
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    found = line_dedup(frame(spark, rows).repartition(7), min_docs=10, rule=rule).collect()
    assert sorted(map(tuple, found), key=repr) == brute_lines(rows, 10, rule=rule)


def test_line_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a\nb"), (5, "A \nc"), (5, "a\nd"), (6, "x" * 100_000 + "\na"), (None, "a"), (None, "a"), (4, "a\nb")]
    found = line_dedup(frame(spark, rows), min_docs=4, with_text=True).collect()
    assert sorted([tuple(r)[:4] for r in found], key=repr) == brute_lines(rows, 4)
    assert {r.text for r in found if r.doc_id == 4} == {"b"}
    assert line_dedup(frame(spark, [])).collect() == []
    assert keep_bitmaps(frame(spark, [(1, "a")])).collect() == []
    with pytest.raises(ValueError):
        keep_bitmaps(frame(spark, []), rule="other")


def test_short_keys_stay(spark):
    rows = [(d, "ab\nabc\né€") for d in range(5)]
    found = line_dedup(frame(spark, rows), min_docs=5, min_chars=3).collect()
    assert {r.n_dropped for r in found} == {1}
