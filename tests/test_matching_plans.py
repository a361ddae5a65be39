"""Matches of two results: equal to the greedy ones by brute force, without broadcasts of written places."""

import random
from difflib import SequenceMatcher

import pytest

from paperloom.operators import audit, compare


def greedy(a, b, least):
    """Best score first, ties to the higher a, then b."""
    plain = lambda t: (t or "").lower().strip()
    near = [(SequenceMatcher(None, plain(x), plain(y)).ratio(), d, i, j) for d, i, x in a for e, j, y in b if d == e]
    used_a, used_b, out = set(), set(), set()
    for score, d, i, j in sorted(near, key=lambda r: (r[0], r[2], r[3]), reverse=True):
        if score >= least and (d, i) not in used_a and (d, j) not in used_b:
            used_a.add((d, i))
            used_b.add((d, j))
            out.add((d, i, j, score))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_items_match_greedily(spark, seed):
    draw = random.Random(seed)
    names = ["Liens", " LIENS ", "Lien", "Debt", "Debts", "debt cover", "Debt Cover", "", None, "Transfers"]
    a, b = ([(d, i, draw.choice(names)) for d in range(5) for i in range(draw.randrange(12))] for _ in range(2))
    frames = [spark.createDataFrame(rows, "doc_id int, item_idx int, name string") for rows in (a, b)]
    pairs, only_a, only_b = compare.match_items(*frames)
    expected = greedy(a, b, compare.LEAST_NAME)
    assert {tuple(r) for r in pairs.collect()} == expected
    assert {(r.doc_id, r.item_idx) for r in only_a.collect()} == {x[:2] for x in a} - {x[:2] for x in expected}
    assert {(r.doc_id, r.item_idx) for r in only_b.collect()} == {x[:2] for x in b} - {(x[0], x[2]) for x in expected}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_places_are_not_broadcast(spark):
    kind = "doc_id int, item_idx int, name string, summary string, exceptions array<string>"
    a = spark.createDataFrame([(d, 0, "Liens", "none", ["$1", "$2"]) for d in range(9)], kind)
    pairs, only_a, only_b = compare.match_items(a, a)
    listed = spark.createDataFrame([(d, i, f"${i}") for d in range(9) for i in range(3)], "k int, idx int, raw string")
    matched, left_a, left_b = compare.match_exceptions(listed, listed, ["k"])
    for df in (only_a, only_b, compare.sides(pairs, a, a), left_a, left_b, compare.restrictions(a, a), compare.overlap(a, a)):
        assert "BroadcastHashJoin" not in plan(df)


def test_no_python_call_for_each_group(spark):
    rows = [(g, i, j, 1.0 - ((i * 7 + j * 3) % 10) / 20) for g in range(3) for i in range(6) for j in range(6)]
    got = audit.best_first_matches(spark.createDataFrame(rows, "g int, a int, b int, score double"), "g", "a", "b", "score", 0.6)
    assert "FlatMapGroups" not in plan(got)
    used_a, used_b, expected = set(), set(), set()
    for g, i, j, s in sorted(rows, key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if s >= 0.6 and (g, i) not in used_a and (g, j) not in used_b:
            used_a.add((g, i))
            used_b.add((g, j))
            expected.add((g, i, j, s))
    assert {tuple(r) for r in got.collect()} == expected
