"""Connected components and joins with hot keys."""

import random

import pytest

from paperloom.plans import skew
from paperloom.plans.components import connected_components


def plain_components(links):
    low = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            low.setdefault(a, a)
            low.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in low and b in low and a != b and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    nodes = [draw.randrange(-1000, 1000) for _ in range(120)]
    links = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(90)]
    links += list(zip(range(5000, 5040), range(5001, 5041), strict=True))  # a chain
    links += [(7000, i) for i in range(7001, 7060)]  # a star
    links += [(1, 1), (None, 5), (5, None), links[0], links[0][::-1]]
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == plain_components(links)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_by_key(spark, monkeypatch, how):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 50}", None if i % 7 == 0 else 1) for i in range(400)] + [(1000, None, 1)], "id int, key string, `a b` int")
    found = spark.createDataFrame([(f"k{i}", i, "x") for i in range(30)] + [("hot", 99, None)], "key string, value int, other string")
    expected = rows.join(found, "key", how).select("id", "key", "a b", "value", "other")
    for limit in (1000, 0):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
        got = skew.join_by_key(rows, found, ["key"], ["id"], how)
        assert got.columns == expected.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_hot_keys_are_few(spark):
    rows = spark.createDataFrame([("a" if i < 300 else f"b{i}",) for i in range(900)], "key string")
    assert [r.key for r in skew.hot_keys(rows, ["key"], 100).collect()] == ["a"]


def test_free_name():
    assert skew.free_name(["a", "_A"], "a") == "__a"
    assert skew.free_name(["b"], "a") == "a"
