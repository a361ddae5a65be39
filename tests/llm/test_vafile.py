"""Exact top-k against brute force over whole tables."""

import math
import random

import numpy as np
import pytest

from paperloom.llm import vafile

KIND = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, every=100, k=10):
    """Each row's own ranking, by unbounded integers; rows that share an id are rows of their own."""
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(usable):
        if q % every == 0:
            scores = sorted((-sum(s * t for s, t in zip(x, y, strict=False)), i) for b, (i, y) in enumerate(usable) if b != a)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, **params):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND).repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vafile.top_k(table, **params).collect())


def clustered(n, dims=16, seed=5):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dims))
    return [(i, (centres[i % 12] + 0.3 * draw.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def test_against_brute_force(spark):
    rows = clustered(900)
    assert found(spark, rows, block=128) == brute(rows)


def test_nulls_ties_repeats_and_lengths(spark):
    rows = clustered(150, 6)
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]  # many copies of three vectors
    rows += [(200, rows[0][1]), (200, rows[0][1]), (200, rows[1][1]), (-300, rows[2][1])]  # repeated ids, a negative one
    rows += [(None, rows[0][1]), (300, None), (400, [1.0, None, 2.0]), (500, [1.0, float("nan")]), (600, [float("inf")]), (700, []), (800, [0.5]), (900, [0.5] * 9)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows, block=32) == brute(rows)


def test_few_rows_and_empty_tables(spark):
    assert found(spark, [(100, [1.0, 2.0])]) == []
    assert found(spark, [(100, [1.0, 2.0]), (7, [-1.0, 0.0])]) == brute([(100, [1.0, 2.0]), (7, [-1.0, 0.0])])
    assert found(spark, [(7, [1.0]), (8, [2.0])]) == []
    assert found(spark, []) == []


def test_large_values(spark):
    """Scores near the end of a long's range are exact; what doesn't fit is an error, not a wrong number."""
    rows = [(100, [2.0**20, 1.0]), (1, [2.0**22 + 1, 3.0]), (2, [2.0**22 + 2, 3.0]), (3, [-(2.0**22), 0.5])]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="fit a long"):
        found(spark, [(100, [2.0**40]), (1, [2.0**40])])
    with pytest.raises(Exception, match="2\\*\\*61"):
        found(spark, [(100, [2.0**52]), (1, [1.0])])


def test_groups_of_queries_run_in_rounds(spark):
    rows = clustered(400)
    assert found(spark, rows, every=10, queries=7, block=64) == brute(rows, every=10)


def test_few_exact_vectors_are_read(spark):
    """Bounds leave a small share of all pairs, also when a third of the rows are copies of one vector; no query keeps many copies."""
    rows = clustered(4000, 24, seed=9)
    rows = [(i, rows[5][1] if i % 3 == 1 else v) for i, v in rows]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND).repartition(4)
    cells, exact = vafile.approximation_file(table, block=512)
    asked = exact.where("vec_id % 100 = 0").toArrow()
    matrix = vafile.padded([np.frombuffer(v, "<i8") for v in asked["vector"].to_pylist()], 24)
    answers, read = vafile.search(cells, exact, asked["at"].to_numpy(), matrix, 10, 512)
    assert answers.count() == 10 * len(matrix)
    assert read <= 0.05 * len(matrix) * len(rows)


def test_bounds_hold():
    draw = np.random.default_rng(2)
    x = draw.integers(-5000, 5000, (200, 7))
    least = x.min(axis=0)
    width = (x.max(axis=0) - least) // vafile.CELLS + 1
    q = draw.integers(-5000, 5000, (9, 7)).astype(np.float64)
    lower, upper = vafile.bounds(q, ((x - least) // width).astype(np.float64), least.astype(np.float64), width.astype(np.float64))
    scores = q @ x.T
    assert (lower <= scores).all() and (scores <= upper).all()
