"""Exact top-k search by inner product over a vector-approximation file.

Components become integers. Vectors are numbered in blocks; the file has two tables. ``cells`` holds
a row for each block with one byte for each component: its cell in an even grid between the block's
least and largest value of that dimension. ``exact`` holds a row of integers for each vector.

Queries are taken in groups of bounded size, in rounds; what a round finds is written before the
next. A round scans the cells only: the corners of a cell bound each score from both sides, and a
vector remains if its upper bound reaches the k-th lower bound. Then exact vectors are read in the
order of their upper bounds: the first few of each query give a k-th score, and of the rest only
those whose upper bound still reaches it are read. So each k-th result is certain.

Of many copies of a vector only those with the ``k + 1`` least ids can be among the k best (one may
be the query itself). The cells mark the others as spare: they are in the file, but no candidates,
so copies don't multiply what remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import join_by_key, small
from ..plans.stage import fresh_path, materialize, remove_at_exit

SCALE = 1024
K = 10
#: Vectors in a block.
BLOCK = 4096
CELLS = 256
#: Queries in a group, on average, and the bytes of their components; a group is broadcast.
QUERIES, QUERY_BYTES = 8192, 8 << 20
#: Queries whose bounds over a block are in memory together.
AT_ONCE = 256
#: Candidates that a task holds before it drops those below the bar it has reached.
HELD = 1 << 20
#: Exact vectors of a query that are read first, as a multiple of ``k``.
FIRST = 4
#: Parts in which the copies of one vector are ranked first.
SALTS = 64
#: Scaled components must be below this in size, so that their differences fit a long.
MOST = 1 << 61
FILE = "exact boolean, block long, n int, dims int, cells binary, least binary, width binary, spare binary, at long, vec_id long, vector binary"


def scaled(vectors: pa.ListArray, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part, and their components as integers: ``floor(scale * x)``.

    Null vectors and vectors with null or non-finite components take no part; a component whose
    scaled size is 2**61 or more is an error.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(vectors)), sizes)
    good = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    good[row[~np.isfinite(x)]] = False
    with np.errstate(over="ignore"):
        whole = np.floor(scale * x[good[row]])
    if (np.abs(whole) >= MOST).any():
        raise OverflowError("a scaled component has a size of 2**61 or more")
    return np.flatnonzero(good), np.split(whole.astype(np.int64), np.cumsum(sizes[good])[:-1])


def padded(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """A matrix; shorter vectors get zeros."""
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def block_rows(block: int, ids: list[int], vectors: list[np.ndarray], spare: list[bool], size: int) -> Iterator[dict]:
    """The file's rows of one block: its cells, then its exact vectors."""
    x = padded(vectors, max(map(len, vectors)))
    least = x.min(axis=0)
    width = (x.max(axis=0) - least) // CELLS + 1
    cells = ((x - least) // width).astype(np.uint8)
    yield {
        "exact": False, "block": block, "n": len(ids), "dims": x.shape[1], "cells": cells.tobytes(),
        "least": least.tobytes(), "width": width.tobytes(), "spare": bytes(spare),
    }
    for i, (vec_id, v) in enumerate(zip(ids, vectors, strict=True)):
        yield {"exact": True, "at": block * size + i, "vec_id": vec_id, "vector": v.astype("<i8").tobytes()}


def with_spare(rows: DataFrame, k: int) -> DataFrame:
    """``rows(vec_id, embedding)`` with ``spare``: more than ``k`` rows with equal vectors have smaller ids.

    Only vectors whose hash has more than ``k + 1`` rows are grouped, by the vector itself, and the
    rows of each in salted parts first.
    """
    hashed = rows.withColumn("hash", F.xxhash64("embedding"))
    many = materialize(hashed.where("embedding IS NOT NULL").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("hash"), "copied")
    if not many.head(1):
        return rows.withColumn("spare", F.lit(False))
    found = hashed.where("embedding IS NOT NULL").join(small(many), "hash", "left_semi").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    part = Window.partitionBy("hash", "embedding", "salt").orderBy("vec_id")
    first = found.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= k + 1)
    whole = Window.partitionBy("hash", "embedding").orderBy("vec_id")
    limits = first.withColumn("nth", F.row_number().over(whole)).where(F.col("nth") == k + 1).select("hash", "embedding", F.col("vec_id").alias("last"))
    joined = join_by_key(hashed, materialize(limits, "last-copies"), ["hash", "embedding"], ["vec_id"], counted=hashed.select("hash", "embedding"))
    return joined.select("vec_id", "embedding", F.coalesce(F.col("vec_id") > F.col("last"), F.lit(False)).alias("spare"))


def approximation_file(vectors: DataFrame, scale: int = SCALE, block: int = BLOCK, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The written tables ``cells(block, n, dims, cells, least, width, spare)`` and ``exact(at, vec_id, vector)`` of ``vectors(vec_id, embedding)``.

    ``at`` is the number of the block times ``block`` plus the place in it. Rows without an id and
    those that ``scaled`` leaves out are in neither. The file serves searches for up to ``k`` results.
    """
    spark = vectors.sparkSession
    kinds = {"exact": pa.bool_(), "block": pa.int64(), "n": pa.int32(), "dims": pa.int32(), "at": pa.int64(), "vec_id": pa.int64()}
    schema = pa.schema([(name, kinds.get(name, pa.binary())) for name in (c.split()[0] for c in FILE.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list[int] = []
        own: list[np.ndarray] = []
        spare: list[bool] = []
        for batch in batches:
            kept, found = scaled(batch.column(1), scale)
            ids += batch.column(0).to_numpy(zero_copy_only=False)[kept].tolist()
            spare += batch.column(2).to_numpy(zero_copy_only=False)[kept].tolist()
            own += found if len(kept) else []
            while len(ids) >= block:
                yield pa.RecordBatch.from_pylist(list(block_rows(number, ids[:block], own[:block], spare[:block], block)), schema)
                ids, own, spare, number = ids[block:], own[block:], spare[block:], number + 1
        if ids:
            yield pa.RecordBatch.from_pylist(list(block_rows(number, ids, own, spare, block)), schema)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL")
    path = fresh_path(spark, "approximation-file")
    with_spare(rows, k).mapInArrow(run, FILE).write.option("compression", "zstd").partitionBy("exact").parquet(path)
    remove_at_exit(spark, path)
    read = spark.read.schema(FILE).parquet(path)
    cells = read.where("NOT exact").select("block", "n", "dims", "cells", "least", "width", "spare")
    return cells, read.where("exact").select("at", "vec_id", "vector")


def bounds(queries: np.ndarray, cells: np.ndarray, least: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above each score of ``queries`` with the vectors in ``cells``; all as doubles, rounding allowed for."""
    low = (queries * width) @ cells.T
    low += (queries @ least)[:, None]
    slack = 1e-12 * (np.abs(queries) @ (np.abs(least) + width * CELLS))
    inner = np.maximum(queries, 0) @ (width - 1)
    outer = np.minimum(queries, 0) @ (width - 1)
    return low + (outer - slack)[:, None], low + (inner + slack)[:, None]


def fitted(matrix: np.ndarray, dims: int) -> np.ndarray:
    """The matrix with ``dims`` columns; missing ones are zero."""
    return matrix[:, :dims] if matrix.shape[1] >= dims else np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1])))


CANDIDATES = "q int, at long, upper double, lower double"


def scan_cells(places: np.ndarray, matrix: np.ndarray, k: int, size: int, blocks: Iterator[tuple]) -> tuple[np.ndarray, ...]:
    """``q, at, upper, lower`` of the vectors in ``blocks`` that may be among the k best of a query."""
    queries = matrix.astype(np.float64)
    best = np.full((len(queries), k), -np.inf)  # the k largest lower bounds of each query
    held: list[tuple[np.ndarray, ...]] = []

    def above(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        if not parts:
            return []
        q, at, upper, lower = (np.concatenate(c) for c in zip(*parts, strict=True))
        keep = upper >= best.min(axis=1)[q]
        return [(q[keep], at[keep], upper[keep], lower[keep])]

    for block, n, dims, cells, least, width, spare in blocks:
        there = np.flatnonzero(np.frombuffer(spare, np.uint8) == 0)
        at = block * size + there
        own = np.frombuffer(cells, np.uint8).reshape(n, dims)[there].astype(np.float64)
        least, width = np.frombuffer(least, "<i8").astype(np.float64), np.frombuffer(width, "<i8").astype(np.float64)
        of_block = fitted(queries, dims)
        for a in range(0, len(queries), AT_ONCE):
            z = min(a + AT_ONCE, len(queries))
            lower, upper = bounds(of_block[a:z], own, least, width)
            itself = at[None, :] == places[a:z, None]
            lower[itself] = upper[itself] = -np.inf
            best[a:z] = np.partition(np.concatenate((best[a:z], lower), axis=1), -k, axis=1)[:, -k:]
            # Minus infinity is no candidate, also as long as there's no bar.
            i, j = np.nonzero((upper >= best[a:z].min(axis=1)[:, None]) & ~itself)
            held.append(((a + i).astype(np.int32), at[j], upper[i, j], lower[i, j]))
        if sum(len(p[0]) for p in held) > HELD:
            held = above(held)
    held = above(held)
    return held[0] if held else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """``q, bar``: the k-th largest value of each query; null if it has fewer."""
    order = Window.partitionBy("q").orderBy(F.desc(value))
    top = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return top.groupBy("q").agg(F.when(F.count("*") == k, F.min(value)).alias("bar"))


def candidates(cells: DataFrame, places: np.ndarray, matrix: np.ndarray, k: int, block: int = BLOCK) -> DataFrame:
    """``q, at, upper, nth``, written: the vectors whose upper bound reaches the k-th lower bound of the query, numbered by upper bound."""
    shared = cells.sparkSession.sparkContext.broadcast((places, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in scan_cells(*shared.value, k, block, blocks)], ["q", "at", "upper", "lower"])

    found = materialize(cells.select("block", "n", "dims", "cells", "least", "width", "spare").mapInArrow(run, CANDIDATES), "cell-bounds")
    # One row for each query of the group.
    near = found.join(F.broadcast(kth(found, "lower", k)), "q").where("bar IS NULL OR upper >= bar")
    order = Window.partitionBy("q").orderBy(F.desc("upper"), "at")
    return materialize(near.select("q", "at", "upper", F.row_number().over(order).alias("nth")), "candidates")


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row; by unbounded integers where a long might overflow, and an error if one does."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1) < 2.0**62:
        return (x * q).sum(axis=1)
    whole = [sum(a * b for a, b in zip(r, s, strict=True)) for r, s in zip(x.tolist(), q.tolist(), strict=True)]
    if any(not -(1 << 63) <= s < 1 << 63 for s in whole):
        raise OverflowError("a score doesn't fit a long")
    return np.array(whole, np.int64)


def scored(near: DataFrame, exact: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``q, at, vec_id, score``, written, of the pairs ``near(q, at)``; only their vectors leave the scan."""
    shared = near.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for batch in batches:
            q = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)
            scores = np.zeros(len(q), np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(batch.column(3).take(pa.array(rows)).to_pylist()), "<i8").reshape(len(rows), size // 8)
                scores[rows] = exact_scores(x, fitted(matrix, size // 8)[q[rows]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores)], ["q", "at", "vec_id", "score"])

    pairs = exact.join(small(near.select("q", "at")), "at").select("q", "at", "vec_id", "vector")
    return materialize(pairs.mapInArrow(run, "q int, at long, vec_id long, score long"), "scores")


def search(cells: DataFrame, exact: DataFrame, places: np.ndarray, matrix: np.ndarray, k: int = K, block: int = BLOCK) -> tuple[DataFrame, int]:
    """``q, rank, vec_id, score`` of one group of queries, and how many exact vectors were read for them."""
    near = candidates(cells, places, matrix, k, block)
    first = scored(materialize(near.where(F.col("nth") <= FIRST * k), "first"), exact, matrix)
    rest = near.where(F.col("nth") > FIRST * k).join(F.broadcast(kth(first, "score", k)), "q").where("bar IS NULL OR upper >= bar")
    both = first.union(scored(materialize(rest, "rest"), exact, matrix))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "at")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "vec_id", "score")
    return ranked, both.count()


def top_k(vectors: DataFrame, every: int = 100, k: int = K, scale: int = SCALE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each row whose id ``every`` divides.

    Ties go to the smaller id. Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; shorter vectors count as zero where they end. Rows that share an id
    are rows of their own: each asks, and each is a candidate for the others. Components whose scaled
    size is 2**61 or more, and scores that don't fit a long, are errors. Other columns are ignored;
    empty tables give an empty result.
    """
    spark = vectors.sparkSession
    cells, exact = approximation_file(vectors, scale, block, k)
    asked = materialize(exact.where(F.col("vec_id") % every == 0), "queries")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("vector")), F.lit(0)).alias("bytes")).first()
    each = max(1, min(queries, QUERY_BYTES // max(size["bytes"], 8)))
    groups = -(-size["n"] // each)
    path = fresh_path(spark, "answers")
    for g in range(groups):
        # About ``each`` rows.
        own = asked.where(F.pmod(F.xxhash64("at"), F.lit(groups)) == g).toArrow()
        if not len(own):
            continue
        matrix = padded([np.frombuffer(v, "<i8") for v in own["vector"].to_pylist()], size["bytes"] // 8)
        found, _ = search(cells, exact, own["at"].to_numpy(), matrix, k, block)
        names = F.broadcast(spark.createDataFrame(list(enumerate(own["vec_id"].to_pylist())), "q int, query_id long"))
        found.join(names, "q").select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    remove_at_exit(spark, path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
