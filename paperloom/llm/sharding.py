"""Shards of equal bytes by histogram sort.

Documents are ordered by ``(hash of the text, doc_id)``, so equal texts lie side by side. Splitters
of that order are found without sorting: each round counts the exact bytes between candidate
boundaries in every partition, adds the partial counts up, and puts new candidates only into the
intervals that still hold a target; it ends when each splitter is within its tolerance. A splitter
stands between two groups of equal texts where that meets the tolerance, otherwise inside a group,
at a ``doc_id``. Then rows are exchanged once, to parts of a shard that were found in the same way,
and numbered. What comes to the driver is bounded by the number of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import free_name
from ..plans.stage import materialize

SHARDS = 24
#: Rows of a part of a shard, and text bytes of a part of a written shard: each is sorted by a task of its own.
LEAST_PARTS = 8
PART_ROWS = 1_000_000
PART_BYTES = 256 << 20
#: How far a shard's border may be from its target, as a share of a shard's bytes.
TOLERANCE = 0.002
#: The same for borders between the parts of a shard, as a share of a part's bytes.
PART_TOLERANCE = 0.1
#: Candidates in each interval that is still open, at most, and in all of them together.
PROBES = 64
ALL_PROBES = 1 << 18
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes (null: none) plus eight."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, k, d``: a row's numbers and its place in the order. A null ``doc_id`` comes first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        size_of().alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d"),
    )


def _cuts(low: int, high: int, n: int) -> list[int]:
    """Up to ``n`` values that cut ``low..high`` evenly: starts of the intervals after the first."""
    width = -(-(high - low + 1) // (n + 1))
    return list(range(low + width, high + 1, width))


def _count(rows: DataFrame, groups: dict[int | None, list[int]]) -> dict[tuple[int | None, int], int]:
    """Exact bytes between candidates, by group and interval; group ``None`` cuts the hashes, a hash its ``doc_id``s."""
    bounds = {g: np.array(v, np.int64) for g, v in groups.items()}
    inner = [g for g in groups if g is not None]
    number = {g: i for i, g in enumerate(groups)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g: np.zeros(len(b) + 1, np.int64) for g, b in bounds.items()}
        for batch in batches:
            k, d, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if None in bounds:
                np.add.at(sums[None], np.searchsorted(bounds[None], k, "right"), size)
            for g in inner:
                own = k == g
                if own.any():
                    np.add.at(sums[g], np.searchsorted(bounds[g], d[own], "right"), size[own])
        for g, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number[g], np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at])], ["g", "i", "bytes"])

    names = list(groups)
    found = rows.select("k", "d", "size").mapInArrow(run, "g int, i int, bytes long").groupBy("g", "i").agg(F.sum("bytes").alias("bytes"))
    return {(names[r["g"]], r["i"]): r["bytes"] for r in found.collect()}


def splitters(rows: DataFrame, shards: int = SHARDS, parts: int = 1) -> list[tuple[int, int]]:
    """The ``shards * parts - 1`` least places ``(k, d)`` of all parts but the first, ascending.

    ``rows`` should be a written table: every round reads it.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    n = shards * parts
    targets = [(total * i / n, (TOLERANCE * total / shards) if i % parts == 0 else PART_TOLERANCE * total / n) for i in range(1, n)]
    # Each open target has its interval (group, low, high, bytes below); group None: hashes.
    found: dict[int, tuple[int, int]] = {}
    open_: dict[int, tuple[int | None, int, int, int]] = {i: (None, LOW, HIGH, 0) for i in range(len(targets))}
    if not total:
        return [(HIGH, HIGH)] * len(targets)
    while open_:
        groups: dict[int | None, set[int]] = {}
        intervals = set(open_.values())
        each = max(3, min(PROBES, ALL_PROBES // len(intervals)))
        for g, low, high, _ in intervals:
            many = 16 * PROBES if high - low > 1 << 62 else each
            groups.setdefault(g, set()).update([low, *_cuts(low, high, many), *([high + 1] if high < HIGH else [])])
        candidates = {g: sorted(v - {LOW}) for g, v in groups.items()}
        counts = _count(rows, candidates)
        for i, (g, low, high, below) in list(open_.items()):
            target, tolerance = targets[i]
            own = candidates[g]
            starts = [low, *(c for c in own if low < c <= high)]
            first = np.searchsorted(own, low, "right") if low > LOW or (own and own[0] == LOW) else 0
            sizes = [counts.get((g, int(first) + j), 0) for j in range(len(starts))]
            at = below
            for j, size in enumerate(sizes):
                if at + size >= target or j == len(sizes) - 1:
                    break
                at += size
            start, end = starts[j], (starts[j + 1] - 1 if j + 1 < len(starts) else high)
            near_end = at + size - target < target - at
            gap = min(abs(at - target), abs(at + size - target))
            if gap <= tolerance or (start == end and g is not None):
                cut = end + 1 if near_end and end < HIGH else start
                if g is None:
                    found[i] = (cut, LOW)
                else:
                    found[i] = (g, cut) if cut <= HIGH else (g + 1, LOW)
                del open_[i]
            elif start == end:
                open_[i] = (start, LOW, HIGH, at)  # inside one group of equal texts
            else:
                open_[i] = (g, start, end, at)
    return list(accumulate((found[i] for i in range(len(targets))), max))


def parts_of(k: np.ndarray, d: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """How many of ``cuts`` are at or before each place."""
    ks = np.array([c[0] for c in cuts], np.int64)
    out = np.searchsorted(ks, k, "left")
    ends = np.searchsorted(ks, k, "right")
    for i in np.flatnonzero(out < ends).tolist():
        a, b = int(out[i]), int(ends[i])
        out[i] = a + sum(cuts[j][1] <= d[i] for j in range(a, b))
    return out.astype(np.int32)


def with_parts(rows: DataFrame, cuts: list[tuple[int, int]], first: np.ndarray | None = None, k: str = "k", d: str = "d", part: str = "part") -> DataFrame:
    """``rows`` (with ``k, d``) and ``part``, the number of the part that a row goes to; with ``first`` also ``before``, its value for the part."""
    names = rows.columns
    at_k, at_d = names.index(k), names.index(d)
    shared = rows.sparkSession.sparkContext.broadcast((cuts, first))
    made = [part, "before"] if first is not None else [part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, first = shared.value
        for batch in batches:
            of = parts_of(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (at_k, at_d)), cuts)
            new = [pa.array(of)] if first is None else [pa.array(of), pa.array(first[of])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, *made])

    kinds = [T.StructField(n, t) for n, t in zip(made, (T.IntegerType(), T.LongType()), strict=False)]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *kinds]))


def shard_rows(docs: DataFrame, shards: int = SHARDS, parts: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of each row of ``docs(doc_id, text)``.

    ``slot`` runs from 0 without gaps over each shard, in the order of the sort. Null text has no
    bytes; repeated rows each get a slot (rows alike in text and id aren't divided between shards);
    other columns are ignored; an empty table gives an empty result. ``parts`` of a shard follow from
    the number of rows unless given; they decide who sorts, not what comes out.
    """
    rows = materialize(keyed(docs), "shard-keys")
    parts = parts or max(LEAST_PARTS, -(-rows.count() // (shards * PART_ROWS)))
    cuts = splitters(rows, shards, parts)
    # One row for each part.
    counts = {r["part"]: r["n"] for r in with_parts(rows, cuts).groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = np.zeros(shards * parts, np.int64)
    for p in range(shards * parts):
        before[p] = 0 if p % parts == 0 else before[p - 1] + counts.get(p - 1, 0)
    dealt = with_parts(rows, cuts, before)
    order = Window.partitionBy("part").orderBy("k", "d", "size")
    slot = F.col("before") + F.row_number().over(order) - 1
    return dealt.select("doc_id", "size", "text_crc32", F.floor(F.col("part") / parts).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, parts: int | None = None, shard: str = "shard") -> None:
    """Writes whole rows of ``docs`` as Parquet under ``path/shard=N``, sorted, after one exchange.

    All columns of ``docs`` are written; one that is named like ``shard`` (in any case) is an error,
    since the folders have that name. Nulls, repeated rows and empty tables as in ``shard_rows``.
    """
    if shard.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the rows have a column {shard}; give another name for the folders")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(keyed(docs).select("k", "d", "size"), "shard-keys")
    if parts is None:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
        parts = max(LEAST_PARTS, -(-total // (shards * PART_BYTES)))
    k, d, part = (free_name([*docs.columns, shard], n) for n in ("k", "d", "part"))
    whole = docs.withColumns({k: F.xxhash64(text), d: F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))})
    dealt = with_parts(whole, splitters(rows, shards, parts), k=k, d=d, part=part).withColumn(shard, F.floor(F.col(part) / parts).cast("int"))
    dealt.repartition(shards * parts, part).sortWithinPartitions(shard, part, k, d).drop(k, d, part).write.partitionBy(shard).parquet(path)
