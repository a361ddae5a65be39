"""Best-fit packing of token sequences.

Documents become pieces of at most ``capacity`` tokens; pieces are packed by best-fit decreasing:
longest first, each into the open sequence with the least room that still holds it. The choice
only depends on lengths, and equal lengths are interchangeable, so the plan is made from the
histogram of lengths (at most ``capacity`` numbers, whatever the input's size). A segment tree
over remaining capacities finds the tightest open sequence in logarithmic time; a run of equal
pieces that meets a run of equally full sequences is placed at once, which gives what placing them
one by one would give. Pieces then take their place in the plan by their rank among the pieces of
their length, which is counted in groups of about ``GROUP`` pieces: a length that most pieces share
is dealt to as many tasks as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import free_name
from ..plans.stage import materialize
from .wordids import END_ID, encoded

CAPACITY = 4096
#: Pieces of one length that are ranked together, on average, once the length has ``SALTS`` groups.
GROUP = 50_000
#: Groups of a length up to which they may be smaller, down to ``LEAST_GROUP`` pieces.
SALTS, LEAST_GROUP = 64, 500
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class RoomTree:
    """A segment tree over remaining capacities 0..capacity; a leaf counts the runs of open sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.counts[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open sequence has."""
        at = self.leaves + length
        if self.counts[at]:
            return length
        while at > 1:
            if not at & 1 and self.counts[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.counts[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first rank, count, first sequence, offset)`` of best-fit decreasing.

    The piece of that length with rank ``first rank + i`` goes to sequence ``first sequence + i``
    at ``offset``. Among equally tight sequences the ones opened or filled last go first.
    """
    tree, runs = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    plan, opened = [], 0
    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit a sequence of {capacity}")
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -1)
                each = room // length
            # A sequence that got one piece is now the tightest for the next, until it's full.
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            for k in range(each):
                count = full + (k < rest)
                if count:
                    plan.append((length, rank, count, first, capacity - room + k * length))
                    rank += count
            left -= full * each + rest
            part = int(rest > 0)
            for at, count, still in (
                (first, full, room - each * length),
                (first + full, part, room - rest * length),
                (first + full + part, n - full - part, room),
            ):
                if count and still:
                    runs[still].append((at, count))
                    tree.add(still, 1)
    return plan


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``. Null text counts as empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch, flat, ends in encoded(batches, tokenizer_path):
            raw = memoryview(flat.tobytes())
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                n = b - a + 1
                for k, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    crc = zlib.crc32(raw[4 * (a + start) : 4 * min(b, a + start + size)])
                    rows.append((doc, k, start, size, zlib.crc32(end, crc) if start + size == n else crc))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def groups_of(n: int, group: int = GROUP) -> int:
    """Into how many groups the ``n`` pieces of a length are dealt for ranking."""
    return max(min(SALTS, -(-n // LEAST_GROUP)), -(-n // group))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Needs ``doc_id, piece, length``; other columns stay, except that ``sequence_id`` and ``offset``
    are replaced. Equal rows (one document given twice) each get a place of their own; a null
    ``doc_id`` is a document like any other. Lengths from 1 to ``capacity``; an empty table gives an
    empty table.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    written = materialize(pieces, "pieces")
    salt, rank = free_name(pieces.columns, "salt"), free_name(pieces.columns, "rank_in_group")
    # At most ``capacity`` rows.
    sizes = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count("*").alias("n")).collect()}
    dealt = F.broadcast(spark.createDataFrame([(n, groups_of(c, group)) for n, c in sorted(sizes.items())], "length long, groups int"))
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups")).cast("int")
    salted = written.join(dealt, "length").withColumn(salt, spread).select(*[F.col(f"`{c}`") for c in pieces.columns], salt)
    # One row for each group: at most ``capacity * SALTS`` and one for each ``group`` pieces.
    counts = salted.groupBy("length", salt).agg(F.count("*").alias("n")).orderBy("length", salt).toPandas()
    plan = best_fit_plan(sizes, capacity)
    # The groups of a length stand one after the other from its base; each with the rank of its first piece.
    bases = np.zeros(capacity + 2, np.int64)
    for n, c in sizes.items():
        bases[n + 1] = groups_of(c, group)
    bases = np.cumsum(bases)
    first_rank = np.zeros(int(bases[-1]), np.int64)
    lengths = counts["length"].to_numpy(np.int64)
    held = np.cumsum(counts["n"].to_numpy(np.int64)) - counts["n"].to_numpy(np.int64)
    first_rank[bases[lengths] + counts[salt].to_numpy(np.int64)] = held - held[np.searchsorted(lengths, lengths)]
    order = sorted(range(len(plan)), key=lambda i: plan[i][:2])
    table = np.array([plan[i] for i in order], np.int64).reshape(-1, 5)
    bounds = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((bases, first_rank, table[:, 1].copy(), table[:, 3].copy(), table[:, 4].copy(), bounds))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, first_rank, ranks, sequences, offsets, bounds = shared.value
        for batch in batches:
            cols = {f.name: c for f, c in zip(batch.schema, batch.columns, strict=True)}
            length = cols["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            of_length = first_rank[bases[length] + cols[salt].to_numpy(zero_copy_only=False)] + cols[rank].to_numpy(zero_copy_only=False) - 1
            at = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                at[own] = bounds[n] + np.searchsorted(ranks[bounds[n] : bounds[n + 1]], of_length[own], "right") - 1
            kept = [(k, c) for k, c in cols.items() if k not in (salt, rank)]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in kept] + [pa.array(sequences[at] + of_length - ranks[at]), pa.array(offsets[at])],
                [k for k, _ in kept] + ["sequence_id", "offset"],
            )

    own = Window.partitionBy("length", salt).orderBy("doc_id", "piece", *[F.col(f"`{c}`") for c in pieces.columns if c not in ("doc_id", "piece", "length")])
    ranked = salted.withColumn(rank, F.row_number().over(own))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Encodes, cuts and packs ``docs(doc_id, text)``.

    Null text is empty and becomes a piece of the end id alone; repeated rows and null ids are
    documents of their own; other columns are ignored; an empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity)
