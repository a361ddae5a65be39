"""SimHash fingerprints, linked by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most
two bits, either their first segments differ in at most one bit or their second segments agree;
so each fingerprint looks up the Hamming ball of radius one around its first segment and its own
second segment in the tables of segment values, and complete distances are verified. Of two first
segments that differ in one bit only the one with the zero bit looks, so a pair is met once.

Everything runs over distinct fingerprints: exact copies and repeated fingerprints cost one row.
A group of near copies can still fill a table entry with thousands of fingerprints, whose pairs
would grow with the square. Entries above ``CROWD`` fingerprints aren't expanded: every fingerprint
that looks into one lists the 65 members of its complete ball of radius one instead. Two
fingerprints differ in at most two bits exactly if those balls share a member, a member has at most
65 owners, and linking each owner to the first loses no link between components. So the rows stay
in proportion to the fingerprints and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.skew import join_by_key, small
from ..plans.stage import materialize, staged
from .wordids import byte_slices

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints in a table entry up to which they are compared one by one.
CROWD = 32
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text, as an unsigned integer; zero where there's no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(p, seed) for p in parts), "<u8")
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), COUNTED):
        own = hashes[a : a + COUNTED].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(own, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, text_key, fp`` of whole texts; ``text_key`` is a hash of the text, null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for a, b in byte_slices(texts):
                own = [fingerprint(t, shingle, seed) for t in texts.slice(a, b - a).to_numpy(zero_copy_only=False).tolist()]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(own, np.uint64).view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


FIRST = "shiftrightunsigned(fp, 32)"
SECOND = "fp & 4294967295L"
#: A segment value with its table: the second table's values have bit 32 set.
ENTRIES = f"explode(array({FIRST}, ({SECOND}) | 4294967296L)) AS entry"
#: What a fingerprint looks up. ``own``: an entry that it stands in itself.
LOOKUPS = f"""inline(concat(
    array(struct({FIRST} AS entry, true AS own), struct(({SECOND}) | 4294967296L AS entry, true AS own)),
    transform(filter(sequence(0, 31), i -> ({FIRST}) & shiftleft(1L, i) = 0), i -> struct(({FIRST}) | shiftleft(1L, i) AS entry, false AS own))))"""
BALL = "explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))) AS member"


def near_links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``a, b`` between fingerprints of ``distinct(fp)`` that give all components at radius two."""
    entries = distinct.selectExpr("fp", ENTRIES)
    crowded, _ = staged(entries.groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("entry"), "crowded")
    crowded = small(crowded)
    few = entries.join(crowded, "entry", "left_anti").groupBy("entry").agg(F.collect_list("fp").alias("there"))
    lookups = distinct.selectExpr("fp", LOOKUPS)
    found = lookups.join(crowded, "entry", "left_anti").join(few, "entry")
    # ``there`` has at most ``crowd`` fingerprints.
    pairs = found.selectExpr("fp AS a", f"explode(filter(there, y -> bit_count(y ^ fp) <= {RADIUS} AND (not own AND y <> fp OR y > fp))) AS b")
    balls = lookups.join(crowded, "entry", "left_semi").select("fp").distinct().selectExpr("fp", BALL)
    # A member has at most 65 owners.
    owners = balls.groupBy("member").agg(F.sort_array(F.collect_list("fp")).alias("there")).where(F.size("there") > 1)
    stars = owners.selectExpr("there[0] AS a", "explode(slice(there, 2, size(there) - 1)) AS b").where(f"bit_count(a ^ b) <= {RADIUS}")
    return pairs.union(stars).distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """``doc_id, text_key, fp, group_fp, component_id`` for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` that the row's document reaches over links of at
    most two bits, itself included. Null text counts as empty; documents without words have
    fingerprint zero and are linked like others. A null ``doc_id`` is never the smallest (a
    component of such rows alone has a null id). Repeated rows all come back; other columns are
    ignored; an empty table gives an empty result. The many rows of one fingerprint are dealt to all
    tasks when they get their component.
    """
    rows = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    parts = connected_components(near_links(distinct.select("fp"), crowd))
    linked = parts.join(distinct, parts["node"] == distinct["fp"]).select("fp", "component", "first_id")
    least = linked.groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = linked.join(least, "component").select("fp", "component", "least_id")
    groups = distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "fp").alias("group_fp"), F.coalesce("least_id", "first_id").alias("component_id"))
    joined = join_by_key(rows, materialize(groups, "groups"), ["fp"], ["doc_id", "text_key"])
    return joined.select("doc_id", "text_key", "fp", "group_fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest ``doc_id``.

    Of rows that share that id the one with the least text hash stays; of rows alike in id and text
    one stays. A null id comes last. All columns stay as they are, whatever their names; an empty
    table gives an empty result.
    """
    return first_of_groups(docs, near_groups(docs, **params))


def first_of_groups(docs: DataFrame, rows: DataFrame, group: str = "group_fp", text: str | Column = "text") -> DataFrame:
    """The first of each ``group`` of ``rows(doc_id, text_key)``, whose key hashes ``text``, out of ``docs``.

    Only the keys of rows that go, or of rows that stay and are repeated, meet the documents: few
    enough keys are broadcast, and then no text is exchanged.
    """
    keys = ["_none", "_id", "_text"]
    id_parts = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    held = rows.withColumns({**id_parts, "_text": F.col("text_key")}).groupBy(group, *keys).agg(F.count("*").alias("n"))
    held = materialize(held, "held")
    first = materialize(held.groupBy(group).agg(F.min(F.struct(*keys)).alias("first")), "first-of-groups")
    marked = join_by_key(held, first, [group], keys).withColumn("stays", F.struct(*keys) == F.col("first"))
    marked = materialize(marked.where("NOT stays OR n > 1").select(*keys, "stays"), "marked")
    known = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("_text"), *[c.alias(n) for n, c in id_parts.items()])
    kept = known.join(small(marked), keys, "left").where("stays IS NULL").select("row")
    repeated = marked.where("stays")
    if repeated.count():
        # Alike in id and text: one of them, combined before the exchange.
        once = known.join(small(repeated), keys).groupBy(*keys).agg(F.first("row").alias("row"))
        kept = kept.union(once.select("row"))
    return kept.select("row.*")
