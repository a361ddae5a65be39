"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash fingerprints and multi-index hashing. A bit of two fingerprints differs
with probability acos(cosine) / pi, at a similarity of 0.8 and more at most ``RATE`` (0.1515): about ten of
64 bits, too many for a few segments to tell texts apart. So a fingerprint here is longer: two words for
a first distance, then as many disjoint segments as it takes for two texts at 0.8 to agree in a
whole segment but for ``MISS`` of all pairs. The wider a segment, the fewer texts meet by chance; its
bits follow from the number of texts, so that an entry of a segment's table holds two to four of them.
Of the texts that meet in an entry, distances are verified, first of the two words, then of whole
fingerprints, each with a bound ``SIGMAS`` above the mean at 0.8. The pairs that are left are compared by
their whole sets of shingle hashes; only pairs that reach 0.8 are linked, and a component of links is a group.

Everything runs over distinct texts. In an entry with up to ``CROWD`` texts all pairs are candidates.
In a larger one, whose pairs would grow with the square, every text is first held against a leader, the
one that stands in most crowded entries (the centre of a group of copies). Links join most of an
entry's texts into one component; then each pair of an entry that is still in two components is a
candidate too. So no two texts that meet are left out unless they are already in one group.

Sets of four shingles in sets of five, texts of eight and nine words, differ in more bits (0.1875): of them
up to 5 % of pairs agree in no segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.skew import join_by_key, small
from ..plans.stage import materialize, staged
from .simhash import first_of_groups
from .wordids import byte_slices

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Share of bits in which two large sets of equal size differ at the similarity; others differ in fewer.
RATE = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: Share of pairs at the similarity that agree in no segment.
MISS = 0.0005
#: Standard deviations above the mean up to which a distance is near.
SIGMAS = 4.7
#: Words of the first distance.
SKETCH = 2
#: Words of a fingerprint at least: with 64, texts under a similarity of 0.73 are no longer near.
LEAST_WORDS = 64
#: Distinct shingles from which on whole fingerprints are compared; fewer may differ in more bits.
LEAST_SHINGLES = 9
#: Bits of a segment: at least, and at most (an entry's number has its value in 32 bits).
LEAST_BITS, MOST_BITS = 12, 31
#: Texts in an entry up to which all its pairs are compared.
CROWD = 8
#: Tasks that the pairs of a text in crowded entries are dealt to.
SALTS = 64
#: Texts of a crowded entry that meet those outside its largest component in one place.
BLOCK = 256
#: Shingles whose bits are counted at once.
COUNTED = 2048

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def segment_bits(texts: int) -> int:
    """Bits of a segment for so many texts: an entry holds two to four of them by chance."""
    return min(max((max(texts, 1) - 1).bit_length() - 2, LEAST_BITS), MOST_BITS)


def segment_count(bits: int) -> int:
    """Segments of ``bits`` bits until all but ``MISS`` of the pairs at the similarity agree in one."""
    return math.ceil(math.log(MISS) / math.log1p(-((1 - RATE) ** bits)))


def fingerprint_words(bits: int) -> int:
    """Words of 64 bits of a fingerprint: the sketch, then all segments; enough to verify distances by."""
    return max(SKETCH + -(-segment_count(bits) * bits // 64), LEAST_WORDS)


def near_bits(bits: int) -> int:
    """The most of ``bits`` bits in which two texts at the similarity are taken to differ."""
    return math.floor(RATE * bits + SIGMAS * math.sqrt(RATE * (1 - RATE) * bits))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, a text without words an empty one."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.unique(np.fromiter((xxh64_intdigest(p, SEED) for p in parts), "<u8"))


@cache
def _drawn(words: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a shift for each word."""
    factors, shifts = np.random.default_rng(SEED).integers(0, 1 << 64, (words, 2), np.uint64).T
    return factors | np.uint64(1), shifts.copy()


def expanded(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` words of mixed bits for each hash, a row each."""
    factors, shifts = _drawn(words)
    mixed = hashes.astype(np.uint64)[:, None] * factors + shifts
    mixed ^= mixed >> np.uint64(32)
    mixed *= GOLDEN
    return mixed ^ (mixed >> np.uint64(29))


def bit_totals(rows: np.ndarray) -> np.ndarray:
    """How many of the rows have each bit, by carry-save adders over whole words."""
    totals, weight, held = np.zeros(rows.shape[1] * 64, np.int64), 0, [rows]
    while held:
        own, carried = np.concatenate(held) if len(held) > 1 else held[0], []
        while len(own) > 2:
            third = len(own) // 3
            a, b, c = own[:third], own[third : 2 * third], own[2 * third : 3 * third]
            either = a ^ b
            carried.append((a & b) | (either & c))
            own = np.concatenate((either ^ c, own[3 * third :]))
        if len(own) == 2:
            carried.append(own[:1] & own[1:])
            own = own[:1] ^ own[1:]
        totals += np.unpackbits(np.ascontiguousarray(own[0]).view(np.uint8), bitorder="little").astype(np.int64) << weight
        weight, held = weight + 1, carried
    return totals


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The SimHash fingerprint of a set of shingle hashes: a bit is 1 if over half of the shingles have it."""
    totals = np.zeros(words * 64, np.int64)
    for a in range(0, len(hashes), COUNTED):
        totals += bit_totals(expanded(hashes[a : a + COUNTED], words))
    return np.packbits(2 * totals > len(hashes), bitorder="little").view("<u8")


def segments(prints: np.ndarray, bits: int) -> np.ndarray:
    """The value of each segment of ``bits`` bits, a row for each fingerprint."""
    count = segment_count(bits)
    all_bits = np.unpackbits(np.ascontiguousarray(prints[:, SKETCH:]).view(np.uint8), axis=1, bitorder="little")
    wide = np.zeros((len(prints), count, 32), np.uint8)
    wide[:, :, :bits] = all_bits[:, : count * bits].reshape(len(prints), count, bits)
    return np.packbits(wide, axis=2, bitorder="little").reshape(len(prints), -1).view("<i4")


def _mapped(docs: DataFrame, columns: list[str], schema: str, of) -> DataFrame:
    """``columns`` with what ``of(text)`` gives, a tuple of Arrow values for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in byte_slices(texts):
                part = batch.slice(a, b - a)
                made = of(texts.slice(a, b - a).to_numpy(zero_copy_only=False).tolist())
                names = [*columns, *[f.split()[0] for f in schema.split(", ")[len(columns) :]]]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(columns))], *made], names)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def _lists(rows: np.ndarray) -> pa.Array:
    """A list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def signatures(docs: DataFrame, bits: int) -> DataFrame:
    """``doc_id, text_key, n, fp, segments`` of whole texts; ``n`` counts the distinct shingles."""
    words = fingerprint_words(bits)

    def of(texts: list[str | None]) -> list[pa.Array]:
        sets = [shingle_hashes(t) for t in texts]
        prints = np.stack([fingerprint(s, words) for s in sets])
        return [pa.array(list(map(len, sets)), pa.int64()), _lists(prints.view(np.int64)), _lists(segments(prints, bits))]

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return _mapped(rows, ["doc_id", "text_key"], "doc_id long, text_key long, n long, fp array<long>, segments array<int>", of)


def _near(a: str, b: str) -> str:
    """Whether the sketches in two prefixes of column names are near."""
    return f"bit_count({a}low ^ {b}low) + bit_count({a}high ^ {b}high) <= {near_bits(64 * SKETCH)}"


def _dealt(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def candidates(distinct: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b, salt`` of ``distinct(text_key, fp, segments)`` that share an entry and have near sketches.

    Of crowded entries only the pairs with the leader; their rows ``entry, text_key, low, high`` come back too.
    """
    entries = distinct.select("text_key", F.col("fp")[0].alias("low"), F.col("fp")[1].alias("high"), F.posexplode("segments").alias("segment", "value"))
    entries = entries.select(F.expr("shiftleft(CAST(segment AS long), 32) | value").alias("entry"), "text_key", "low", "high")
    counts = entries.groupBy("entry").agg(F.count("*").alias("held"))
    crowded, _ = staged(counts.where(F.col("held") > crowd).select("entry"), "crowded-entries")
    crowded = small(crowded)
    few = entries.join(crowded, "entry", "left_anti")
    # At most ``crowd`` texts.
    few = few.groupBy("entry").agg(F.collect_list(F.struct("text_key", "low", "high")).alias("there")).where("size(there) > 1")
    pairs = few.selectExpr("there", "explode(there) AS x").selectExpr("x.text_key AS a", f"explode(filter(there, y -> y.text_key > x.text_key AND {_near('x.', 'y.')})) AS y")
    pairs = pairs.selectExpr("a", "y.text_key AS b", "0 AS salt")
    many, _ = staged(entries.join(crowded, "entry", "left_semi"), "crowded")
    # A text has a row for each segment at most.
    known = many.withColumn("stands", F.count("*").over(Window.partitionBy("text_key")))
    leaders = known.groupBy("entry").agg(F.max_by(F.struct(F.col("text_key").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high")), F.struct("stands", "text_key")).alias("leader"))
    # One row for each crowded entry.
    leaders, _ = staged(leaders.select("entry", "leader.*"), "leaders")
    stars = join_by_key(many, leaders, ["entry"], ["text_key"], "inner")
    stars = stars.withColumnRenamed("text_key", "b").where(f"a <> b AND {_near('a_', '')}")
    return pairs.union(stars.select("a", "b", _dealt("b").alias("salt"))).distinct(), many


def _alike(words: int) -> str:
    """Whether the sizes of two texts allow the similarity and, with enough shingles, whole fingerprints are near."""
    differ = "aggregate(zip_with(fp_a, fp_b, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    return f"least(n_a, n_b) >= {SIMILARITY} * greatest(n_a, n_b) AND (least(n_a, n_b) < {LEAST_SHINGLES} OR {differ} <= {near_bits(64 * words)})"


def pairs_apart(distinct: DataFrame, many: DataFrame, parts: DataFrame, words: int) -> DataFrame:
    """Pairs ``a, b, salt`` of crowded entries whose texts are in two components and have near fingerprints.

    ``many`` and ``parts(text_key, group_key)`` are written tables. All pairs of an entry but those
    within one component are compared: each text outside the entry's largest component with all others.
    Only the texts outside are repeated, one row for each block of the entry.
    """
    placed = join_by_key(many, parts, ["text_key"], ["entry"]).withColumn("group_key", F.coalesce("group_key", "text_key"))
    placed, _ = staged(placed, "placed")
    sizes = placed.groupBy("entry", "group_key").agg(F.count("*").alias("size"))
    opened = sizes.groupBy("entry").agg(F.max_by("group_key", F.struct("size", "group_key")).alias("main"), F.sum("size").alias("held"), F.count("*").alias("groups"))
    opened = opened.where("groups > 1").selectExpr("entry", "main", f"CAST(ceil(held / {BLOCK}) AS int) AS blocks")
    opened, _ = staged(opened, "opened")
    there, _ = staged(placed.join(small(opened), "entry").join(distinct.select("text_key", "n", "fp"), "text_key"), "there")
    ones = there.where("group_key <> main").selectExpr("entry", "text_key AS a", "low AS a_low", "high AS a_high", "group_key AS a_group", "n AS n_a", "fp AS fp_a", "explode(sequence(0L, blocks - 1L)) AS block")
    others = there.selectExpr("entry", "main", "text_key AS b", "low AS b_low", "high AS b_high", "group_key AS b_group", "n AS n_b", "fp AS fp_b", "pmod(xxhash64(text_key), blocks) AS block")
    met = ones.join(others, ["entry", "block"]).where(f"a_group <> b_group AND (b_group = main OR a < b) AND {_near('a_', 'b_')} AND {_alike(words)}")
    return met.select("a", "b", _dealt("b").alias("salt")).distinct()


def _with_both(pairs: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the ``columns`` of ``values(text_key)`` as those of ``a`` and of ``b``; a text of many pairs is dealt by ``salt``."""
    of_a = values.select(F.col("text_key").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    of_b = values.select(F.col("text_key").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    firsts = pairs.select("a", "salt").distinct().join(of_a, "a")
    return pairs.join(of_b, "b").join(firsts, ["a", "salt"])


def near_pairs(distinct: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The ``pairs`` whose whole fingerprints of ``words`` words are near; with few shingles all pairs whose sizes allow it."""
    pairs, _ = staged(pairs, "met")
    return _with_both(pairs, distinct, ["n", "fp"]).where(_alike(words)).select("a", "b", "salt")


def similar_links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose texts have the similarity, by their whole shingle sets."""
    pairs, _ = staged(pairs, "pairs")
    wanted = small(materialize(pairs.selectExpr("a AS text_key").union(pairs.select("b")).distinct(), "wanted"))
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = _mapped(texts, ["text_key"], "text_key long, hashes array<long>", lambda own: [pa.array([shingle_hashes(t).view(np.int64) for t in own], pa.list_(pa.int64()))])
    sets = materialize(sets, "shingle-sets")
    both = _with_both(pairs, sets, ["hashes"])
    # Row by row in the engine: Arrow batches of two whole sets a row would fill a worker's memory.
    common = both.selectExpr("a", "b", "size(hashes_a) + size(hashes_b) AS n", "size(array_intersect(hashes_a, hashes_b)) AS common")
    return common.where(F.col("common") >= SIMILARITY * (F.col("n") - F.col("common"))).select("a", "b")


def _parts(links: DataFrame) -> DataFrame:
    """``text_key, group_key`` of linked texts, written."""
    return materialize(connected_components(links).select(F.col("node").alias("text_key"), F.col("component").alias("group_key")), "groups")


def near_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``doc_id, text_key, group_key`` for each row of ``docs(doc_id, text)``; null text counts as empty."""
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    bits = segment_bits(docs.count())
    words = fingerprint_words(bits)
    rows = materialize(signatures(whole, bits), "signatures")
    distinct = materialize(rows.select("text_key", "n", "fp", "segments").dropDuplicates(["text_key"]), "distinct")
    pairs, many = candidates(distinct, crowd)
    groups = _parts(similar_links(whole, near_pairs(distinct, pairs, words)))
    apart = materialize(pairs_apart(distinct, many, groups, words), "apart")
    if apart.count():
        found = materialize(similar_links(whole, apart), "found")
        if found.count():
            groups = _parts(groups.select(F.col("text_key").alias("a"), F.col("group_key").alias("b")).union(found))
    joined = join_by_key(rows.select("doc_id", "text_key"), groups, ["text_key"], ["doc_id"])
    return joined.select("doc_id", "text_key", F.coalesce("group_key", "text_key").alias("group_key"))


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each group, as ``simhash.keep_first`` chooses it."""
    return first_of_groups(docs, near_groups(docs, **params), "group_key", F.coalesce("text", F.lit("")))
