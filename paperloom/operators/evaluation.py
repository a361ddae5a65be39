"""Matches of extracted items with gold items, and scores over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalized, two_decimals
from ..plans.stage import materialize
from .audit import match_scores


def first_unused(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """``group, a, b``: each a in turn takes the least b of its pairs that none before it took.

    Only places are gathered for a group, and folded in the engine.
    """
    per_a = pairs.groupBy(*group, a).agg(F.array_sort(F.collect_set(F.col(b).cast("long"))).alias("bs"))
    held = per_a.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(a).cast("long").alias("a"), "bs"))).alias("rows"))
    fold = """aggregate(rows, cast(array() AS array<struct<a: bigint, b: bigint>>),
        (s, x) -> concat(s, transform(slice(filter(x.bs, y -> NOT exists(s, z -> z.b = y)), 1, 1), y -> named_struct('a', x.a, 'b', y))))"""
    kinds = dict(pairs.dtypes)
    return held.select(*group, F.explode(F.expr(fold)).alias("m")).select(*group, F.col("m.a").cast(kinds[a]).alias(a), F.col("m.b").cast(kinds[b]).alias(b))


def same_threshold(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Both there and no further apart than the tolerance."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def match_gold(gold: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gold items with the extracted item that each is matched with, and the extracted items without one.

    ``gold``: ``doc_id, gold_idx, anchor, comparison, threshold, covenant_type``; ``extracted``:
    ``doc_id, ext_idx, source_text, comparison, threshold, covenant_type``. A gold item takes the first
    free item of its document whose quote holds its anchor, white space and case aside; an empty
    anchor takes none. Matches: ``doc_id, gold_idx, ext_idx, hit, threshold_correct,
    comparison_correct, covenant_type_correct``, all false without an item.
    """
    g = gold.withColumn("_a", normalized("anchor")).where("_a <> ''").select("doc_id", "gold_idx", "_a")
    e = extracted.select("doc_id", "ext_idx", normalized("source_text").alias("_s"))
    pairs = g.join(e, "doc_id").where(F.contains("_s", "_a")).select("doc_id", "gold_idx", "ext_idx")
    chosen = materialize(first_unused(pairs, ["doc_id"], "gold_idx", "ext_idx"), "gold-matches")
    sides = ["comparison", "threshold", "covenant_type"]
    found = extracted.select("doc_id", "ext_idx", *[F.col(c).alias(f"_{c}") for c in sides])
    rows = gold.select("doc_id", "gold_idx", *sides).join(chosen, ["doc_id", "gold_idx"], "left").join(found, ["doc_id", "ext_idx"], "left")
    hit = F.col("ext_idx").isNotNull()
    matches = rows.select(
        "doc_id",
        "gold_idx",
        "ext_idx",
        hit.alias("hit"),
        same_threshold(F.col("threshold"), F.col("_threshold")).alias("threshold_correct"),
        (hit & F.col("comparison").eqNullSafe(F.col("_comparison"))).alias("comparison_correct"),
        (hit & F.col("covenant_type").eqNullSafe(F.col("_covenant_type"))).alias("covenant_type_correct"),
    )
    return matches, extracted.join(chosen.select("doc_id", "ext_idx"), ["doc_id", "ext_idx"], "left_anti")


def score_gold(matches: DataFrame, unmatched: DataFrame, by: str | None = None) -> DataFrame:
    """Counts, recall, precision and accuracies, over everything or for each ``by``; 1 where there is nothing to count.

    The threshold of a hit counts if its comparison is right too.
    """
    flags = matches.select(
        *([by] if by else []),
        F.lit(1).alias("gold"),
        "hit",
        (F.col("threshold_correct") & F.col("comparison_correct")).alias("threshold_ok"),
        F.col("covenant_type_correct").alias("type_ok"),
        F.lit(0).alias("extra"),
    )
    none = F.lit(False)
    extra = unmatched.select(*([by] if by else []), F.lit(0).alias("gold"), none.alias("hit"), none.alias("threshold_ok"), none.alias("type_ok"), F.lit(1).alias("extra"))
    return match_scores(flags.unionByName(extra), by)


def score_line(name: str | Column = "doc_id") -> Column:
    """One line of text for a row of scores."""
    shares = [two_decimals(F.col(v)) for v in ("recall", "precision", "threshold_accuracy", "covenant_type_accuracy")]
    counts = [F.col(v) for v in ("num_gold", "num_hits", "num_misses", "num_false_positives")]
    shape = "%-35s recall=%s precision=%s threshold_acc=%s type_acc=%s (gold=%d hits=%d misses=%d false_pos=%d)"
    return F.format_string(shape, (F.col(name) if isinstance(name, str) else name).cast("string"), *shares, *counts)
