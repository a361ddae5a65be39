"""Checks of quotes against their sources, and one-to-one matches."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.columns import normalized
from ..plans.stage import materialize


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; null with a null side."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: From this length of its second text on difflib leaves out frequent characters.
AUTOJUNK = 200


def longest_block(s: str, q: str) -> tuple[int, int]:
    """Start in ``s`` and length of the longest common block, the first in ``s``, as difflib finds it.

    A block can't be longer than the longest so far unless it holds one more character, so a quote
    takes about two searches for each of its characters, whatever the source's length.
    """
    if len(q) >= AUTOJUNK:
        block = SequenceMatcher(None, s, q).find_longest_match(0, len(s), 0, len(q))
        return block.a, block.size
    size = at = 0
    for j in range(len(q)):
        found = -1
        while j + size < len(q) and (i := s.find(q[j : j + size + 1])) >= 0:
            found, size = i, size + 1
        if found >= 0:
            at = found
        elif size and j + size <= len(q) and 0 <= (i := s.find(q[j : j + size], 0, at + size)) < at:
            at = i
    return at, size


def _window_ratio(q: str, s: str) -> float:
    at, size = longest_block(s, q)
    return SequenceMatcher(None, s[max(0, at - 10) : at + size + 10], q).ratio() if size else 0.0


@pandas_udf(DoubleType())
def window_similarity(quote: pd.Series, source: pd.Series) -> pd.Series:
    """Ratio of a quote and the part of the source around their longest common block."""
    return pd.Series([_window_ratio(q or "", s or "") for q, s in zip(quote, source, strict=True)], dtype="float64")


def audit_exact(pairs: DataFrame, quote: str = "quote", source: str = "source") -> DataFrame:
    """``pairs`` with ``citation_verified``: the normalised quote isn't empty and stands in the source."""
    q = normalized(quote)
    return pairs.withColumn("citation_verified", F.coalesce((q != "") & F.contains(normalized(source), q), F.lit(False)))


def audit_citations(pairs: DataFrame, quote: str = "quote", source: str = "source", least: float = 0.85) -> DataFrame:
    """``pairs`` with ``citation_verified`` and ``citation_similarity``.

    Exact quotes are decided in the JVM; only the rest goes through difflib, as a union, since a
    conditional would send every row to Python. Both sides are normalised once, in a written table.
    """
    norm = pairs.withColumns({"_q": F.coalesce(normalized(quote), F.lit("")), "_s": F.coalesce(normalized(source), F.lit(""))})
    norm = materialize(norm.withColumn("_exact", (F.col("_q") == "") | F.contains("_s", "_q")), "quotes")
    sure = norm.where("_exact").withColumn("citation_similarity", (F.col("_q") != "").cast("double")).withColumn("citation_verified", F.col("_q") != "")
    rest = norm.where("NOT _exact").withColumn("citation_similarity", window_similarity("_q", "_s")).withColumn("citation_verified", F.col("citation_similarity") >= least)
    return sure.unionByName(rest).drop("_q", "_s", "_exact")


@pandas_udf(ArrayType(DoubleType()))
def window_similarities(quotes: pd.Series, source: pd.Series) -> pd.Series:
    """Of several quotes against one source, see ``window_similarity``."""
    return pd.Series([[_window_ratio(q or "", s or "") for q in qs] for qs, s in zip(quotes, source, strict=True)])


def audited(items: DataFrame, documents: DataFrame, item: list[str], quote: str = "quote", text: str = "full_text", least: float = 0.85) -> DataFrame:
    """``doc_id, item, citation_verified, citation_similarity`` of ``items(doc_id, item..., quote)`` against their documents.

    A document's quotes are gathered, so that its text is normalised once and copied for none of
    them; exact ones are decided in the JVM. An item whose document is missing is unverified.
    """
    quotes = items.select("doc_id", F.struct(*item).alias("i"), F.coalesce(normalized(quote), F.lit("")).alias("q"))
    held = quotes.groupBy("doc_id").agg(F.collect_list(F.struct("i", "q")).alias("asked"))
    both = held.join(documents.select("doc_id", F.coalesce(normalized(text), F.lit("")).alias("_s")), "doc_id", "left").withColumn("_s", F.coalesce("_s", F.lit("")))
    sure = F.filter("asked", lambda x: (x["q"] == "") | F.contains(F.col("_s"), x["q"]))
    split = materialize(both.withColumn("sure", sure).withColumn("rest", F.filter("asked", lambda x: (x["q"] != "") & ~F.contains(F.col("_s"), x["q"]))).drop("asked"), "asked-quotes")
    exact = split.select("doc_id", F.explode("sure").alias("x")).select("doc_id", "x.i.*", F.when(F.col("x.q") != "", 1.0).otherwise(0.0).alias("citation_similarity"))
    ratios = split.where(F.size("rest") > 0).select("doc_id", "rest", window_similarities(F.transform("rest", lambda x: x["q"]), F.col("_s")).alias("r"))
    fuzzy = ratios.select("doc_id", F.explode(F.arrays_zip("rest", "r")).alias("x")).select("doc_id", "x.rest.i.*", F.col("x.r").alias("citation_similarity"))
    return exact.unionByName(fuzzy).withColumn("citation_verified", F.col("citation_similarity") >= least)


def plain_name(text: str | Column) -> Column:
    """Lower case, without white space at the ends; null as the empty text."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))


def similar_pairs(pairs: DataFrame, a: str, b: str, least: float, score: str = "score") -> DataFrame:
    """The pairs whose texts, in lower case and without white space at the ends, have at least this similarity.

    The ratio can't exceed twice the shorter length over both lengths, so most pairs are decided by
    their lengths and don't go to Python; equal texts have 1.
    """
    sized = pairs.withColumns({"_x": plain_name(a), "_y": plain_name(b)}).where(2 * F.least(F.length("_x"), F.length("_y")) >= least * (F.length("_x") + F.length("_y")))
    same = sized.where("_x = _y").withColumn(score, F.lit(1.0))
    rest = sized.where("_x <> _y").withColumn(score, similarity("_x", "_y")).where(F.col(score) >= least)
    return same.unionByName(rest).drop("_x", "_y")


def best_first_matches(pairs: DataFrame, group: str, a: str, b: str, score: str, least: float) -> DataFrame:
    """``group, a, b, score``: greedy one-to-one pairs, best score first, ties to the higher a, then b.

    The pairs at or above ``least`` are sorted within each task and read once; only the places that
    one group has used so far are held.
    """
    types = dict(pairs.dtypes)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used_a, used_b, begun = None, set(), set(), False
        for batch in batches:
            kept = []
            for k, (g, x, y) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if not begun or g != at:
                    at, used_a, used_b, begun = g, set(), set(), True
                if x not in used_a and y not in used_b:
                    used_a.add(x)
                    used_b.add(y)
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = pairs.where(F.col(score) >= least).select(group, a, b, score).repartition(group).sortWithinPartitions(group, F.desc(score), F.desc(a), F.desc(b))
    return rows.mapInArrow(pick, ", ".join(f"`{c}` {types[c]}" for c in (group, a, b, score)))


def match_scores(matches: DataFrame, by: str | None = None) -> DataFrame:
    """Scores of rows ``gold, hit, threshold_ok, type_ok, extra``: a gold item each (``gold`` 1) or an extracted one without match (``extra`` 1).

    Shares are 1 where there is nothing to count.
    """
    gold, hits, extra = F.coalesce(F.sum("gold"), F.lit(0)), F.count_if("hit"), F.coalesce(F.sum("extra"), F.lit(0))

    def share(x: Column, n: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double"), n.cast("double")), F.lit(1.0))

    return (matches.groupBy(by) if by else matches.groupBy()).agg(
        gold.alias("num_gold"),
        (hits + extra).alias("num_extracted"),
        hits.alias("num_hits"),
        (gold - hits).alias("num_misses"),
        extra.alias("num_false_positives"),
        share(hits, gold).alias("recall"),
        share(hits, hits + extra).alias("precision"),
        share(F.count_if("threshold_ok"), hits).alias("threshold_accuracy"),
        share(F.count_if("type_ok"), hits).alias("covenant_type_accuracy"),
    )


def keep_first(items: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return items.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def merge_partials(records: DataFrame, key: str, order: str, scalars: list[str]) -> DataFrame:
    """The first non-null value of each scalar field of a key, in order."""
    return records.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars])


def backfilled(results: DataFrame, recomputed: DataFrame, key: str, field: str) -> DataFrame:
    """``results`` with ``field`` from ``recomputed`` where it has the key; all else stays."""
    new = recomputed.select(key, F.col(field).alias("_new"))
    return results.join(new, key, "left").withColumn(field, F.coalesce("_new", field)).select(*results.columns)
