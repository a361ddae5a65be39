"""Narrowing: embedders, TF-IDF, similarity, candidates and tiered first matches."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import patterns as P
from ..functions.columns import cosine, keyword_match
from ..plans.skew import BROADCAST_ROWS, dealt, join_by_key, small
from ..plans.stage import materialize

#: What isn't part of a term, and the least length of one.
BREAKS, LEAST_TERM = "[^a-z0-9_]+", 2
#: Texts whose terms are counted before they are passed on.
COUNTED_TEXTS = 200


def terms_of(text: str | Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case ASCII words of two characters or more that aren't stop words, repeats included; none for null."""
    words = F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), BREAKS)
    return F.filter(words, lambda w: (F.length(w) >= LEAST_TERM) & (~w.isin(*stop) if stop else F.lit(True)))


def term_counts(items: DataFrame, group: str, item: str, text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
    """``group, item, term, tf``, written; the empty term once for each item, so that items can be counted.

    The terms of a row are counted where it is read; only if an item has several rows are counts exchanged.
    """
    word = re.compile(f"[a-z0-9_]{{{LEAST_TERM},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, COUNTED_TEXTS):
                batch = whole.slice(start, COUNTED_TEXTS)
                found = [Counter(word.findall(t)) for t in batch.column(2).to_pylist()]
                for own in found:
                    for w in stop:
                        own.pop(w, None)
                    own[""] = 1
                row = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
                terms, tf = (pa.array(chain.from_iterable(x), kind) for x, kind in ((found, pa.string()), ((own.values() for own in found), pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), terms, tf], [group, item, "term", "tf"])

    rows = items.select(group, item, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    schema = StructType([rows.schema[group], rows.schema[item], StructField("term", StringType()), StructField("tf", LongType())])
    counts = materialize(rows.mapInArrow(count, schema), "term-counts")
    if counts.where("term = ''").groupBy(group, item).count().where("count > 1").isEmpty():
        return counts
    return materialize(counts.groupBy(group, item, "term").agg(F.sum("tf").alias("tf")), "term-counts")


def inverse_frequencies(counts: DataFrame, group: str) -> DataFrame:
    """``group, term, df, idf``, written: smoothed, from the items of each group."""
    df = materialize(counts.groupBy(group, "term").agg(F.count("*").alias("df")), "term-items")
    n = materialize(df.where("term = ''").select(group, F.col("df").alias("n")), "items")
    both = join_by_key(df.where("term <> ''"), n, [group], ["term"], "inner")
    return materialize(both.select(group, "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")


def weights(counts: DataFrame, group: str, item: str) -> DataFrame:
    """``group, item, term, tf, w``: counts times inverse frequencies.

    The most common terms, which are nearly all rows, meet a broadcast; only rows of the others are
    exchanged, and none of those is common enough to fill a task.
    """
    keys, rows, found = [group, "term"], counts.where("term <> ''"), inverse_frequencies(counts, group)
    if found.count() <= BROADCAST_ROWS:
        both = rows.join(F.broadcast(found), keys)
    else:
        common = F.broadcast(materialize(found.orderBy(F.desc("df")).limit(BROADCAST_ROWS), "common-terms"))
        both = rows.join(common, keys).unionByName(rows.join(common.select(*keys), keys, "left_anti").join(dealt(found), keys))
    return both.select(group, item, "term", "tf", (F.col("tf") * F.col("idf")).alias("w"))


def weighted(counts: DataFrame, group: str, item: str, only: list[str]) -> DataFrame:
    """``group, item, norm, terms``: an item's norm over all its terms, and ``term, w`` of those among ``only``.

    What an item gathers is a number for each of those terms, so rows add up before the exchange.
    """
    held = weights(counts, group, item).groupBy(group, item).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *[F.max(F.when(F.col("term") == t, F.col("w"))).alias(f"_w{i}") for i, t in enumerate(only)])
    kept = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"_w{i}").alias("w")) for i, t in enumerate(only)]) if only else F.array().cast("array<struct<term:string,w:double>>")
    return held.select(group, item, "norm", F.filter(kept, lambda t: t["w"].isNotNull()).alias("terms"))


def tfidf(items: DataFrame, group: str, item: str, text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
    """``group, item, term, weight``: smoothed idf within each group, rows of unit length. Items without terms have no rows."""
    rows = weights(term_counts(items, group, item, text, stop), group, item)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group, item)))
    return rows.select(group, item, "term", (F.col("w") / norm).alias("weight"))


def query_scores(items: DataFrame, group: str, item: str, queries: list[str], text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
    """``group, item, score``: the greatest cosine of an item with any query, over TF-IDF fitted on the items and queries of each group.

    Queries are counted as items of every group. Only their terms are carried to the join, which is
    by group: neither pairs of items nor a cross join is formed. Items without terms have no rows.
    """
    named = F.array(*[F.struct(F.lit(i).cast("string").alias("item"), F.lit(q).alias("text")) for i, q in enumerate(queries)])
    asked = items.select(group).distinct().select(group, F.explode(named).alias("q")).select(group, F.col("q.item").alias("_item"), F.lit(True).alias("_asked"), F.col("q.text").alias("_text"))
    own = items.select(group, F.col(item).cast("string").alias("_item"), F.lit(False).alias("_asked"), F.col(text).alias("_text"))
    both = own.unionByName(asked).withColumn("_key", F.struct("_asked", "_item"))
    terms = sorted({t for q in queries for t in python_terms(q, stop)})
    held = materialize(weighted(term_counts(both, group, "_key", "_text", stop), group, "_key", terms), "weighted")
    vectors = held.where("_key._asked").groupBy(group).agg(F.collect_list(F.struct("norm", F.map_from_entries("terms").alias("terms"))).alias("queries"))
    joined = join_by_key(held.where("NOT _key._asked"), materialize(vectors, "query-vectors"), [group], ["_key"])

    def dot(q: Column) -> Column:
        total = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["w"] * F.coalesce(F.element_at(q["terms"], t["term"]), F.lit(0.0)))
        return total / (F.col("norm") * q["norm"])

    best = F.coalesce(F.array_max(F.transform("queries", dot)), F.lit(0.0))
    return joined.select(group, F.col("_key._item").cast(dict(items.dtypes)[item]).alias(item), best.alias("score"))


def python_terms(text: str, stop: tuple[str, ...] = ()) -> list[str]:
    """``terms_of`` for a query's text."""
    return [w for w in re.split(BREAKS, text.lower()) if len(w) >= LEAST_TERM and w not in stop]


class Embedder(Protocol):
    """What ``select_candidates`` needs of a provider of similarities."""

    #: How many candidates a document gets unless told otherwise.
    max_candidates: int

    def similarities(self, chunks: DataFrame, doc: str, chunk: str, queries: tuple[str, ...]) -> DataFrame:
        """``doc, chunk, embedding_score``: the greatest cosine with any query; chunks may be missing."""
        ...


@dataclass
class TfidfEmbedder:
    """TF-IDF fitted on the chunks and queries of each document. Lexical only, so it takes more candidates."""

    stop: tuple[str, ...] = P.STOP_WORDS
    max_candidates: int = P.MAX_CANDIDATES_TFIDF

    def similarities(self, chunks: DataFrame, doc: str, chunk: str, queries: tuple[str, ...]) -> DataFrame:
        return query_scores(chunks, doc, chunk, list(queries), stop=self.stop).withColumnRenamed("score", "embedding_score")


Encode = Callable[[list[str]], np.ndarray]


def hashed_words(dims: int = 256) -> Callable[[], Encode]:
    """A stand-in for a dense model: words hashed into ``dims`` counts, the same in every process."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % dims] += 1
        return out

    return lambda: encode


def sentence_model(name: str, cache_dir: str | None = None) -> Callable[[], Encode]:
    """A dense model of the ``sentence_transformers`` package, loaded where it's first used; an error without the package."""

    def load() -> Encode:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("dense embeddings need the sentence_transformers package on every worker") from e
        model = SentenceTransformer(name, cache_folder=cache_dir)
        return lambda texts: np.asarray(model.encode(texts, normalize_embeddings=True))

    return load


@dataclass
class DenseEmbedder:
    """Vectors of a model that ``load`` gives, once for each Python worker and once on the driver for the queries."""

    load: Callable[[], Encode]
    max_candidates: int = P.MAX_CANDIDATES
    at_once: int = 64

    def vectors(self, texts: DataFrame, text: str = "text", vector: str = "vector") -> DataFrame:
        """``texts`` with an array of doubles of unit length; null text counts as empty, a zero vector stays."""
        load, at_once, at, names = self.load, self.at_once, texts.columns.index(text), texts.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = load()
            for batch in batches:
                for a in range(0, batch.num_rows, at_once):
                    part = batch.slice(a, at_once)
                    found = unit_rows(encode([t or "" for t in part.column(at).to_pylist()]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(found), pa.list_(pa.float64()))], [*names, vector])

        fields = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes)
        return texts.mapInArrow(run, f"{fields}, `{vector}` array<double>")

    def similarities(self, chunks: DataFrame, doc: str, chunk: str, queries: tuple[str, ...]) -> DataFrame:
        asked = [F.array(*[F.lit(float(x)) for x in v]) for v in unit_rows(self.load()(list(queries)))]
        found = self.vectors(chunks.select(doc, chunk, "text"))
        scores = [cosine("vector", q) for q in asked]
        return found.select(doc, chunk, (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("embedding_score"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def select_candidates(chunks: DataFrame, embedder: Embedder | None = None, queries: tuple[str, ...] = P.REFERENCE_QUERIES, keywords: tuple[str, ...] = P.COVENANT_KEYWORDS, floor: float = P.LEAST_SCORE, k: int | None = None) -> DataFrame:
    """The chunks of each document that go to extraction, with ``keyword_match, embedding_score, score, rank``.

    ``chunks`` has ``doc_id, chunk_idx, text`` and any others. A chunk is eligible by a keyword or a
    similarity from ``floor`` on. No chunks give no candidates.
    """
    embedder = embedder or TfidfEmbedder()
    scores = materialize(embedder.similarities(chunks, "doc_id", "chunk_idx", queries), "similarities")
    known = chunks.join(small(scores), ["doc_id", "chunk_idx"], "left")
    return top_candidates(known, "doc_id", "chunk_idx", keywords, floor, embedder.max_candidates if k is None else k)


def top_candidates(chunks: DataFrame, doc: str, chunk: str, keywords: tuple[str, ...] = P.COVENANT_KEYWORDS, floor: float = P.LEAST_SCORE, k: int = P.MAX_CANDIDATES) -> DataFrame:
    """The k best chunks of each document by similarity plus a bonus for a keyword; ties to the earlier chunk.

    ``chunks`` has ``text`` and ``embedding_score``; null scores count as 0.
    """
    found = chunks.withColumn("embedding_score", F.coalesce("embedding_score", F.lit(0.0))).withColumn("keyword_match", keyword_match("text", keywords))
    found = found.where(F.col("keyword_match") | (F.col("embedding_score") >= floor))
    found = found.withColumn("score", F.col("embedding_score") + F.when(F.col("keyword_match"), P.KEYWORD_BONUS).otherwise(0.0))
    own = Window.partitionBy(doc).orderBy(F.col("score").desc(), F.col(chunk))
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def tiered_first_match(chunks: DataFrame, doc: str, chunk: str, tiers: dict[str, tuple[str, ...]] = P.LOAN_TIERS, taken: DataFrame | None = None) -> DataFrame:
    """``doc, attribute, tier, chunk``: for each attribute in turn the first free chunk of its first tier that has one.

    ``taken`` (``doc, chunk``) are chunks chosen before. Only places of hits are gathered per
    document, never texts.
    """
    free = chunks if taken is None else chunks.join(taken.select(doc, chunk), [doc, chunk], "left_anti")
    hits = [F.when(F.col("text").rlike("(?iU)" + p), F.struct(F.lit(a).alias("a"), F.lit(t).alias("t"), F.col(chunk).cast("long").alias("c"))) for a, ps in enumerate(tiers.values()) for t, p in enumerate(ps)]
    hit_rows = free.select(doc, F.explode(F.array_compact(F.array(*hits))).alias("h"))
    gathered = hit_rows.groupBy(doc).agg(F.array_sort(F.collect_list("h")).alias("hits"))
    fold = f"""aggregate(sequence(0, {len(tiers) - 1}), cast(array() AS array<struct<a: int, t: int, c: bigint>>),
        (s, k) -> concat(s, slice(filter(hits, h -> h.a = k AND NOT exists(s, x -> x.c = h.c)), 1, 1)))"""
    chosen = gathered.select(doc, F.explode(F.expr(fold)).alias("h"))
    names = F.array(*[F.lit(n) for n in tiers])
    return chosen.select(doc, F.get(names, F.col("h.a")).alias("attribute"), F.col("h.t").alias("tier"), F.col("h.c").alias(chunk))


def preamble_and_attributes(chunks: DataFrame, doc: str = "doc_id", chunk: str = "chunk_idx", tiers: dict[str, tuple[str, ...]] = P.LOAN_TIERS, budget: int = P.PREAMBLE_CHARS) -> DataFrame:
    """``doc, chunk, attribute, ord``: the leading chunks within the budget (no attribute), then one free chunk for each attribute in turn."""
    own = Window.partitionBy(doc).orderBy(chunk)
    before = F.coalesce(F.sum(F.length("text")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leading = chunks.select(doc, chunk, before.alias("before"), F.row_number().over(own).alias("nth")).where(F.col("before") < budget)
    leading = materialize(leading.select(doc, chunk, "nth"), "preamble")
    found = tiered_first_match(chunks, doc, chunk, tiers, leading)
    place = F.array_position(F.array(*[F.lit(n) for n in tiers]), F.col("attribute")).cast("int")
    first = leading.select(doc, chunk, F.lit(None).cast("string").alias("attribute"), F.struct(F.lit(0).alias("part"), F.col("nth").alias("nth")).alias("ord"))
    then = found.select(doc, F.col(chunk).cast(dict(chunks.dtypes)[chunk]).alias(chunk), "attribute", F.struct(F.lit(1).alias("part"), place.alias("nth")).alias("ord"))
    return first.unionByName(then)
