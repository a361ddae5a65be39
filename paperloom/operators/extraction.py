"""Extraction of clauses and loan terms by a backend, with citations pinned to the real place of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.columns import location_label, normalized
from ..plans.stage import materialize
from ..schemas import CITED, LISTS, PARTIES
from . import prompts
from .audit import keep_first
from .completion import Backend, completed
from .retrieval import preamble_and_attributes


def pinned(item: Column, page: str | Column = "page", label: str | Column = "section_label") -> Column:
    """An item whose citation has the chunk's page and label, whatever the answer said; null stays null."""
    page, label = (F.col(c) if isinstance(c, str) else c for c in (page, label))
    return F.when(item.isNotNull(), item.withField("citation.page", page.cast("int")).withField("citation.section_label", label.cast("string")))


def candidate_lines(candidates: DataFrame, most: int = 80) -> DataFrame:
    """``doc_id, rank, line``: what a reviewer sees of each candidate before it is asked: its place, why it was chosen, its score and beginning."""
    preview = F.replace(F.substring("text", 1, most), F.lit("\n"), F.lit(" "))
    more = F.when(F.length("text") > most, F.lit("...")).otherwise(F.lit(""))
    basis = F.when(F.col("keyword_match"), F.lit("keyword+embedding")).otherwise(F.lit("embedding"))
    line = F.format_string('[%d] %s | basis=%s | score=%.3f | "%s%s"', F.col("rank"), location_label("page", "section_label"), basis, F.col("score"), preview, more)
    return candidates.select("doc_id", "rank", line.alias("line"))


def ask_clauses(candidates: DataFrame, backend: Backend, cache: str | None = None) -> DataFrame:
    """``doc_id, rank, page, section_label, value, fault``: one answer for each candidate clause.

    ``candidates``: ``doc_id, rank, text, page, section_label``. Equal clauses are asked once.
    """
    asked = candidates.select("doc_id", "rank", "page", "section_label", F.lit(prompts.CLAUSE_SYSTEM).alias("system"), prompts.clause_prompt("text").alias("user"))
    return materialize(completed(asked, backend, "result", cache), "clause-answers")


def listed(answers: DataFrame, name: str) -> DataFrame:
    """``doc_id, rank, item_idx, item``: one list of all answers of a document, pinned, in the order of rank and place."""
    rows = answers.select("doc_id", "rank", "page", "section_label", F.posexplode(F.col("value")[name]).alias("item_idx", "item"))
    return rows.select("doc_id", "rank", "item_idx", pinned(F.col("item")).alias("item"))


def first_by_citation(items: DataFrame) -> DataFrame:
    """Of a document's items with equal citations, but for white space and case, the first."""
    return keep_first(items, [F.col("doc_id"), normalized(F.col("item.citation.source_text"))], [F.col("rank"), F.col("item_idx")])


def extract_clauses(candidates: DataFrame, backend: Backend, cache: str | None = None) -> dict[str, DataFrame]:
    """For each list ``doc_id, rank, item_idx, item``: what the backend finds in the candidates, pinned, without repeats.

    Answers that aren't of the type give no items; ``ask_clauses`` has their faults.
    """
    answers = ask_clauses(candidates, backend, cache)
    return {name: first_by_citation(listed(answers, name)) for name in LISTS}


def first_by_value(items: str | Column) -> Column:
    """Of cited values that are equal but for white space and case, the first; in order."""
    seen = F.transform(items, lambda x: F.struct(normalized(x["value"]).alias("key"), x.alias("item")))
    keys = F.transform(seen, lambda x: x["key"])
    return F.transform(F.filter(seen, lambda x, i: F.array_position(keys, x["key"]) == i + 1), lambda x: x["item"])


def merged_terms(parts: DataFrame) -> DataFrame:
    """``doc_id, loan_terms`` from ``doc_id, ord, terms``: lists joined in order without repeats, of other fields the first that is there."""
    ordered = {n: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("terms")[n].alias("items")))), lambda x: x["items"])) for n in PARTIES}
    firsts = {n: F.min_by(F.col("terms")[n], F.when(F.col("terms")[n].isNotNull(), F.col("ord"))) for n in P.LOAN_FIELDS}
    found = parts.groupBy("doc_id").agg(*[c.alias(n) for n, c in {**ordered, **firsts}.items()])
    return found.select("doc_id", F.struct(*[first_by_value(n).alias(n) for n in PARTIES], *P.LOAN_FIELDS).alias("loan_terms"))


def extract_loan_terms(chunks: DataFrame, backend: Backend, cache: str | None = None) -> DataFrame:
    """``doc_id, loan_terms`` of every document with chunks: the backend's answers over the leading chunks and one for each attribute, merged.

    A document of which nothing is found has empty lists and null fields.
    """
    chosen = preamble_and_attributes(chunks).join(chunks.select("doc_id", "chunk_idx", "text", "page", "section_label"), ["doc_id", "chunk_idx"])
    asked = chosen.select("doc_id", "ord", "page", "section_label", F.lit(prompts.LOAN_SYSTEM).alias("system"), prompts.loan_prompt("text").alias("user"))
    answers = materialize(completed(asked, backend, "loan_terms", cache), "loan-answers").where("value IS NOT NULL")
    terms = F.col("value")
    for n in PARTIES:
        terms = terms.withField(n, F.transform(F.col("value")[n], lambda x: pinned(x)))
    for n in P.LOAN_FIELDS:
        terms = terms.withField(n, pinned(F.col("value")[n]))
    found = merged_terms(answers.select("doc_id", "ord", terms.alias("terms")))
    nothing = F.struct(*[F.array().cast(f"array<{CITED}>").alias(n) for n in PARTIES], *[F.lit(None).cast(CITED).alias(n) for n in P.LOAN_FIELDS])
    return chunks.select("doc_id").distinct().join(found, "doc_id", "left").withColumn("loan_terms", F.coalesce("loan_terms", nothing))
