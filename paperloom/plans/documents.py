"""The whole job over contract documents: blocks to exported results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import patterns as P
from ..operators.audit import audited
from ..operators.completion import Backend
from ..operators.definitions import definitions_text, find_definition, looked_up, resolvable_term
from ..operators.extraction import extract_clauses, extract_loan_terms
from ..operators.formulas import json_string, resolve_bounded
from ..operators.layout import chunk_blocks, full_texts
from ..operators.retrieval import Embedder, select_candidates
from ..schemas import LISTS, PARTIES
from .stage import materialize

PLACE = ["category", "place"]


def extract_documents(
    blocks: DataFrame,
    backend: Backend,
    embedder: Embedder | None = None,
    k: int | None = None,
    cache: str | None = None,
    queries_of: tuple[str, ...] = P.REFERENCE_QUERIES,
    keywords: tuple[str, ...] = P.COVENANT_KEYWORDS,
    floor: float = P.LEAST_SCORE,
) -> DataFrame:
    """``doc_id, json``: the exported result of each document with blocks.

    ``blocks``: ``doc_id, block_idx, text, page, section_label, start_char, end_char``. Chunks are
    narrowed to candidates, the backend extracts clauses and loan terms, every quote and number is
    audited, and the definitions of covenants and of values that only name a term are resolved. A
    document without candidates has empty lists. Steps are written, so a lost executor repeats one.
    """
    blocks = materialize(blocks, "blocks")
    chunks = materialize(chunk_blocks(blocks), "chunks")
    texts = materialize(full_texts(blocks), "full-texts")
    definitions = materialize(definitions_text(chunks), "definitions")
    candidates = select_candidates(chunks, embedder, queries_of, keywords, floor, k).select("doc_id", "rank", "text", "page", "section_label")
    lists = extract_clauses(materialize(candidates, "candidates"), backend, cache)
    loans = materialize(extract_loan_terms(chunks, backend, cache), "loan-terms")
    return export(texts, definitions, lists, loans, backend, cache)


def placed_items(lists: dict[str, DataFrame]) -> DataFrame:
    """``doc_id, category, place, item (JSON), name, threshold, comparison, quote`` of all lists; places count from 0 in each."""
    parts = []
    for name, items in lists.items():
        rows = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_idx", F.to_json("item", {"ignoreNullFields": "false"}).alias("json")))).alias("x"))
        rows = rows.select("doc_id", F.posexplode("x").alias("place", "x"))
        item = F.from_json("x.json", LISTS[name])
        number = item["threshold"] if name == "financial_covenants" else F.lit(None).cast("double")
        stated = item["comparison"] if name == "financial_covenants" else F.lit(None).cast("string")
        parts.append(rows.select("doc_id", F.lit(name).alias("category"), "place", F.col("x.json").alias("item"), item["name"].alias("name"), number.alias("threshold"), stated.alias("comparison"), item["citation"]["source_text"].alias("quote")))
    return reduce(DataFrame.unionByName, parts)


def placed_terms(loans: DataFrame) -> DataFrame:
    """The same for cited values of loan terms; the name is the value."""

    def listed(field: str) -> Column:
        return F.transform(F.col("loan_terms")[field], lambda x, i: F.struct(F.lit(field).alias("category"), i.alias("place"), x.alias("c")))

    parties = [listed(f) for f in PARTIES]
    single = F.array(*[F.struct(F.lit(f).alias("category"), F.lit(0).alias("place"), F.col("loan_terms")[f].alias("c")) for f in P.LOAN_FIELDS])
    rows = loans.select("doc_id", F.explode(F.concat(*parties, single)).alias("x")).select("doc_id", "x.*").where("c IS NOT NULL")
    none = F.lit(None)
    return rows.select("doc_id", *PLACE, F.to_json("c", {"ignoreNullFields": "false"}).alias("item"), F.col("c.value").alias("name"), none.cast("double").alias("threshold"), none.cast("string").alias("comparison"), F.col("c.citation.source_text").alias("quote"))


def _more(json: Column, fields: list[tuple[str, Column]]) -> Column:
    """A JSON object with more fields, given as JSON; null ones are left out."""
    extra = [F.coalesce(F.concat(F.lit(f',"{n}":'), c), F.lit("")) for n, c in fields]
    return F.concat(json.substr(F.lit(1), F.length(json) - 1), *extra, F.lit("}"))


def audit_json(financial: Column) -> Column:
    """The audit of an item as JSON; numbers and directions only of financial covenants, re-parsed ones only where there are any."""
    recomputed = C.threshold_of("quote")
    checks = {
        "calculator_checked": recomputed.isNotNull(),
        "calculator_match": C.covenant_checks("quote", "comparison", "threshold"),
        "citation_grounded": C.grounded("threshold", "quote"),
        "recomputed_threshold": recomputed,
        "recomputed_comparison": F.when(recomputed.isNotNull(), C.comparison_of("quote")),
    }
    return F.to_json(F.struct("citation_verified", F.round("citation_similarity", 3).alias("citation_similarity"), *[F.when(financial, c).alias(n) for n, c in checks.items()]))


def export(texts: DataFrame, definitions: DataFrame, lists: dict[str, DataFrame], loans: DataFrame, backend: Backend, cache: str | None = None) -> DataFrame:
    """``doc_id, json`` of every document in ``texts(doc_id, full_text)`` from what was extracted of it."""
    items = materialize(placed_items(lists).unionByName(placed_terms(loans)), "items")
    audits = audited(items.select("doc_id", *PLACE, "quote"), texts, PLACE)
    financial = F.col("category") == "financial_covenants"
    names = items.where(financial).select("doc_id", "name")
    meant = looked_up(names, definitions, "definitions_text", "name", find_definition, "definition")
    values = items.where(F.col("category").isin(*P.CHAINED_FIELDS)).select("doc_id", "name")
    named = looked_up(values, definitions, "definitions_text", "name", resolvable_term, "root")
    roots = materialize(meant.select("doc_id", F.col("name").alias("root")).union(named.select("doc_id", "root")).distinct(), "roots")
    formulas = resolve_bounded(roots, definitions, texts, backend, cache).where("term = root").select("doc_id", "root", "status", F.col("json").alias("formula_json"))
    formulas = materialize(formulas, "root-formulas")
    of_names = meant.withColumn("category", F.lit("financial_covenants")).join(formulas.withColumnRenamed("root", "name").drop("status"), ["doc_id", "name"], "left")
    of_values = named.join(formulas.where("status = 'resolved'").drop("status"), ["doc_id", "root"]).select("doc_id", "name", F.col("formula_json").alias("value_json"))
    rows = items.join(audits, ["doc_id", *PLACE])
    rows = rows.join(of_names.withColumnRenamed("formula_json", "definition_json"), ["doc_id", "category", "name"], "left")
    chained = rows.where(F.col("category").isin(*P.CHAINED_FIELDS)).join(of_values, ["doc_id", "name"], "left")
    others = rows.where(~F.col("category").isin(*P.CHAINED_FIELDS)).withColumn("value_json", F.lit(None).cast("string"))
    rows = chained.unionByName(others)
    definition = F.when(financial, json_string(F.col("definition")))
    whole = _more(F.col("item"), [("audit", audit_json(financial)), ("definition", definition), ("resolved_definition", F.col("definition_json")), ("resolved_value", F.col("value_json"))])
    held = rows.select("doc_id", *PLACE, whole.alias("json")).groupBy("doc_id", "category").agg(F.array_sort(F.collect_list(F.struct("place", "json"))).alias("x"))
    held = held.select("doc_id", "category", F.transform("x", lambda x: x["json"]).alias("x"))
    by_doc = held.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "x"))).alias("m"))
    known = texts.select("doc_id").join(by_doc, "doc_id", "left")

    def listed(n: str) -> Column:
        return F.concat(F.lit("["), F.coalesce(F.array_join(F.col("m")[n], ","), F.lit("")), F.lit("]"))

    def single(n: str) -> Column:
        return F.coalesce(F.get(F.col("m")[n], F.lit(0)), F.lit("null"))

    def pairs(names, value) -> list[Column]:
        return [c for i, n in enumerate(names) for c in (F.lit(f'{"," if i else ""}"{n}":'), value(n))]

    terms = F.concat(F.lit("{"), *pairs(PARTIES, listed), F.lit(","), *pairs(P.LOAN_FIELDS, single), F.lit("}"))
    return known.select("doc_id", F.concat(F.lit("{"), *pairs(LISTS, listed), F.lit(',"loan_terms":'), terms, F.lit("}")).alias("json"))
