"""Formulas of defined terms, resolved from the leaves up with one batch of prompts for each level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.columns import carve_outs
from ..plans.stage import materialize
from . import prompts
from .completion import Backend, completed
from .definitions import TermGraph, definitions_text, discover_terms, looked_up, order_below, provenance, scoped_definition, split_by_terms, unresolved_reference

KEY = ["doc_id", "root", "term"]
RESOLVED, REVIEW = "resolved", "requires_human_review"


def json_string(text: Column) -> Column:
    """A string as JSON; ``null`` for null."""
    made = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(made, F.lit(2), F.length(made) - 2))


def extract_defined_terms(chunks: DataFrame, backend: Backend, cache: str | None = None) -> DataFrame:
    """``doc_id, place, term, definition, source_clause, fault``: one answer for each declaration of the definitions section."""
    pieces = definitions_text(chunks).select("doc_id", F.posexplode(split_by_terms("definitions_text")).alias("place", "text"))
    asked = pieces.select("doc_id", "place", F.lit(prompts.TERM_SYSTEM).alias("system"), prompts.term_prompt("text").alias("user"))
    found = materialize(completed(asked, backend, "term", cache), "term-answers")
    return found.select("doc_id", "place", "value.term", F.col("value.definition_text").alias("definition"), "value.source_clause", "fault")


def _asked(rows: DataFrame, system: str, user: Column, kind: str, backend: Backend, cache: str | None) -> DataFrame:
    return completed(rows.withColumn("system", F.lit(system)).withColumn("user", user), backend, kind, cache)


def resolve_formulas(nodes: DataFrame, edges: DataFrame, documents: DataFrame, backend: Backend, cache: str | None = None) -> DataFrame:
    """``doc_id, root, term, formula, status, reason, components, carve_outs, provenance, json`` of every node.

    ``nodes``: ``doc_id, root, term, definition, source_clause`` (no definition: a stub for review);
    ``edges``: ``doc_id, root, parent, child`` without cycles; ``documents``: ``doc_id, full_text``.
    A leaf is asked for its formula, any other term for one over those of its children. A term that
    refers to a section for a meaning that no child has is first looked for in the whole document;
    if it isn't there, the term is for review. ``json`` nests the components.
    Levels run one after the other and are written; equal prompts of all documents are asked once.
    """
    kids = edges.groupBy("doc_id", "root", F.col("parent").alias("term")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    empty = F.array().cast("array<string>")
    todo = materialize(nodes.join(kids, KEY, "left").withColumn("children", F.coalesce("children", empty)), "formula-nodes")
    links = edges.select("doc_id", "root", F.col("parent").alias("term"), "child").distinct()
    done: list[DataFrame] = []
    left = todo
    while left.head(1):
        if done:
            made = reduce(DataFrame.unionByName, done)
            known = made.select("doc_id", "root", F.col("term").alias("child"), F.struct("term", F.when(F.col("status") == RESOLVED, F.col("formula")).alias("formula"), "json").alias("c"))
            parts = links.join(known, ["doc_id", "root", "child"]).groupBy(*KEY).agg(F.array_sort(F.collect_list("c")).alias("parts"))
            ready = left.join(parts, KEY).where(F.size("parts") == F.size("children"))
        else:
            ready = left.where(F.size("children") == 0).withColumn("parts", F.array().cast("array<struct<term:string,formula:string,json:string>>"))
        ready = materialize(ready, "formula-level")
        if not ready.head(1):
            raise ValueError("the references between terms form a cycle")
        level = _level(ready, documents, backend, cache)
        done.append(level)
        left = materialize(left.join(level.select(*KEY), KEY, "left_anti"), "formula-rest")
    columns = [*KEY, "formula", "status", "reason", "components", "carve_outs", "provenance", "json"]
    if not done:
        return todo.select(*KEY, *[F.lit("").alias(c) for c in ("formula", "status", "reason")], *[empty.alias(c) for c in ("components", "carve_outs", "provenance")], F.lit("").alias("json"))
    return reduce(DataFrame.unionByName, done).select(*columns)


def _level(ready: DataFrame, documents: DataFrame, backend: Backend, cache: str | None) -> DataFrame:
    """The nodes of one level with their formulas, written."""
    state = [*KEY, "definition", "source_clause", "children", "parts"]
    known = ready.where("definition IS NOT NULL").withColumn("ref", F.when(F.size("children") > 0, unresolved_reference("definition", "children")))
    missing = ready.where("definition IS NULL").select(*state, F.lit("").alias("formula"), F.lit("term_not_found_in_definitions_section").alias("reason"))
    leaves = known.where(F.size("children") == 0)
    leaves = _asked(leaves.select(*state), prompts.LEAF_SYSTEM, prompts.leaf_prompt("definition"), "fragment", backend, cache)
    whole = known.where(F.size("children") > 0)
    places = looked_up(whole, documents, "full_text", "ref", scoped_definition, "location")
    found = _asked(places, prompts.TERM_SYSTEM, prompts.term_prompt("location"), "term", backend, cache)
    found = materialize(found.select("doc_id", "ref", F.col("value.definition_text").alias("supplement")), "supplements")
    whole = whole.join(found, ["doc_id", "ref"], "left")
    lost = whole.where("ref IS NOT NULL AND supplement IS NULL").select(*state, F.lit("").alias("formula"), F.lit("unresolved_reference").alias("reason"))
    composed = whole.where("ref IS NULL OR supplement IS NOT NULL").select(*state, "supplement")
    composed = _asked(composed, prompts.COMPOSE_SYSTEM, prompts.compose_prompt("definition", "parts", "supplement"), "fragment", backend, cache)
    answered = [x.select(*state, F.coalesce("value.formula", F.lit("")).alias("formula"), F.col("fault").alias("reason")) for x in (leaves, composed)]
    every = reduce(DataFrame.unionByName, [missing, lost, *answered])
    held = every.select(
        *KEY,
        "formula",
        F.when(F.col("reason").isNull(), RESOLVED).otherwise(REVIEW).alias("status"),
        "reason",
        F.when(F.col("definition").isNotNull(), F.col("children")).otherwise(F.array().cast("array<string>")).alias("components"),
        F.coalesce(carve_outs("definition"), F.array().cast("array<string>")).alias("carve_outs"),
        F.when(F.col("definition").isNotNull(), provenance("source_clause")).otherwise(F.array().cast("array<string>")).alias("provenance"),
        "parts",
    )
    inner = F.array_join(F.transform("parts", lambda p: F.concat(json_string(p["term"]), F.lit(":"), p["json"])), ",")
    nested = F.concat(
        F.lit('{"term":'), json_string(F.col("term")), F.lit(',"formula":'), json_string(F.col("formula")), F.lit(',"components":{'), inner,
        F.lit('},"carve_outs":'), F.to_json("carve_outs"), F.lit(',"provenance":'), F.to_json("provenance"),
        F.lit(',"status":'), json_string(F.col("status")), F.lit(',"reason":'), json_string(F.col("reason")), F.lit("}"),
    )
    return materialize(held.withColumn("json", nested).drop("parts"), "formulas")


def resolve_bounded(roots: DataFrame, definitions: DataFrame, documents: DataFrame, backend: Backend, cache: str | None = None, max_terms: int = P.MAX_TERMS, max_depth: int = P.MAX_DEPTH) -> DataFrame:
    """``resolve_formulas`` over the bounded chain below each of ``roots(doc_id, root)``; the root's own row answers it."""
    nodes, edges = discover_terms(roots, definitions, max_terms, max_depth)
    return resolve_formulas(nodes.select(*KEY, "definition", F.lit(None).cast("string").alias("source_clause")), edges, documents, backend, cache)


def resolve_in_full(roots: DataFrame, chunks: DataFrame, documents: DataFrame, backend: Backend, cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``resolve_formulas`` over all terms that a document's definitions declare, and the cycles found among them.

    Of a term declared more than once the last declaration counts.
    """
    terms = extract_defined_terms(chunks, backend, cache).where("fault IS NULL AND term <> ''")
    graph, cycles = TermGraph.of_terms(terms.select("doc_id", "term", "definition"))
    last = terms.groupBy("doc_id", "term").agg(F.max_by(F.struct("definition", "source_clause"), "place").alias("d")).select("doc_id", "term", "d.*")
    order = materialize(order_below(roots, graph.edges), "reached")
    nodes = order.join(last, ["doc_id", "term"], "left").select(*KEY, "definition", "source_clause")
    edges = order.select("doc_id", "root", F.col("term").alias("parent")).join(graph.edges, ["doc_id", "parent"]).select("doc_id", "root", "parent", "child")
    return resolve_formulas(nodes, edges, documents, backend, cache), cycles
