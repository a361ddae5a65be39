"""Defined terms: where their definitions stand, what they refer to, and in which order to resolve them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.columns import flattened, looks_like_definition, quoted, term_appears, title_phrases
from ..plans.stage import materialize


def definition_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks under a label that a definition or a definitions heading has, and chunks that open with a definition."""
    opener = looks_like_definition("text")
    heading = F.coalesce(F.col("section_label").rlike(P.DEFINITIONS_HEADING), F.lit(False))
    labels = chunks.where((opener | heading) & (F.col("section_label") != "")).select("doc_id", "section_label").distinct()
    marked = chunks.join(labels.withColumn("labelled", F.lit(True)), ["doc_id", "section_label"], "left")
    return marked.where(F.coalesce("labelled", F.lit(False)) | opener).select(*chunks.columns)


def definitions_text(chunks: DataFrame) -> DataFrame:
    """``doc_id, definitions_text``: the definition chunks of each document in order."""
    found = definition_chunks(chunks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))).alias("c"))
    return found.select("doc_id", F.array_join(F.transform("c", lambda x: x["text"]), "\n").alias("definitions_text"))


def term_pattern(term: Column) -> Column:
    """The words of a term with any white space between; the last in singular or plural."""
    words = F.split(flattened(term), " ")
    last = F.element_at(words, -1)
    head = F.array_join(F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: F.concat(quoted(w), F.lit(r"\s+"))), "")

    def either(cut: int, end: str) -> Column:
        return F.concat(F.lit("(?:"), quoted(last), F.lit("|"), quoted(F.substring(last, F.lit(1), F.length(last) - cut)), F.lit(end + ")"))

    tail = (
        F.when(last.rlike("(?i)[^aeiou](?-i)ies$"), either(3, "y"))
        .when(last.rlike("(?i)[^aeiou](?-i)y$"), either(1, "ies"))
        .when(last.rlike(".s$"), either(1, ""))
        .otherwise(F.concat(quoted(last), F.lit("s?")))
    )
    return F.concat(head, tail)


def find_definition(term: Column, text: Column) -> Column:
    """The text after the leftmost declaration of the term, up to the next declaration; null without one."""
    start, end = F.lit('(?isU)["“]\\s*'), F.lit('\\s*["”]?\\s*' + P.QUALIFIER + P.MEANS + r"\s*,?\s*(.*?)(?=(?:" + P.OPENER + r")|\z)")
    return F.nullif(flattened(F.call_function("regexp_extract", text, F.concat(start, term_pattern(term), end), F.lit(1))), F.lit(""))


def split_by_terms(text: str | Column) -> Column:
    """Pieces that start with a straight-quoted declaration, trimmed, without empty ones."""
    pieces = F.split(text, '(?=(?U)"[A-Z][^"]{0,80}"\\s+' + P.MEANS + r"\b)")
    return F.filter(F.transform(pieces, F.trim), lambda x: x != "")


def reference_edges(terms: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, parent, child``: the other terms of a document that a definition names.

    ``terms``: ``doc, term, definition``. Terms meet definitions of their own document only; since a
    term may start inside a word, no word index can prune further without losing links.
    """
    child = terms.select(doc, F.col("term").alias("child")).distinct()
    parent = terms.select(doc, F.col("term").alias("parent"), "definition")
    pairs = parent.join(child, doc).where(F.col("parent") != F.col("child")).where(term_appears("child", "definition"))
    return pairs.select(doc, "parent", "child").distinct()


def bounded_chain(edges: DataFrame, roots: DataFrame, max_depth: int = P.MAX_DEPTH, max_terms: int = P.MAX_TERMS) -> DataFrame:
    """``root, term, depth, place``: breadth first from each root, each term once, at most ``max_terms`` terms.

    ``edges``: ``parent, child, ord``. Level by level with a join each, so a level's terms come in
    the order of their parents and of the references in them.
    """
    level = roots.select("root", F.col("root").alias("term"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("place"))
    reached = level
    for depth in range(1, max_depth + 1):
        step = level.join(edges, F.col("term") == F.col("parent")).select("root", F.col("child").alias("term"), "place", "ord")
        first = step.groupBy("root", "term").agg(F.min(F.struct("place", "ord", "term")).alias("at"))
        new = first.join(reached.select("root", "term"), ["root", "term"], "left_anti")
        n = reached.groupBy("root").agg(F.max("place").alias("n"))
        own = Window.partitionBy("root").orderBy("at")
        placed = new.withColumn("nth", F.row_number().over(own)).join(n, "root")
        level = placed.select("root", "term", F.lit(depth).alias("depth"), (F.col("n") + F.col("nth")).alias("place")).where(F.col("place") <= max_terms)
        level = materialize(level, f"chain-{depth}")
        reached = reached.unionByName(level)
    return reached


def looked_up(wanted: DataFrame, texts: DataFrame, text: str, term: str, find: Callable[[Column, Column], Column], found: str) -> DataFrame:
    """``doc_id, term, found``, written: what ``find(term, text)`` gives for the wanted terms of each document, without nulls.

    A document's terms are gathered, so its text is read once and copied for none of them.
    """
    asked = wanted.where(F.col(term).isNotNull()).groupBy("doc_id").agg(F.collect_set(term).alias("_terms"))
    both = texts.select("doc_id", F.col(text).alias("_text")).join(asked, "doc_id")
    pairs = both.select("doc_id", F.explode(F.transform("_terms", lambda t: F.struct(t.alias(term), find(t, F.col("_text")).alias(found)))).alias("_f"))
    return materialize(pairs.select("doc_id", "_f.*").where(F.col(found).isNotNull()), "looked-up")


def discover_terms(roots: DataFrame, definitions: DataFrame, max_terms: int = P.MAX_TERMS, max_depth: int = P.MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """The chain of terms below each root: ``doc_id, root, term, depth, nth, definition`` and ``doc_id, root, parent, child, ord``.

    ``roots``: ``doc_id, root``; ``definitions``: ``doc_id, definitions_text``. Breadth first: a term's
    definition is looked up, its title-case phrases that no earlier term of the root has named are its
    children. Stops at ``max_depth`` or once ``max_terms`` definitions are found; what is still queued
    then has no definition here, even if the document has one.
    """
    key = ["doc_id", "root"]
    level = roots.select(*key, F.col("root").alias("term"), F.lit(0).alias("depth"), F.lit(1).alias("nth")).distinct()
    nodes, edges, seen, known = [], [], level.select(*key, "term"), None
    for depth in range(max_depth + 1):
        found = looked_up(level, definitions, "definitions_text", "term", find_definition, "definition")
        there = level.join(found, ["doc_id", "term"], "left")
        earlier = Window.partitionBy(*key).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
        there = there.withColumn("before", F.coalesce(F.sum(F.col("definition").isNotNull().cast("int")).over(earlier), F.lit(0)))
        if known is not None:
            there = there.join(known, key, "left").withColumn("before", F.col("before") + F.coalesce("n", F.lit(0))).drop("n")
        there = there.withColumn("definition", F.when(F.col("before") < max_terms, F.col("definition")))
        there = materialize(there.select(*key, "term", "depth", "nth", "definition"), f"terms-{depth}")
        nodes.append(there)
        if depth == max_depth:
            break
        counts = there.groupBy(*key).agg(F.count("definition").cast("int").alias("n"))
        known = materialize((counts if known is None else counts.unionByName(known)).groupBy(*key).agg(F.sum("n").cast("int").alias("n")), "found-terms")
        named = there.where("definition IS NOT NULL").select(*key, F.col("term").alias("parent"), "nth", F.posexplode(title_phrases(F.col("definition"))).alias("pos", "child"))
        first = named.where("child <> parent").groupBy(*key, "child").agg(F.min(F.struct("nth", "pos", "parent")).alias("at"))
        new = materialize(first.join(seen.withColumnRenamed("term", "child"), [*key, "child"], "left_anti"), f"edges-{depth}")
        edges.append(new.select(*key, F.col("at.parent").alias("parent"), "child", F.col("at.pos").alias("ord")))
        order = Window.partitionBy(*key).orderBy("at")
        level = materialize(new.select(*key, F.col("child").alias("term"), F.lit(depth + 1).alias("depth"), F.row_number().over(order).alias("nth")), f"queue-{depth}")
        seen = seen.unionByName(level.select(*key, "term"))
    none = spark_empty(roots, f"doc_id {dict(roots.dtypes)['doc_id']}, root string, parent string, child string, ord int")
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges, none)


def spark_empty(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def _below(pairs: pd.DataFrame) -> dict[str, list[str]]:
    """The children of each term in code-point order."""
    below: dict[str, list[str]] = {}
    for a, b in sorted(set(zip(pairs["parent"], pairs["child"], strict=True))):
        below.setdefault(a, []).append(b)
        below.setdefault(b, [])
    return below


def _walk(below: dict[str, list[str]], roots: Iterable[str]) -> tuple[list[str], list[list[str]]]:
    """Terms after their children, and the closed paths of edges that lead back to a term being walked."""
    state: dict[str, int] = {}
    order: list[str] = []
    cycles: list[list[str]] = []
    for root in roots:
        if root in state:
            continue
        state[root] = 1
        path, stack = [root], [iter(below.get(root, ()))]
        while stack:
            for child in stack[-1]:
                if state.get(child) == 1:
                    cycles.append([*path[path.index(child) :], child])
                elif child not in state:
                    state[child] = 1
                    path.append(child)
                    stack.append(iter(below.get(child, ())))
                    break
            else:
                stack.pop()
                state[path[-1]] = 2
                order.append(path.pop())
    return order, cycles


def _known(edges: DataFrame, group: str) -> DataFrame:
    return edges.where("parent IS NOT NULL AND child IS NOT NULL").select(group, "parent", "child")


def cycles_of(edges: DataFrame, group: str = "doc_id") -> DataFrame:
    """``group, nth, terms``: each cycle that a depth-first walk in code-point order closes, as a path that ends where it begins.

    A group is one document's graph of terms, walked in one task.
    """
    kind = dict(edges.dtypes)[group]

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        below = _below(part)
        _, cycles = _walk(below, sorted(below))
        return pd.DataFrame({group: [part[group].iloc[0]] * len(cycles), "nth": range(len(cycles)), "terms": pd.Series(cycles, dtype=object)})

    return _known(edges, group).groupBy(group).applyInPandas(walk, f"{group} {kind}, nth int, terms array<string>")


def without_cycles(edges: DataFrame, cycles: DataFrame, group: str = "doc_id") -> DataFrame:
    """``edges`` without the last edge of each cycle."""
    closing = cycles.select(group, F.element_at("terms", -2).alias("parent"), F.element_at("terms", -1).alias("child")).distinct()
    return edges.join(closing, [group, "parent", "child"], "left_anti")


def resolution_order(edges: DataFrame, group: str = "doc_id") -> DataFrame:
    """``group, term, place, on_cycle``: children before parents, cycles cut at the edge that closes one.

    ``edges``: ``group, parent, child``. A group is one document's term graph; the walk is
    iterative and takes children in code-point order. ``on_cycle`` marks terms whose edge was cut.
    """
    kind = dict(edges.dtypes)[group]

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        below = _below(part)
        order, cycles = _walk(below, sorted(below))
        closing = {c[-2] for c in cycles}
        rows = [(part[group].iloc[0], t, i, t in closing) for i, t in enumerate(order)]
        return pd.DataFrame(rows, columns=[group, "term", "place", "on_cycle"])

    return _known(edges, group).groupBy(group).applyInPandas(walk, f"{group} {kind}, term string, place long, on_cycle boolean")


def order_below(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, root, term, place``: the terms that each root reaches, children before parents; a root without edges alone.

    ``roots``: ``doc_id, root``; ``edges``: ``doc_id, parent, child`` without cycles.
    """
    kind = dict(roots.dtypes)["doc_id"]

    def walk(own: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        below = _below(part)
        rows = [(own["doc_id"].iloc[0], r, t, i) for r in sorted(set(own["root"])) for i, t in enumerate(_walk(below, [r])[0])] if len(own) else []
        return pd.DataFrame(rows, columns=["doc_id", "root", "term", "place"])

    pairs = roots.select("doc_id", "root").groupBy("doc_id").cogroup(_known(edges, "doc_id").groupBy("doc_id"))
    return pairs.applyInPandas(walk, f"doc_id {kind}, root string, term string, place long")


@dataclass(frozen=True)
class TermGraph:
    """Terms and references between them, by document; each change gives a new graph."""

    nodes: DataFrame  # doc_id, term
    edges: DataFrame  # doc_id, parent, child

    @classmethod
    def of_terms(cls, terms: DataFrame) -> tuple[TermGraph, DataFrame]:
        """The graph of ``terms(doc_id, term, definition)`` without the edges that close cycles, and those cycles for review."""
        edges = materialize(reference_edges(terms), "references")
        cycles = materialize(cycles_of(edges), "cycles")
        return cls(terms.select("doc_id", "term").distinct(), without_cycles(edges, cycles)), cycles

    def with_node(self, nodes: DataFrame) -> TermGraph:
        return TermGraph(self.nodes.unionByName(nodes.select("doc_id", "term")).distinct(), self.edges)

    def with_edge(self, edges: DataFrame) -> TermGraph:
        ends = edges.select("doc_id", F.explode(F.array("parent", "child")).alias("term"))
        return TermGraph(self.with_node(ends).nodes, self.edges.unionByName(edges.select("doc_id", "parent", "child")).distinct())

    def without_edge(self, edges: DataFrame) -> TermGraph:
        return TermGraph(self.nodes, self.edges.join(edges.select("doc_id", "parent", "child"), ["doc_id", "parent", "child"], "left_anti"))

    def children(self) -> DataFrame:
        """``doc_id, term, children``: of every node, in code-point order."""
        held = self.edges.groupBy("doc_id", F.col("parent").alias("term")).agg(F.array_sort(F.collect_set("child")).alias("children"))
        return self.nodes.join(held, ["doc_id", "term"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def inline_definition(term: Column, text: Column) -> Column:
    """The first sentence anywhere in a text that declares the term in straight quotes, of at most 1000 characters; null without one."""
    pattern = F.concat(F.lit('(?isU)"'), quoted(term), F.lit('"\\s+(?:means|shall mean)\\s*,?\\s*.{0,1000}?(?:\\.\\s|\\z)'))
    return F.nullif(stripped(F.call_function("regexp_extract", text, pattern, F.lit(0))), F.lit(""))


def other_phrasing(term: Column) -> Column:
    """The term without the first of the prefixes that later mentions drop."""
    out = term
    for prefix in reversed(P.DROPPED_PREFIXES):
        out = F.when(F.startswith(term, F.lit(prefix)), F.substring(term, F.lit(len(prefix) + 1), F.length(term))).otherwise(out)
    return out


def scoped_definition(term: Column, text: Column, hops: int = P.MAX_HOPS) -> Column:
    """``inline_definition`` of the term, else of its other phrasing, and so on for ``hops`` tries."""
    tries = []
    for _ in range(hops):
        tries.append(inline_definition(term, text))
        term = other_phrasing(term)
    return F.coalesce(*tries)


def cross_reference(definition: str | Column) -> Column:
    """The term of which a definition says that its meaning is set forth in some section; null without one."""
    return F.nullif(F.regexp_extract(definition, P.CROSS_REFERENCE, 1), F.lit(""))


def unresolved_reference(definition: str | Column, children: str | Column) -> Column:
    """The cross reference of a definition if it isn't among the names of its children."""
    ref = cross_reference(definition)
    return F.when(~F.array_contains(children, ref), ref)


def resolvable_term(value: Column, definitions: Column) -> Column:
    """The first title-case phrase of a value without digits that the definitions declare; null without one."""
    first = F.get(F.filter(title_phrases(value), lambda p: find_definition(p, definitions).isNotNull()), F.lit(0))
    return F.when(~value.rlike(r"(?U)\d") & (definitions != ""), first)


def provenance(clause: str | Column) -> Column:
    """The source clause as a list; empty without one."""
    c = F.col(clause) if isinstance(clause, str) else clause
    return F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def phrases(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, ord, phrase``: distinct title-case phrases in order."""
    return docs.select(doc, F.posexplode(title_phrases(F.coalesce(F.col(text), F.lit("")))).alias("ord", "phrase"))
