"""Scans of contract files and of HTML columns into elements."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import layout
from . import pdf

HEADINGS = frozenset({"h1", "h2", "h3", "h4"})
TEXTUAL = HEADINGS | {"p", "li"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset({"script", "style"})
INLINE = frozenset("a abbr b big cite code em font i q s small span strike strong sub sup tt u".split())
WHOLE_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
#: Open elements that a start tag ends.
ENDED_BY = {"p": {"p"}, "li": {"p", "li"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}} | {t: {"p"} for t in ("div", "table", "h1", "h2", "h3", "h4", "ul", "ol")}


class _Node:
    """An element; what its ancestors and descendants are is noted while the tree grows."""

    __slots__ = ("divided", "in_table", "in_text", "parts", "tag", "up")

    def __init__(self, tag: str, up: _Node | None):
        self.tag, self.up, self.parts = tag, up, []
        self.in_table = up is not None and (up.in_table or up.tag == "table")
        self.in_text = up is not None and (up.in_text or up.tag in TEXTUAL)
        #: Whether a div or a heading, paragraph or item is inside.
        self.divided = False


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", None)
        self.open: dict[str, int] = {}

    def _end(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.up

    def _make_room(self, ended: set[str]) -> None:
        """Ends open elements of the names, and inline ones inside them, up to any other element."""
        while any(map(self.open.get, ended)):
            at = self.at
            while at.tag in INLINE:
                at = at.up
            if at.tag not in ended:
                return
            while self.at is not at:
                self._end()
            self._end()

    def handle_starttag(self, tag, attrs):
        if tag in ENDED_BY:
            self._make_room(ENDED_BY[tag])
        node = _Node(tag, self.at)
        self.at.parts.append(node)
        if tag == "div" or tag in TEXTUAL:
            up = self.at
            while up is not None and not up.divided:
                up.divided = True
                up = up.up
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.open.get(tag):
            while self.at.tag != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        if self.at.tag not in SILENT:
            self.at.parts.append(data)


def _walk(node: _Node) -> Iterator[_Node | str]:
    stack: list = list(reversed(node.parts))
    while stack:
        x = stack.pop()
        yield x
        if isinstance(x, _Node):
            stack.extend(reversed(x.parts))


def _text(node: _Node) -> str:
    return " ".join(s for s in (x.strip() for x in _walk(node) if isinstance(x, str)) if s)


def _rows(table: _Node) -> str:
    lines = []
    for row in (x for x in _walk(table) if isinstance(x, _Node) and x.tag == "tr"):
        cells = [_text(c) for c in _walk(row) if isinstance(c, _Node) and c.tag in ("td", "th")]
        if any(cells):
            lines.append(" | ".join(c for c in cells if c))
    return "\n".join(lines)


def elements(source: str | bytes | None, lenient: bool = True) -> list[tuple[str, str]]:
    """``(kind, text)`` in document order: headings, paragraphs and items outside tables, leaf divs
    without any of those, and outermost tables. Character references are decoded before parsing.

    ``lenient``, as browsers have it: what lacks its semicolon (``&amp``) is a reference too, and what
    decoding yields is decoded again. Otherwise only whole references are decoded, once.
    """
    if source is None:
        return []
    text = source.decode("utf-8", "replace") if isinstance(source, bytes) else source
    tree = _Tree()
    # The parser decodes what it is fed, so an ampersand that stays is fed as a reference.
    tree.feed(html.unescape(text) if lenient else WHOLE_REFERENCE.sub(lambda m: html.unescape(m[0]), text).replace("&", "&amp;"))
    tree.close()
    out = []
    for x in _walk(tree.root):
        if not isinstance(x, _Node) or x.in_table:
            continue
        kind, text = "", ""
        if x.tag in TEXTUAL:
            kind, text = "heading" if x.tag in HEADINGS else "text", _text(x)
        elif x.tag == "table":
            kind, text = "table", _rows(x)
        elif x.tag == "div" and not x.in_text and not x.divided:
            kind, text = "text", _text(x)
        if text:
            out.append((kind, text))
    return out


def html_elements(pages: DataFrame, key: str, source: str, lenient: bool = True) -> DataFrame:
    """``doc_id, pos, kind, text`` of each row's HTML (string or binary), see ``elements``; null HTML has none."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [elements(x, lenient) for x in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(found)), list(map(len, found)))
            flat = [e for own in found for e in own]
            pos = [i for own in found for i in range(len(own))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(pos, pa.int32()), pa.array([e[0] for e in flat], pa.string()), pa.array([e[1] for e in flat], pa.string())],
                ["doc_id", "pos", "kind", "text"],
            )

    return pages.select(key, source).mapInArrow(run, f"doc_id {kind}, pos int, kind string, text string")


def html_blocks(pages: DataFrame, key: str = "doc_id", source: str = "content", lenient: bool = True, numbered: bool = True) -> DataFrame:
    """Blocks of HTML documents: labels carried from headings and section numbers, tables joined to the block before them, offsets.

    Not ``numbered``: only headings set labels. Pages aren't contracts: there an address (28.68.191.238) isn't a section.
    """
    found = html_elements(pages, key, source, lenient)
    event = F.when(F.col("kind") != "table", layout.label_of("text", "kind")) if numbered else F.when(F.col("kind") == "heading", F.col("text"))
    labelled = layout.carry_label(found, event, "pos")
    merged = layout.merge_tables(labelled, F.col("kind") == "table", "section_label")
    own = Window.partitionBy("doc_id").orderBy("island")
    blocks = merged.select("doc_id", (F.row_number().over(own) - 1).alias("block_idx"), "text", F.lit(None).cast("int").alias("page"), "section_label")
    return layout.with_offsets(blocks)


def pdf_blocks(files: DataFrame, key: str = "doc_id", source: str = "content") -> DataFrame:
    """Blocks of PDF documents: one for each page with text, under its own number from 1; no labels; offsets over pages with text."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, t) for i, x in enumerate(batch.column(1).to_pylist()) for n, t in enumerate(map(str.strip, pdf.page_texts(x) if x else []), 1) if t]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "page", "text"],
            )

    pages = files.select(key, source).mapInArrow(run, f"doc_id {kind}, page int, text string")
    own = Window.partitionBy("doc_id").orderBy("page")
    blocks = pages.select("doc_id", (F.row_number().over(own) - 1).alias("block_idx"), "text", "page", F.lit(None).cast("string").alias("section_label"))
    return layout.with_offsets(blocks)


#: What reads the files of a suffix: rows ``doc_id, content`` to blocks. More may be added.
LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {".pdf": pdf_blocks, ".html": html_blocks, ".htm": html_blocks}


def with_suffix(files: DataFrame, known: Iterable[str]) -> DataFrame:
    """``doc_id, suffix, content`` of rows of the ``binaryFile`` source, a file's own name as its id; an unknown suffix fails when it is read."""
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    checked = F.when(suffix.isin(*known), suffix).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), suffix)))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), checked.alias("suffix"), "content")


def contract_files(spark: SparkSession, path: str, known: Iterable[str] | None = None) -> DataFrame:
    """``with_suffix`` of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_suffix(files, LOADERS if known is None else known)


def blocks_of_files(files: DataFrame, loaders: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Blocks of ``files(doc_id, suffix, content)``, each by the loader of its suffix.

    Each loader scans the files once; contents of other suffixes are filtered out before it.
    """
    by_loader: dict[Callable[[DataFrame], DataFrame], list[str]] = {}
    for suffix, load in (LOADERS if loaders is None else loaders).items():
        by_loader.setdefault(load, []).append(suffix)
    # The suffix is read by every branch, so that an unknown one is noticed in each.
    return reduce(DataFrame.unionByName, [load(files.where(F.col("suffix").isin(*own)).select("doc_id", "content")) for load, own in by_loader.items()])


def load_documents(spark: SparkSession, path: str, loaders: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Blocks of all files below a path; a file whose suffix has no loader is an error."""
    return blocks_of_files(contract_files(spark, path, loaders), loaders)


def json_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files with ``file_name``, in its order; missing lists become empty."""
    read = spark.read.option("multiLine", True).schema(schema).json(path)
    lists = {n: F.coalesce(F.col(n), F.array().cast(t)) for n, t in read.dtypes if t.startswith("array")}
    return read.withColumns({**lists, "file_name": F.col("_metadata.file_name")}).orderBy("file_name")
