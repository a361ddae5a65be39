"""Text to blocks to chunks: offsets, carried labels, merged tables and short blocks.

All windows are partitioned by document, so their memory is that of one document's blocks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def blocks_from_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, block_idx, text``: the non-blank lines; null and blank texts have none."""
    lines = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    lines = lines.withColumn("text", F.expr(r"btrim(text, ' \t\r')")).where("text <> ''")
    own = Window.partitionBy("doc_id").orderBy("line")
    return lines.select("doc_id", (F.row_number().over(own) - 1).alias("block_idx"), "text")


def with_offsets(blocks: DataFrame) -> DataFrame:
    """``start_char`` and ``end_char``: blocks stand one newline apart."""
    own = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(*BEFORE)
    start = F.coalesce(F.sum(F.length("text") + 1).over(own), F.lit(0)).cast("long")
    return blocks.withColumn("start_char", start).withColumn("end_char", F.col("start_char") + F.length("text"))


def label_of(text: str = "text", kind: str | None = None):
    """The label that a block sets: its text for headings, a section number, an article header."""
    found = F.coalesce(F.nullif(F.regexp_extract(text, P.SECTION_LABEL, 1), F.lit("")), F.nullif(F.regexp_extract(text, P.ARTICLE_LABEL, 1), F.lit("")))
    return F.when(F.col(kind) == "heading", F.col(text)).otherwise(found) if kind else found


def carry_label(blocks: DataFrame, event, order: str = "block_idx") -> DataFrame:
    """``section_label``: the last label set at or before a block."""
    own = Window.partitionBy("doc_id").orderBy(order).rowsBetween(*SO_FAR)
    return blocks.withColumn("section_label", F.last(event, ignorenulls=True).over(own))


def merge_tables(elements: DataFrame, is_table, label: str | None = None) -> DataFrame:
    """``doc_id, island, text``: each table's text joins the block before it; leading tables form one block.

    With ``label`` also that column, of the block that the tables join.
    """
    own = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(*SO_FAR)
    marked = elements.withColumn("island", F.sum((~is_table).cast("int")).over(own))
    parts = marked.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "text", *([label] if label else [])))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text")
    return parts.select("doc_id", "island", text, *([F.col("parts")[0][label].alias(label)] if label else []))


def chunk_blocks(blocks: DataFrame, least: int = P.SHORT_BLOCK) -> DataFrame:
    """Blocks below ``least`` characters join those after them until the sum reaches it.

    ``doc_id, chunk_idx, text, start_block, end_block``; a last short chunk stays. Where ``blocks``
    have them, also ``page`` and ``section_label``, the first of the joined blocks that isn't null,
    and ``start_char`` and ``end_char``. A document's blocks are folded in one task, in linear time.
    """
    kinds = dict(blocks.dtypes)
    firsts = [c for c in ("page", "section_label") if c in kinds]
    offsets = [c for c in ("start_char", "end_char") if c in kinds]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_idx")
        texts, idx = table["text"].to_pylist(), table["block_idx"].to_pylist()
        ranges, a, n = [], 0, -1
        for z, text in enumerate(texts):
            n += 1 + len(text)
            if n >= least:
                ranges.append((a, z))
                a, n = z + 1, -1
        if a < len(texts):
            ranges.append((a, len(texts) - 1))
        out = {
            "doc_id": pa.array([table["doc_id"][0].as_py()] * len(ranges), table.schema.field("doc_id").type),
            "chunk_idx": pa.array(range(len(ranges)), pa.int32()),
            "text": pa.array(["\n".join(texts[a : z + 1]) for a, z in ranges], pa.string()),
            "start_block": pa.array([idx[a] for a, _ in ranges], pa.int32()),
            "end_block": pa.array([idx[z] for _, z in ranges], pa.int32()),
        }
        for c in firsts:
            values = table[c].to_pylist()
            out[c] = pa.array([next((v for v in values[a : z + 1] if v is not None), None) for a, z in ranges], table.schema.field(c).type)
        if offsets:
            start, end = (table[c].to_pylist() for c in offsets)
            out["start_char"] = pa.array([start[a] for a, _ in ranges], pa.int64())
            out["end_char"] = pa.array([end[z] for _, z in ranges], pa.int64())
        return pa.table(out)

    schema = f"doc_id {kinds['doc_id']}, chunk_idx int, text string, start_block int, end_block int"
    schema += "".join(f", {c} {kinds[c]}" for c in firsts) + "".join(f", {c} long" for c in offsets)
    own = blocks.select("doc_id", F.col("block_idx").cast("int").alias("block_idx"), "text", *firsts, *[F.col(c).cast("long").alias(c) for c in offsets])
    return own.groupBy("doc_id").applyInArrow(fold, schema)


def full_texts(blocks: DataFrame) -> DataFrame:
    """``doc_id, full_text``: the blocks of each document in order, one newline apart."""
    held = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "text"))).alias("b"))
    return held.select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("full_text"))


def within_budget(chunks: DataFrame, order: str, budget: int = P.PREAMBLE_CHARS) -> DataFrame:
    """The leading chunks of each document while the characters before a chunk are below the budget."""
    own = Window.partitionBy("doc_id").orderBy(order).rowsBetween(*BEFORE)
    return chunks.withColumn("before", F.coalesce(F.sum(F.length("text")).over(own), F.lit(0)).cast("long")).where(F.col("before") < budget)
