"""Sinks of results: JSON, merged updates, and text of reports in order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EXPORTED


def write_json(results: DataFrame, path: str, pretty: bool = False, by_document: bool = False) -> None:
    """Writes ``results(doc_id, json)`` as text: one JSON object for each document.

    By default a line each; ``pretty`` spreads an object over lines, so then each document should have
    files of its own: ``by_document`` writes below ``path/doc_id=...``.
    """
    text = F.to_json(F.parse_json("json"), {"pretty": "true"}) if pretty else F.col("json")
    rows = results.select("doc_id", text.alias("value"))
    if by_document:
        rows.write.partitionBy("doc_id").text(path)
    else:
        rows.select("value").write.text(path)


def opened(results: DataFrame) -> DataFrame:
    """``results(doc_id, json)`` with the typed columns of exported results instead of the text; lists that are missing are empty."""
    kind = f"struct<{','.join(f.replace(' ', ':', 1) for f in EXPORTED.split(', '))}>"
    rows = results.withColumn("_r", F.from_json("json", kind)).select("doc_id", "_r.*")
    return rows.withColumns({n: F.coalesce(n, F.array().cast(t)) for n, t in rows.dtypes if t.startswith("array")})


def merged_key(results: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``results(doc_id, json)`` with the value of ``key`` from ``new(doc_id, json)``, also JSON, where it has the document.

    All other keys stay as they are, in their order; a missing key is added. The objects stay whole
    in their rows: a join by document, and one pass.
    """
    kinds = dict(results.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [old if value is None else json.dumps({**json.loads(old or "{}"), key: json.loads(value)}, ensure_ascii=False) for old, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "json"])

    both = results.select("doc_id", "json").join(new.select("doc_id", F.col("json").alias("_new")), "doc_id", "left")
    return both.mapInArrow(run, f"doc_id {kinds['doc_id']}, json string")


def merge_key(results: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """Writes ``merged_key`` to a new path; the path that is read stays as it is."""
    merged_key(results, new, key).write.parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Writes a table of scores with what was missed as JSON lines, in one file: it has a row for each document of a gold set."""
    scores.coalesce(1).write.json(path, ignoreNullFields=False)


def write_comparison(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the tables of a comparison as JSON lines, each in a folder of its name."""
    for name, rows in tables.items():
        rows.write.json(f"{path}/{name}", ignoreNullFields=False)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """Writes ``part, doc_id, ord, html`` as text in order: the files of the folder, joined by name, are the page."""
    pieces.orderBy("part", "doc_id", "ord").select("html").write.text(path)
