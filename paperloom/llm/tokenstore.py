"""A content-addressed store of token ids.

``write_store`` cuts each document's ids into chunks where a rolling hash of the last sixteen ids
hits a pattern, so equal passages give equal chunks wherever they stand. A chunk is stored once,
under the SHA-256 of its bytes. A document's recipe lists its chunks; its Merkle root is the root
of their hashes, and each recipe file has a manifest with the root of its documents' roots.
Reading verifies every chunk against its name, every recipe against its root, and every file
against its manifest.

Layout under the store's path::

    content/is_chunk=true/   name binary, body binary (ids, little-endian, 2 or 4 bytes each)
    recipes/                 part int, doc_id, start, n_tokens, root, hashes (32 bytes each), sizes (4 each)
                             in ascending doc_id over the parts and within each
    manifest/                part, documents, tokens, first_start, root

One exchange carries each chunk at most once per task that met it; recipes and duplicates stay
small. Nothing is gathered by document: ids come back by chunk, and the digest of a document is
put together from its chunks' digests (CRCs shift and add over GF(2)).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import fresh_path, remove, remove_at_exit
from .wordids import END_ID, encoded

WINDOW = 16
#: A cut where this many high bits of the rolling hash are zero: 512 ids on average.
CUT_BITS = 9
LEAST, MOST = 64, 4096
#: Hashes of chunks that a task remembers having sent.
SEEN = 200_000


def gear_table(size: int, seed: int = 7) -> np.ndarray:
    """A 16-bit number for each id, by a mixing rule."""
    x = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.uint16)


def rolling_hashes(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """At each place the sum of ``gear[id] << age`` (mod 2**16) over the last ``WINDOW`` ids."""
    h = gear[ids]
    span = 1
    while span < WINDOW:
        older = np.zeros_like(h)
        older[span:] = h[:-span]
        h = h + (older << np.uint16(span))
        span *= 2
    return h


def cut_points(hits: np.ndarray, start: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of ids ``start:end``; ``hits`` are the places after which to cut, ascending."""
    out, at = [], start
    own = hits[np.searchsorted(hits, start) : np.searchsorted(hits, end - 1)].tolist()
    for hit in own:
        while hit + 1 - at > most:
            at += most
            out.append(at)
        if hit + 1 - at >= least:
            at = hit + 1
            out.append(at)
    while end - at > most:
        at += most
        out.append(at)
    if end > at:
        out.append(end)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 over pairs, level by level; an odd one moves up. No leaves: the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


SENT = "is_chunk boolean, doc_id long, n_tokens long, name binary, hashes binary, sizes binary, body binary"


def _chunker(tokenizer_path: str, vocabulary: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table(max(vocabulary, end_id + 1))
        kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
        seen: dict[bytes, None] = {}
        schema = pa.schema([("is_chunk", pa.bool_()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("name", pa.binary()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])
        for batch, flat, ends in encoded(batches, tokenizer_path):
            n = len(ends) - 1
            ids = np.insert(flat, ends[1:], end_id) if n else flat
            ends = ends + np.arange(n + 1)
            hits = np.flatnonzero(rolling_hashes(ids, gear) >> np.uint16(16 - CUT_BITS) == 0)
            raw, width = memoryview(ids.astype(kind).tobytes()), int(kind[-1])
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                names, sizes, at = [], [], a
                for cut in cut_points(hits, a, b):
                    body = raw[width * at : width * cut]
                    name = hashlib.sha256(body).digest()
                    names.append(name)
                    sizes.append(cut - at)
                    if name not in seen:
                        seen[name] = None
                        rows.append((True, None, cut - at, name, None, None, bytes(body)))
                    at = cut
                rows.append((False, doc, b - a, merkle_root(names), b"".join(names), np.array(sizes, "<u4").tobytes(), None))
            while len(seen) > SEEN:
                seen.pop(next(iter(seen)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name, chunks once; documents all."""
    last = None
    for batch in batches:
        chunk = batch.column(batch.schema.get_field_index("is_chunk")).to_pylist()
        names = batch.column(batch.schema.get_field_index("name")).to_pylist()
        keep = []
        for is_chunk, name in zip(chunk, names, strict=True):
            keep.append(not is_chunk or name != last)
            if is_chunk:
                last = name
        yield batch.filter(pa.array(keep))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int = 1 << 16, end_id: int = END_ID) -> None:
    """Encodes ``docs(doc_id, text)`` and writes the store at ``path``.

    Null text is empty (its ids are the end id alone); a null ``doc_id`` sorts first; repeated rows
    each get a recipe, in the order of their roots. Other columns are ignored. An empty table gives
    a store without recipes.
    """
    spark = docs.sparkSession
    sent = docs.select("doc_id", "text").mapInArrow(_chunker(tokenizer_path, vocabulary, end_id), SENT)
    # Chunks meet by name; recipes are dealt by their own document.
    dealt = sent.repartition(F.when(F.col("is_chunk"), F.xxhash64("name")).otherwise(F.xxhash64("doc_id", "name")))
    raw = f"{path}/content"
    dealt.sortWithinPartitions("is_chunk", "name").mapInArrow(_first_of_each, SENT).write.option("compression", "zstd").partitionBy("is_chunk").parquet(raw)
    stored = spark.read.schema(T._parse_datatype_string(SENT)).parquet(raw)
    recipes = stored.where(~F.col("is_chunk")).select("doc_id", "n_tokens", F.col("name").alias("root"), "hashes", "sizes")
    in_order = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    in_order.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/ordered")
    ordered = spark.read.schema("doc_id long, n_tokens long, root binary, hashes binary, sizes binary, part int").parquet(f"{path}/ordered")
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    # One row per recipe file: its number and its count of ids.
    first = parts.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_start"))
    before = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("within", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(first, "part")
    placed = placed.select("part", "doc_id", (F.col("first_start") + F.col("within")).alias("start"), "n_tokens", "root", "hashes", "sizes")
    placed.sortWithinPartitions("part", "start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifests(spark, path).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(2 if vocabulary <= 1 << 16 else 4, vocabulary)], "width int, vocabulary long").coalesce(1).write.parquet(f"{path}/format")
    remove(spark, f"{path}/ordered")
    remove(spark, f"{raw}/is_chunk=false")


def _manifest(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["start"].to_pylist(), table["root"].to_pylist(), table["n_tokens"].to_pylist(), strict=True))
    return pa.table(
        {
            "part": pa.array([table["part"][0].as_py()], pa.int32()),
            "documents": pa.array([len(rows)], pa.int64()),
            "tokens": pa.array([sum(r[2] for r in rows)], pa.int64()),
            "first_start": pa.array([rows[0][0]], pa.int64()),
            "root": pa.array([merkle_root([r[1] for r in rows])], pa.binary()),
        }
    )


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """What the recipe files hold; of a recipe only its place, its length and its root are read."""
    return spark.read.schema("part int, start long, n_tokens long, root binary").parquet(f"{path}/recipes").groupBy("part").applyInArrow(_manifest, MANIFEST)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """``name, body`` of the stored chunks; none in the store of an empty table."""
    return spark.read.schema("name binary, body binary, is_chunk boolean").parquet(f"{path}/content").where("is_chunk").select("name", "body")


RECIPES = "part int, doc_id long, start long, n_tokens long, root binary, hashes binary, sizes binary"
MANIFEST = "part int, documents long, tokens long, first_start long, root binary"


class BrokenStore(RuntimeError):
    """What was read doesn't agree with its hashes."""


def _shift_tables() -> list[np.ndarray]:
    """For each k, four tables of 256 that move a CRC-32 over 2**k zero bytes."""
    rows = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # over one zero bit

    def moved(m: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for i in range(32):
            out ^= np.where(values >> np.uint32(i) & np.uint32(1), m[i], np.uint32(0)).astype(np.uint32)
        return out

    for _ in range(3):
        rows = moved(rows, rows)
    tables = []
    for _ in range(44):
        tables.append(np.stack([moved(rows, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)]))
        rows = moved(rows, rows)
    return tables


def shifted_crc(crc: np.ndarray, zeros: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """CRC-32 values moved over ``zeros`` further bytes: ``crc(a + b) == shifted(crc(a), len(b)) ^ crc(b)``."""
    out = crc.astype(np.uint32)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        own = zeros >> k & 1 == 1
        x = out[own]
        out[own] = tables[k][0][x & 255] ^ tables[k][1][x >> 8 & 255] ^ tables[k][2][x >> 16 & 255] ^ tables[k][3][x >> 24]
    return out


def _width(spark: SparkSession, path: str) -> int:
    return int(spark.read.parquet(f"{path}/format").first()["width"])


def chunk_digests(spark: SparkSession, path: str) -> DataFrame:
    """``name, n, crc`` of every stored chunk; the CRC is that of its ids in 4 bytes each."""
    width = _width(spark, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, crcs = [], [], []
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                raw, name = body.as_buffer(), name.as_py()
                if hashlib.sha256(raw).digest() != name:
                    raise BrokenStore(f"a chunk's bytes don't have the hash {name.hex()}")
                ids = np.frombuffer(raw, f"<u{width}")
                names.append(name)
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["name", "n", "crc"])

    return _chunks(spark, path).mapInArrow(digest, "name binary, n long, crc long")


ENTRIES = "doc_id long, start long, n_tokens long, seq int, name binary, size long, after long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each recipe, once its root agrees; ``after``: ids that follow the chunk."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = []
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "start", "n_tokens", "root", "hashes", "sizes")]
        for doc, start, n, root, hashes, sizes in zip(*cols, strict=True):
            names = [hashes[i : i + 32] for i in range(0, len(hashes), 32)]
            if merkle_root(names) != root:
                raise BrokenStore(f"the recipe of document {doc} doesn't have its root")
            left = n
            for seq, (name, size) in enumerate(zip(names, np.frombuffer(sizes, "<u4").tolist(), strict=True)):
                left -= size
                rows.append((doc, start, n, seq, name, size, left))
            if left:
                raise BrokenStore(f"the recipe of document {doc} has {n - left} ids, not {n}")
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "n_tokens", "seq", "name", "size", "after"])


def recipe_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row for each chunk of each document, after the manifests of the recipe files were verified."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    there = _manifests(spark, path)
    written = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    if wrong := there.exceptAll(written).union(written.exceptAll(there)).select("part").head(5):
        raise BrokenStore(f"recipe files that don't agree with their manifests: {sorted({r.part for r in wrong})}")
    return recipes.mapInArrow(_entries, ENTRIES)


def _with_content(entries: DataFrame, content: DataFrame) -> DataFrame:
    """Entries with what the store has under their names; a missing chunk is an error."""
    joined = entries.join(content, "name", "left")
    return joined.withColumn("n", F.when(F.col("n") == F.col("size"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("missing or wrong chunk "), F.hex("name")))))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shift_tables()
        for batch in batches:
            crc, after = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("crc", "after"))
            i = batch.schema.get_field_index("crc")
            yield batch.set_column(i, "crc", pa.array(shifted_crc(crc, 4 * after, tables).astype(np.int64)))

    found = _with_content(recipe_entries(spark, path), chunk_digests(spark, path)).select("doc_id", "start", "n_tokens", "n", "crc", "after")
    moved = found.mapInArrow(move, "doc_id long, start long, n_tokens long, n long, crc long, after long")
    return moved.groupBy("start", "doc_id").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids array<long>`` of every document, put together from its chunks."""
    width = _width(spark, path)

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bodies = [b for _, b in sorted(zip(table["seq"].to_pylist(), table["body"].to_pylist(), strict=True))]
        ids = np.frombuffer(b"".join(bodies), f"<u{width}").astype(np.int64)
        return pa.table({"doc_id": pa.array([key[1].as_py()], pa.int64()), "start": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64()))})

    content = _chunks(spark, path).withColumn("n", F.expr(f"octet_length(body) div {width}"))
    found = _with_content(recipe_entries(spark, path), content)
    return found.groupBy("start", "doc_id").applyInArrow(join, "doc_id long, start long, ids array<long>")


def stored_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes ``docs`` to a new store in the shared folder and returns its digests."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-store")
    write_store(docs, path, tokenizer_path)
    remove_at_exit(spark, path)
    return read_digests(spark, path)
