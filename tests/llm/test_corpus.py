"""Token store, shards, classifier, line rules and pipeline stages on small fixtures."""

import re
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from paperloom.llm import quality, sharding, tokenstore, toxicity
from paperloom.llm.queries import tokenizer
from paperloom.plans.stage import fresh_path

LONG = " ".join(f"word{i % 977} it's, Café" for i in range(3000))
TEXTS = [None, "", " \n\t", LONG, LONG, LONG + " x", "one two", "a b c d e f g h i j k l " * 4, "x\n" * 50, "ünï 😀"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "host" if i % 2 else None, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)


def test_store_gives_back_every_id(spark, docs):
    path = fresh_path(spark, "store-test")
    tokenstore.write_store(docs, path, tokenizer("word_bpe_49k.json"))
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    digests = {r.doc_id: r for r in tokenstore.read_digests(spark, path).collect()}
    whole = {r.doc_id: r for r in tokenstore.read_ids(spark, path).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert (digests[i].start, digests[i].n_tokens, digests[i].ids_crc32) == (start, len(ids), crc)
        assert (whole[i].start, whole[i].ids) == (start, ids)
        start += len(ids)
    chunks = spark.read.parquet(f"{path}/content/is_chunk=true")
    assert chunks.count() == chunks.select("name").distinct().count()


def test_a_changed_chunk_is_noticed(spark, docs):
    path = fresh_path(spark, "broken-test")
    tokenstore.write_store(docs, path, tokenizer("word_bpe_49k.json"))
    chunks = spark.read.parquet(f"{path}/content/is_chunk=true").withColumn("body", F.concat("body", F.lit(bytearray(2)))).cache()
    chunks.count()
    chunks.write.mode("overwrite").parquet(f"{path}/other")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{path}/content/is_chunk=true")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(at, True)
    files.rename(hadoop.Path(f"{path}/other"), at)
    with pytest.raises(Exception, match="hash"):
        tokenstore.read_digests(spark, path).collect()


def test_shards_are_near_equal_and_gapless(spark):
    rows = [(i, "same text" * 9 if i % 3 == 0 else f"text {i} " * (i % 50), "s") for i in range(3000)]
    docs = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, shard string")
    got = sharding.shard_rows(docs, shards=6).collect()
    texts = {i: t for i, t, _ in rows} | {None: None}
    assert sorted((r.doc_id is not None, r.doc_id) for r in got) == sorted((i is not None, i) for i in texts)
    slots: dict[int, list[int]] = {}
    sizes = dict.fromkeys(range(6), 0)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 6
    assert all(abs(s - mean) <= 2 * sharding.TOLERANCE * mean + 500 for s in sizes.values())


def test_shards_of_an_empty_table(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def toxic_tables(spark):
    rows = [(i, f"{'you utter moron' if i % 4 == 0 else 'thank you kindly'} number {i} of the list", "s") for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None, "s"), (1000, "", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_learns_from_rows_not_held_out(spark):
    docs, labels = toxic_tables(spark)
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == 402
    for i in range(400):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1
        assert got[i].predicted == int(got[i].score >= 0.5) == int(i % 4 == 0)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.scored(docs, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark)
    assert toxicity.scored(docs, labels.limit(0)).where("score = 0.5").count() == 402
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_ngrams_of_long_texts_are_whole(monkeypatch):
    whole = [x for p in toxicity.ngram_buckets(LONG) for x in p.tolist()]
    monkeypatch.setattr(toxicity, "STRETCH", 1000)
    assert sorted(whole) == sorted(x for p in toxicity.ngram_buckets(LONG) for x in p.tolist())


def line_docs():
    """Boilerplate on most pages of one host; some pages are little else."""
    rows = []
    for i in range(60):
        own = "\n".join(f"document {i} has sentence {k} about thing {i * k}" for k in range(2 if i % 5 == 0 else 9))
        menu = "\n".join(f"Menu  entry {k} leads to the other pages" for k in range(6))
        rows.append((i, f"{menu}\n{own}" if i % 2 == 0 else own + "\nand a last line", "a" if i < 50 else None))
    return [*rows, (60, None, "a"), (61, "", None), (62, rows[0][1], "a")]


def test_depleted_documents_by_brute_force(spark):
    rows = line_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines: dict[tuple, set[str]] = {}
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            words = line.lower().split()
            if words:
                lines.setdefault((host or "", " ".join(words)), set()).add(text)
    frequent = {k for k, v in lines.items() if len(v) > quality.LINE_DOCS}
    assert frequent
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    for i, text, host in rows:
        lost = sum(len(x.split()) for x in (text or "").split("\n") if (host or "", " ".join(x.lower().split())) in frequent)
        assert got[i].lost_words == lost
        assert got[i].kept == (not got[i].base_failed and lost <= quality.LOST_SHARE * got[i].n_words)
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}
    assert 0 < sum(not r.kept and not r.base_failed for r in got.values())


def test_pipeline_stages(spark, tmp_path):
    docs, labels = toxic_tables(spark)
    lines = spark.createDataFrame(line_docs(), "doc_id long, text string, source string").withColumn("doc_id", F.col("doc_id") + 5000)
    docs = docs.select("doc_id", "text", F.col("score").alias("source")).unionByName(lines)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns
        assert out.count() <= before
        assert out.exceptAll(rows).count() == 0
        rows, before = out, out.count()
    assert rows.where("text LIKE '%moron%'").count() == 0
    assert rows.where("doc_id in (5000, 5062)").count() <= 1
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in rows.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert re.fullmatch(r"toxicity quality_rules simhash_near_dedup best_fit_packing", " ".join(names))
