"""Empty tables, repeated rows, null ids, clashing names, hot keys and exact ids of the operators."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from paperloom.llm import bpe, nearcopies, packing, quality, sharding, simhash, tokenstore, toxicity, wordids
from paperloom.llm.queries import tokenizer
from paperloom.plans import skew
from paperloom.plans.stage import fresh_path

DOCS = "doc_id long, text string, source string, `n words` int"
#: Names that the operators use inside.
CLASHING = "n_words lost _key _id _text _nth score predicted salt row spared gone host text_key stays k d part shard rank_in_group".split()


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], DOCS).repartition(2)


def library(name):
    made = Tokenizer.from_file(tokenizer(name))
    made.no_truncation()
    made.no_padding()
    return made


def word_id_lists(texts):
    return [[*e.ids, 1] for e in library("word_bpe_49k.json").encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_every_letter_before_a_mark_equals_the_library():
    """All code points alone, after letters, and before the marks that are cut from words."""
    points = map(chr, itertools.chain(range(1, 0xD800), range(0xE000, 0x11000), range(0x1E900, 0x1E960)))
    encoder, plain = wordids.WordIds(tokenizer("word_bpe_49k.json")), library("word_bpe_49k.json")
    for some in iter(lambda: list(itertools.islice(points, 8000)), []):
        texts = [before + c + mark for c in some for before in ("", "ab", "é") for mark in (".", ",", ". next")]
        flat, ends = encoder.encode(pa.array(texts))
        for i, e in enumerate(plain.encode_batch_fast(texts, add_special_tokens=False)):
            assert flat[ends[i] : ends[i + 1]].tolist() == e.ids, texts[i]


AWKWARD = ["the end", "İ. and İ, then", "xİ.", None, "a plain one.", "", "İstanbul. Şehir, ŉ. ǰ, ß."]


def test_store_after_awkward_words(spark):
    got = sorted(tokenstore.stored_documents(table(spark, enumerate(AWKWARD)), tokenizer("word_bpe_49k.json")).collect())
    start = 0
    for r, ids in zip(got, word_id_lists(AWKWARD), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_packing_of_awkward_words(spark):
    got = sorted(packing.packed_documents(table(spark, enumerate(AWKWARD)), tokenizer("word_bpe_49k.json")).collect())
    assert [(r.length, r.ids_crc32) for r in got] == [(len(ids), crc(ids)) for ids in word_id_lists(AWKWARD)]


def test_empty_tables(spark):
    docs = table(spark, [(1, "x")]).limit(0)
    path = tokenizer("word_bpe_49k.json")
    assert tokenstore.stored_documents(docs, path).count() == 0
    store = fresh_path(spark, "empty-store")
    tokenstore.write_store(docs, store, path)
    assert tokenstore.read_ids(spark, store).count() == 0
    assert packing.packed_documents(docs, path).count() == 0
    assert bpe.round_trip(docs, tokenizer("byte_bpe_50k.json")).count() == 0
    assert simhash.near_groups(docs).count() == 0
    assert simhash.keep_first(docs).count() == 0
    assert nearcopies.keep_first(docs).count() == 0
    assert quality.verdicts(docs).count() == 0
    assert quality.keep_good(docs).count() == 0
    assert quality.clean_texts(docs).count() == 0
    sharding.write_shards(docs, store + "-shards")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, labels).count() == 0


REPEATED = [(5, "one text of some words"), (5, "one text of some words"), (5, "another"), (None, "one text of some words"), (None, None), (7, "")]


def test_repeated_rows_and_null_ids_in_the_store(spark):
    got = tokenstore.stored_documents(table(spark, REPEATED), tokenizer("word_bpe_49k.json")).collect()
    lists = word_id_lists([t for _, t in REPEATED])
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or 0, len(x), crc(x)) for (i, _), x in zip(REPEATED, lists, strict=True))
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows[:-1])]
    assert [r.doc_id for r in rows] == [None, None, 5, 5, 5, 7]


def test_repeated_rows_and_null_ids_in_packing(spark):
    got = packing.packed_documents(table(spark, REPEATED), tokenizer("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == sorted((i or 0, len(x)) for (i, _), x in zip(REPEATED, word_id_lists([t for _, t in REPEATED]), strict=True))
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_byte_bpe_rows_and_both_ways(spark):
    path, plain = tokenizer("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    rows = [*REPEATED, (8, "x" * 4000), (9, "<|endoftext|> it's  \n\n 漢字 😀 <|endoftext|>")]
    docs = table(spark, rows)
    expected = sorted((i or 0, hashlib.sha256(",".join(map(str, plain.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id or 0, r.ids_sha256) for r in bpe.round_trip(docs, path).collect()) == expected
    encoded = bpe.encode_documents(docs, path)
    assert sorted((r.doc_id or 0, r.ids) for r in encoded.collect()) == sorted((i or 0, plain.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode_documents(encoded, path).collect()) == sorted((i or 0, t or "") for i, t in rows)


def naive_best_fit(lengths, capacity):
    """Sequences that best-fit decreasing opens, piece by piece."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_as_few_sequences_as_piece_by_piece(seed):
    draw = random.Random(seed)
    capacity = draw.choice([16, 100, 257])
    lengths = draw.choices(range(1, capacity + 1), k=draw.randrange(1, 300))
    if seed % 3 == 0:
        lengths += [draw.randrange(1, capacity + 1)] * 200  # one length holds most pieces
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_plan(histogram, capacity)
    assert max(first + n for _, _, n, first, _ in plan) == naive_best_fit(lengths, capacity)


def test_places_with_many_groups_of_a_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_GROUP", 7)
    lengths = [10] * 300 + [4] * 100 + [16, 3, 3, 1]
    pieces = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, salt string")
    got = packing.pack(pieces, 16, group=20).collect()
    assert [f for f in got[0].__fields__] == ["doc_id", "piece", "length", "salt", "sequence_id", "offset"]
    bins: dict[int, list[tuple[int, int]]] = {}
    for r in got:
        assert r.length == lengths[r.doc_id] and r.salt == "x"
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, bins.values())) == len(lengths)
    assert len(bins) == naive_best_fit(lengths, 16)
    for placed in bins.values():
        assert [o for o, _ in sorted(placed)] == [0, *itertools.accumulate(n for _, n in sorted(placed)[:-1])]


def crowded_rows():
    """Fingerprints in one entry of the index, chains of near ones, and texts of one fingerprint."""
    draw = random.Random(4)
    base = draw.getrandbits(64)
    prints = {base ^ draw.getrandbits(32) for _ in range(150)}  # one first segment
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(40, 64) for b in range(a)}
    return sorted(prints)


def test_crowded_entries_by_brute_force(spark):
    prints = crowded_rows()
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    rows = {(r.a, r.b) for r in simhash.near_links(df, crowd=8).collect()}
    bits = np.array(prints, np.uint64)
    near = {(i, j) for i in range(len(bits)) for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 2).tolist() if i < j}

    def components(links):
        low = list(range(len(prints)))

        def root(i):
            while low[i] != i:
                low[i] = low[low[i]]
                i = low[i]
            return i

        for a, b in links:
            x, y = sorted((root(a), root(b)))
            low[y] = x
        return [root(i) for i in range(len(prints))]

    place = {p: i for i, p in enumerate(signed)}
    links = {(place[a], place[b]) for a, b in rows}
    assert all(tuple(sorted(x)) in near for x in links)
    assert components(links) == components(near)


def test_groups_with_exchanged_and_hot_keys(spark, monkeypatch):
    """Joins by exchange, with hot keys on a path of their own, give what broadcasts give."""
    words = [f"w{i}" for i in range(300)]
    draw = random.Random(2)
    texts = [" ".join(draw.choices(words, k=40)) for _ in range(40)]
    rows = [(i, texts[0] if i % 3 == 0 else texts[i % 40]) for i in range(400)] + [(None, texts[0]), (None, texts[0]), (7, texts[7])]
    docs = table(spark, rows)
    expected = sorted(simhash.near_groups(docs).select("doc_id", "component_id").collect(), key=str)
    kept = sorted(simhash.keep_first(docs).collect(), key=str)
    good = sorted(quality.verdicts(docs).collect(), key=str)
    near = sorted(nearcopies.keep_first(docs).collect(), key=str)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (10,))
    assert sorted(simhash.near_groups(docs).select("doc_id", "component_id").collect(), key=str) == expected
    assert sorted(simhash.keep_first(docs).collect(), key=str) == kept
    assert sorted(quality.verdicts(docs).collect(), key=str) == good
    assert sorted(nearcopies.keep_first(docs).collect(), key=str) == near
    assert len(kept) == 40 and sum(r.doc_id is None for r in kept) == 0


def test_null_ids_and_repeats_in_groups(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, None), (3, ""), (3, ""), (9, "x y z w v u")]
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_groups(table(spark, rows)).collect()), key=str)
    assert got == sorted([(0, None), (0, None), (4, 3), (3, 3), (3, 3), (9, 9)], key=str)
    kept = simhash.keep_first(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, "a b c d e f"), (3, ""), (9, "x y z w v u")], key=str)


def clashing(spark, tmp_path):
    """Documents with columns named like those that the stages make."""
    kind = ", ".join(["doc_id long", "text string", "source string", *(f"`{c}` string" for c in CLASHING)])
    words = [f"word{i}" for i in range(500)]
    draw = random.Random(8)
    rows = []
    for i in range(60):
        text = " ".join(draw.choices(words, k=60)) + (" you utter moron" if i % 4 == 0 else " thank you kindly")
        rows.append((i, text, "h"))
    rows += [(100, rows[1][1], "h"), (None, None, None), (1, rows[1][1], "h"), (101, "short", "h")]
    docs = spark.createDataFrame([(*r, *(f"{c}-{r[0]}" for c in CLASHING)) for r in rows], kind)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = clashing(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.exceptAll(docs).count() == 0, name
        assert 0 < out.count() < docs.count(), name
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() > 0
    good = quality.clean_texts(docs)
    assert good.columns == [*docs.columns, "clean_text"] and good.drop("clean_text").exceptAll(docs).count() == 0


def test_stages_of_empty_documents(spark, tmp_path):
    docs = clashing(spark, tmp_path).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_shards_by_brute_force(spark):
    draw = random.Random(6)
    rows = [(i if i % 50 else None, None if i % 97 == 0 else "same" * 40 if i % 3 == 0 else f"t{draw.randrange(900)} " * draw.randrange(60)) for i in range(2000)]
    got = sharding.shard_rows(table(spark, rows), shards=5, parts=3).collect()
    key = lambda t: np.int64(np.uint64(xxhash.xxh64((t or "").encode(), seed=42).intdigest()))
    order = sorted((int(key(t)), i if i is not None else sharding.LOW, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), i) for i, t in rows)
    mine = sorted(((r.shard, r.slot) for r in got))
    by_place = {(r.shard, r.slot): r for r in got}
    total = sum(x[2] for x in order)
    at, ends = 0, {}
    for (k, d, size, check, i), place in zip(order, mine, strict=True):
        r = by_place[place]
        assert (r.size, r.text_crc32, r.doc_id) == (size, check, i)
        at += size
        ends[place[0]] = at
    assert sorted(ends) == list(range(5))
    for s, end in ends.items():
        assert abs(end - total * (s + 1) / 5) <= sharding.TOLERANCE * total / 5 + 4000


def test_written_shards(spark):
    docs = table(spark, [(i, f"text {i} " * (i % 30)) for i in range(500)] + [(None, None), (3, "text 3 " * 3)])
    path = fresh_path(spark, "shards-test")
    sharding.write_shards(docs, path, shards=4, parts=2)
    back = spark.read.parquet(path)
    assert back.drop("shard").exceptAll(docs).count() == 0 and back.count() == docs.count()
    sizes = [r.n for r in back.groupBy("shard").agg(F.sum(sharding.size_of()).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 0.05 * sum(sizes)
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), path + "-2")


def test_scores_by_brute_force():
    """A text's score from a set of its n-grams, counted one by one."""
    draw = np.random.default_rng(1)
    weights = np.where(draw.random(1 << toxicity.BITS) < 0.05, draw.normal(size=1 << toxicity.BITS), 0).astype(np.float32)
    model = toxicity.Model(weights, -0.3)
    for text in [None, "", "a", "Hello  there,\tYOU moron", "é😀 x", "word " * 400]:
        raw = b" " + (text or "").encode().lower().translate(toxicity.SPACE) + b" "
        buckets = set()
        for n in toxicity.ORDERS:
            for i in range(len(raw) - n + 1):
                value = int.from_bytes(raw[i : i + n], "little") + ((n - 1) << 56)
                buckets.add(((value * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - toxicity.BITS))
        z = -0.3 + sum(float(weights[b]) for b in buckets)
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_repeated_ids_dont_lift_the_bound_of_the_sample(spark):
    docs = table(spark, [(i % 5, f"text number {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5)] * 3, "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(5))
    assert len(rows) == 5 - held
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 200


def test_toxicity_on_rows_held_out(spark):
    """Recall and precision on labelled rows whose labels weren't learned."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.scored(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    hits, wrong, missed = n.get((1, 1), 0), n.get((0, 1), 0), n.get((1, 0), 0)
    assert hits >= 0.7 * (hits + missed)
    assert hits >= 0.95 * (hits + wrong)
