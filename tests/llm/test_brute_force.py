"""Small fixtures with nulls, empty, long and repeated texts against plain versions."""

import hashlib
import re
import zlib

import pytest
import xxhash
from tokenizers import Tokenizer

from paperloom.llm import bpe, packing, quality, simhash
from paperloom.llm.queries import tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} it's, Café" for i in range(3000))
TEXTS = [None, "", " \n\t", "Hello  World\nHello  World\n# 5%", LONG, LONG, LONG + " x", "one two", "a b c d e f g h i j k l " * 4, "x\n" * 50]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "host" if i % 2 else None, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int").repartition(3)


def test_byte_bpe(docs):
    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        texts = (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        assert got[i] == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in texts))


def test_packing_places_every_id_once(docs):
    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(packing.packed_documents(docs, path).collect(), key=lambda r: (r.doc_id, r.piece))
    bins: dict[int, list[tuple[int, int]]] = {}
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        cuts = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        own = [r for r in rows if r.doc_id == i]
        assert [(r.piece, r.start, r.length) for r in own] == [(k, 4096 * k, len(c)) for k, c in enumerate(cuts)]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(b"".join(x.to_bytes(4, "little") for x in c)) for c in cuts]
        for r in own:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 4096


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    for i, t in enumerate(TEXTS):
        words, lines = WORDS.findall(t or ""), [x for x in (t or "").split("\n") if WORDS.search(x)]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        seen: dict[tuple, int] = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        repeated = {j for k, w in enumerate(windows) if seen[w] > 1 for j in range(k, k + 8)}
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == expected
        assert got[i].base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))


def test_simhash_groups(docs):
    prints = []
    for t in TEXTS:
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    low = list(range(len(TEXTS)))
    for _ in TEXTS:
        low = [min(low[j] for j in range(len(TEXTS)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(TEXTS))]
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_groups(docs).select("doc_id", simhash.hex_fingerprint().alias("fp"), "component_id").collect()}
    assert got == {i: (f"{prints[i]:016x}", low[i]) for i in range(len(TEXTS))}
