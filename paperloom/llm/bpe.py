"""Byte-level BPE encoding and decoding by batched merge rounds.

The words of a batch that aren't known yet stand in one flat array of symbols. In each round every
word looks for its lowest-ranked pair; pairs are found by binary search over the sorted keys
``left * size + right`` of the vocabulary's merges, and all words merge that pair, from left to
right, at once. Only pairs beside a merged symbol are looked up again. Words without a mergeable
pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .wordids import byte_slices

#: The pattern that splits text before the merges of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in one generation of the cache.
CACHE_WORDS = 400_000
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """Encodes as the tokenizers library does with the same file and ``add_special_tokens=False``."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *added.values()]) + 1
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[c] for c in symbols], np.int32)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.made_by_rank = made
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.bytes_of = [b""] * self.size
        for token, i in {**vocab, **added}.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.token_size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.pieces = regex.compile(SPLIT).findall
        self.added = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cache_words = cache_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` where the vocabulary has no such merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 4 bytes each) of words given as UTF-8."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        own = np.arange(len(words))[sizes > 0]
        sizes = sizes[sizes > 0]
        starts = np.cumsum(sizes) - sizes
        last = np.zeros(len(symbol), bool)
        last[starts + sizes - 1] = True
        rank = np.full(len(symbol), NONE, np.int32)
        at = np.flatnonzero(~last)
        rank[at] = self._rank(symbol[at], symbol[at + 1])
        while len(own):
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                raw, width = symbol.astype("<u4").tobytes(), 4
                for w, a, n in zip(own[done].tolist(), starts[done].tolist(), sizes[done].tolist(), strict=True):
                    out[w] = raw[width * a : width * (a + n)]
                keep = np.repeat(~done, sizes)
                symbol, rank, last = symbol[keep], rank[keep], last[keep]
                own, sizes, best = own[~done], sizes[~done], best[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(own):
                    break
            hit = rank == np.repeat(best, sizes)
            at = np.flatnonzero(hit)
            # In a run of overlapping pairs every second one merges, from the left.
            head = np.ones(len(at), bool)
            head[1:] = np.diff(at) > 1
            first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbol[at] = self.made_by_rank[rank[at]]
            last[at] = last[at + 1]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            before = np.concatenate(([0], np.cumsum(gone)))
            sizes = sizes - (before[starts + sizes] - before[starts])
            starts = np.cumsum(sizes) - sizes
            at = at - before[at]
            symbol, rank, last = symbol[~gone], rank[~gone], last[~gone]
            rank[at] = NONE
            right = at[~last[at]]
            rank[right] = self._rank(symbol[right], symbol[right + 1])
            left = at[at > 0] - 1
            left = left[~last[left]]
            rank[left] = self._rank(symbol[left], symbol[left + 1])
        return out

    def _split(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.pieces(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += self.pieces(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pieces(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian, 4 bytes each."""
        split = [self._split(t) for t in texts]
        known: dict[str, bytes] = {}
        young, old = self.young, self.old
        missing = []
        for word in set().union(*split):
            ids = young.get(word)
            if ids is None:
                ids = self.special.get(word) or old.get(word)
                if ids is None:
                    missing.append(word)
                    continue
                young[word] = ids
            known[word] = ids
        if missing:
            new = dict(zip(missing, self.merge_words([w.encode() for w in missing]), strict=True))
            known.update(new)
            young.update(new)
        if len(young) > self.cache_words:
            self.old, self.young = young, {}
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        if len(ids) == 0:
            return ""
        each = self.token_size[ids]
        ends = np.cumsum(each)
        where = np.arange(ends[-1]) + np.repeat(self.token_start[ids] - (ends - each), each)
        return self.token_bytes[where].tobytes().decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The worker's own coder."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    coder = byte_bpe(path)
    for batch in batches:
        texts = batch.column(1)
        for a, b in byte_slices(texts):
            yield batch.slice(a, b - a), coder.encode([t or "" for t in texts.slice(a, b - a).to_numpy(zero_copy_only=False).tolist()])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` of ``docs(doc_id, text)``; null text is empty; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in _ids(batches, path):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        for batch in batches:
            texts = [coder.decode(np.asarray(ids.values if ids.is_valid else [], np.int64)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of whole texts, in one pass without exchange.

    The ids are encoded, then decoded from the ids alone. Null text is empty: no ids, and the
    digests of nothing. Repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        decimal = list(map(str, range(coder.size)))
        for batch, ids in _ids(batches, path):
            counts, ids_sha, text_sha = [], [], []
            for raw in ids:
                own = np.frombuffer(raw, "<u4")
                counts.append(len(own))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, own.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
