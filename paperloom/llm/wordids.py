"""Token ids of whole texts from the tokenizers library, by distinct words.

The vocabulary of ``word_bpe_49k.json`` splits at white space and drops it, so a text's ids are
the ids of its white-space-separated words, one after the other: no merge, normalisation or
added token crosses white space. Each distinct word of a slice of texts, without case and final
mark, goes to the library once; the ids of whole texts are gathered with numpy. A bounded number of
words is remembered between slices.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Text bytes that are split and gathered at once.
SLICE_BYTES = 2 << 20
#: Words whose ids a worker remembers: the first that it meets, as common words come early; it starts anew where they help no more.
KNOWN_WORDS = 300_000
#: Digits that stand between words in a text for the library.
DIGITS = "07"
#: Words that go to the library in one text.
JOINED_WORDS = 200
#: Such texts that go to the library at once.
TEXTS = 50
#: Final marks that are cut from words before they are looked up.
MARKS = ".,"
#: Code points below this may stand before a mark that is cut, if the library agrees.
ENDS = 0x250


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``limit`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


class WordIds:
    """``encode`` gives the ids of texts as one flat array with row offsets."""

    def __init__(self, path: str, most: int = KNOWN_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.digits = {d: self.tokenizer.encode(d, add_special_tokens=False).ids for d in DIGITS}
        if any(len(ids) != 1 for ids in self.digits.values()):
            raise ValueError("a digit isn't a token of its own in this vocabulary")
        self.most = most
        self._forget()
        self.ends = self._plain_ends()
        marks = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in MARKS]
        self.mark_ids = np.array([0, *(ids[0] for ids in marks)], "<u4")
        ends = "".join(sorted(self.ends))
        # Only marks that are one id each are cut.
        self.cut = f"([{ends}])[{MARKS}]$" if ends and all(len(ids) == 1 for ids in marks) else ""

    def _library(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of words (none of which holds white space that splits), and where each begins and how many it has.

        Words go many at a time, in one text with a digit behind each: a digit is a token of its own,
        and only a word that holds it gives its id. Words that hold both digits go alone.
        """
        left, starts, sizes = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, total = [np.zeros(0, "<u4")], 0
        for digit, (mark,) in self.digits.items():
            holds = pc.match_substring(words.take(pa.array(left)), digit).to_numpy(zero_copy_only=False)
            own, left = left[~holds], left[holds]
            if not len(own):
                continue
            cuts = np.append(np.arange(0, len(own), JOINED_WORDS), len(own)).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words.take(pa.array(own))), f" {digit} ")
            texts = [f"{t} {digit}" for t in joined.to_pylist()]
            # A few texts at a time: what the library gives back is many times as large as the ids.
            found = [np.fromiter(chain.from_iterable([e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + TEXTS], add_special_tokens=False)]), "<u4") for a in range(0, len(texts), TEXTS)]
            flat = np.concatenate(found)
            ends = np.flatnonzero(flat == mark)
            if len(ends) != len(own):
                raise ValueError("a word without a digit has its id in this vocabulary")
            starts[own] = total + np.concatenate(([0], ends[:-1] + 1))
            sizes[own] = ends - (starts[own] - total)
            parts.append(flat)
            total += len(flat)
        for i, e in zip(left.tolist(), self.tokenizer.encode_batch_fast(words.take(pa.array(left)).to_pylist(), add_special_tokens=False), strict=True):
            parts.append(np.array(e.ids, "<u4"))
            starts[i], sizes[i] = total, len(e.ids)
            total += len(e.ids)
        return np.concatenate(parts), starts, sizes

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_library`` of distinct words by way of those that are known."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(self.known) >= self.most and 10 * len(new) > 9 * len(names):
            self._forget()
            at[:], new = -1, np.arange(len(names))
        starts, sizes = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        old = at >= 0
        starts[old], sizes[old] = self.starts[at[old]], self.sizes[at[old]]
        flat = self.flat
        if len(new):
            found, begin, n = self._library(words.take(pa.array(new)))
            starts[new], sizes[new] = begin + len(flat), n
            flat = np.concatenate((flat, found))
            room = min(len(new), self.most - len(self.known))
            if room > 0:
                kept, ends = self._gathered(found, begin[:room], n[:room], np.zeros(room, np.int64))
                self.known.update(zip([names[i] for i in new[:room].tolist()], range(len(self.known), len(self.known) + room), strict=True))
                self.starts = np.concatenate((self.starts, ends[:-1] + len(self.flat)))
                self.sizes = np.concatenate((self.sizes, n[:room]))
                self.flat = np.concatenate((self.flat, kept))
        return flat, starts, sizes

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain_ends(self) -> frozenset[str]:
        """Letters before which the library tells a mark from the word.

        Not every letter is one: lower-casing may leave a combining mark that joins the one behind it.
        So each is asked for, alone and after a letter.
        """

        def ids(words: list[str]) -> list[list[int]]:
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

        letters = [c for c in map(chr, range(ENDS)) if c.isalpha()]
        words = [b + c for c in letters for b in ("", "a")]
        apart, plain = set(letters), ids(words)
        for mark in MARKS:
            (alone,) = ids([mark])
            apart -= {w[-1] for w, own, marked in zip(words, plain, ids([w + mark for w in words]), strict=True) if marked != own + alone}
        return frozenset(apart)

    def _cores(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Each word without a final full stop or comma, and which mark was cut (0: none).

        Both are runs of their own for the pre-tokenizer if one of ``ends`` stands before the mark.
        ASCII letters are lower-cased as the library would do, except beside the brackets of added tokens.
        """
        kept = pc.match_substring(words, "<|")
        lower = pc.ascii_lower(words)
        cores = pc.if_else(kept, words, lower) if pc.any(kept).as_py() else lower
        mark = np.zeros(len(words), np.int64)
        if self.cut:
            cores = pc.replace_substring_regex(cores, self.cut, r"\1")
            shorter = pc.less(pc.binary_length(cores), pc.binary_length(words)).to_numpy(zero_copy_only=False)
            for k, c in enumerate(MARKS, 1):
                mark[shorter & pc.ends_with(words, c).to_numpy(zero_copy_only=False)] = k
        return cores, mark

    @staticmethod
    def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ``flat`` one after the other, each with ``room`` free places behind it; and where each ends, from 0 on."""
        ends = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes + room, out=ends[1:])
        total = int(ends[-1])
        kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
        where = np.arange(total, dtype=kind)
        where += np.repeat((starts - ends[:-1]).astype(kind), sizes + room)
        return flat[np.minimum(where, max(len(flat) - 1, 0))] if len(flat) else np.zeros(total, "<u4"), ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) and offsets (int64, one more than rows). Null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False)
        cores, mark = self._cores(words.dictionary)
        distinct = cores.dictionary_encode()
        own = distinct.indices.to_numpy(zero_copy_only=False)
        flat, starts, sizes = self._ids(distinct.dictionary)
        # The ids of each distinct word with its mark, then those of the words as they come.
        flat, ends = self._gathered(flat, starts[own], sizes[own], (mark > 0).astype(np.int64))
        flat[ends[1:][mark > 0] - 1] = self.mark_ids[mark[mark > 0]]
        flat, ends = self._gathered(flat, ends[:-1][at], np.diff(ends)[at], np.zeros(len(at), np.int64))
        return flat, ends[bounds - bounds[0]]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own encoder, kept between batches and tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the flat ids and offsets of their texts."""
    encoder = word_ids(path)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        for a, b in byte_slices(texts):
            flat, ends = encoder.encode(texts.slice(a, b - a))
            yield batch.slice(a, b - a), flat, ends
