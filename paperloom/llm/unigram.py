"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton finds every vocabulary piece in a chunk of text in one scan. The dynamic
programme walks the end positions and carries the best score and the number of tokens of the path
that has it; no path is stored. The rules are those of the tokenizers library's unigram model with
byte fallback:

- a space becomes the mark U+2581, one mark is put before a text that doesn't start with one, and
  the text is cut before every mark;
- scores add up as doubles; of equal scores at one end the piece that starts first stays;
- a character that is no piece of its own scores ten less than the least piece, and counts as the
  bytes of its UTF-8 form.

Chunks repeat, so each worker keeps the counts of those it has met, up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordids import byte_slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks whose counts a worker keeps, and the longest that it keeps.
CACHE_CHUNKS = 500_000
CACHED_LENGTH = 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts tokens of texts with one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], cache_chunks: int = CACHE_CHUNKS):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache_chunks = cache_chunks
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def best(self, chunk: str) -> tuple[float, int]:
        """Score and number of tokens of the best path through one chunk."""
        single, unknown = self.single, self.unknown
        scores, counts = [0.0] * (len(chunk) + 1), [0] * (len(chunk) + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in chunk]
        for end, match in self.automaton.iter(chunk):
            found[end].append(match)
        for end, matches in enumerate(found):
            # Longest first, so an equal score never displaces a piece that starts earlier.
            top, n = None, 0
            for length, score in sorted(matches, reverse=True):
                score += scores[end + 1 - length]
                if top is None or score > top:
                    top, n = score, counts[end + 1 - length] + 1
            if chunk[end] not in single:
                score = scores[end] + unknown
                if top is None or score > top:
                    top, n = score, counts[end] + len(chunk[end].encode())
            scores[end + 1], counts[end + 1] = top, n
        return scores[-1], counts[-1]

    def _count(self, chunk: str) -> int:
        n = self.young.get(chunk)
        if n is None:
            n = self.old.get(chunk)
            if n is None:
                n = self.best(chunk)[1]
            if len(chunk) <= CACHED_LENGTH:
                self.young[chunk] = n
                if len(self.young) > self.cache_chunks:
                    self.old, self.young = self.young, {}
        return n

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; null and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = pc.replace_substring(texts, " ", MARK)
        # The first mark is the one that is there or put there; the rest cut the chunks.
        bare = pc.if_else(pc.starts_with(marked, MARK), pc.utf8_slice_codeunits(marked, 1), marked)
        parts = pc.split_pattern(bare, MARK)
        bounds = parts.offsets.to_numpy()
        bounds = bounds - bounds[0]
        chunks = parts.flatten().dictionary_encode()
        each = np.fromiter((self._count(MARK + c) for c in chunks.dictionary.to_pylist()), np.int64, len(chunks.dictionary))
        sums = np.concatenate(([0], np.cumsum(each[chunks.indices.to_numpy()])))
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        return np.where(empty, 0, sums[bounds[1:]] - sums[bounds[:-1]])


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's own counter, kept between batches and tasks."""
    if path not in _loaded:
        _loaded[path] = Counter(vocabulary(path))
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_chars, n_tokens`` of each row of ``docs``: one pass, no exchange.

    Null text counts as empty and has no tokens; repeated rows and null ids stay; other columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                counts = pa.array(own.count(part.column(2)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts], ["doc_id", "n_chars", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
