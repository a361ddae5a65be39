import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from paperloom.llm import unigram
from paperloom.llm.queries import tokenizer


@pytest.fixture(scope="module")
def pieces():
    return unigram.vocabulary(tokenizer("piece_bpe_32k.model"))


def library(pieces):
    made = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always", split=True)
    return made


TEXTS = ["", " ", "  two  spaces ", "a\nb\n\nc", "▁mark", "naïve café 梦 \U0001f600\U0001f601", "<s> <0x41> <unk>", "x" * 3000, "word " * 500, "\t\r\n"]


def test_counts_equal_the_library(pieces):
    expected = [len(e.ids) for e in library(pieces).encode_batch(TEXTS, add_special_tokens=False)]
    assert unigram.Counter(pieces).count(pa.array(TEXTS)).tolist() == expected


SMALL = [("<unk>", 0.0), ("a", -1.0), ("b", -2.0), ("ab", -3.0), ("ba", -3.0), ("aab", -4.0), ("▁", -1.0), ("▁a", -2.0), ("cc", -2.5)]
SMALL += [(f"<0x{i:02X}>", -50.0) for i in range(256)]


@given(st.lists(st.text("abc \n▁é", max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_ties_equal_the_library(texts):
    expected = [len(e.ids) for e in library(SMALL).encode_batch(texts, add_special_tokens=False)]
    assert unigram.Counter(SMALL, cache_chunks=3).count(pa.array(texts, pa.string())).tolist() == expected


def test_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "hello there", 5), (2, "", 5)], "doc_id long, text string, n_tokens int")
    rows = sorted((r.doc_id or 0, r.n_chars, r.n_tokens) for r in unigram.count_tokens(docs, tokenizer("piece_bpe_32k.model")).collect())
    assert rows[1:] == [(1, 0, 0), (2, 0, 0), (2, 0, 0)] and rows[0][:2] == (0, 11) and rows[0][2] > 0
    assert unigram.count_tokens(docs.limit(0), tokenizer("piece_bpe_32k.model")).count() == 0
