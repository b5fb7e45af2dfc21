"""The backtracking encoder against the library that it must equal."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latelane.llm import bpe
from latelane.llm.queries import op3_bpe
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def _ids(text):
    return np.frombuffer(bpe.encoder(PATH).encode(text), "<u4").tolist()


def test_every_code_point(library):
    texts = [f"a{chr(c)}b {chr(c)}1" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    assert [_ids(t) for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="aabtehing'sdrLVMéΣ漢1 !🙂<|>")))
def test_random_texts_round_trip(text):
    library = Tokenizer.from_file(PATH)
    got = library.encode(text, add_special_tokens=False).ids
    assert _ids(text) == got
    assert bpe.decoder(PATH).decode(np.array(got, "<u4").tobytes()).decode() == library.decode(got, skip_special_tokens=False)


def test_special_and_very_long(library):
    for text in ("a<|endoftext|>B<|startoftext|>", "<|endoftext|" * 3, "ab" * 100_000, "", " \n"):
        assert _ids(text) == library.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark, library):
    rows = {r.doc_id: r for r in op3_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(rows[d.doc_id])[1:] == want


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x", "y", 3), (None, "the cat", "x", "y", 3), (2, "", "x", "y", 3)],
                               "doc_id long, text string, k string, ids string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encode(df, PATH).collect()}
    assert got[1].n_tokens == 0 and got[2].ids == b"" and got[None].n_tokens == 2
    assert bpe.encode(df.filter("false"), PATH).count() == 0
    assert bpe.decode(bpe.encode(df, PATH).withColumn("decoded", bpe.F.lit(1)), PATH).filter("doc_id is null").first().decoded == "the</w> cat</w>"


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127)))
def test_words_of_ascii_texts_are_those_of_all_texts(text):
    e = bpe.encoder(PATH)
    assert e.split_words(text) == e.words.findall(e.normal(text))
