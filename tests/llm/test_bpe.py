"""Byte-level BPE by a rank file against the tiktoken library."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attnmaps.llm import bpe, queries
from attnmaps.llm.tokens import ID_TYPE

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
OWN = bpe.RankCodec(PATH)
HARD = ["", " ", "  a", "a  b ", "don't we'll", "<|endoftext|>", "é漢😀" * 50, "x" * 5000, " a b\x85c\x1cd", "a\r\n\r\n b", "​a", "\U0010ffff́"]


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PLAIN = library(PATH)


def ids_of(text):
    return np.frombuffer(OWN.encode(text), dtype=ID_TYPE)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n\tab'sé.,!1²½_<|>A ́漢"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_spans_and_slices(text):
    ids = ids_of(text)
    assert ids.tolist() == PLAIN.encode_ordinary(text) and OWN.decode(ids) == text.encode()
    starts, ends = OWN.spans(text.encode(), ids)
    at = 0
    for k, i in enumerate(ids.tolist()):
        own = PLAIN.decode_single_token_bytes(i)
        before, upto = (text.encode()[:n].decode(errors="ignore") for n in (at, at + len(own)))
        assert starts[k] == len(before) and ends[k] in (len(upto), len(upto) + 1)
        assert text[starts[k] : ends[k]].encode().find(own) >= 0 and (ends[k] == len(upto)) == (text[: ends[k]] == upto)
        at += len(own)
    for size in (1, 2, 7):
        assert b"".join(OWN.whole_characters(ids, k, min(len(ids), k + size)) for k in range(0, len(ids), size)) == text.encode()


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_hard_texts(name):
    own, plain = bpe.RankCodec(public_tokenizers.path(name)), library(public_tokenizers.path(name))
    for text in HARD:
        assert np.frombuffer(own.encode(text), dtype=ID_TYPE).tolist() == plain.encode_ordinary(text)


def test_query_against_the_library(spark):
    texts = {r[0]: r[1] or "" for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()}
    found = queries.op11_byte_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        ids = PLAIN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "é漢" * 3, 0), (3, "ab " * 200_000, 0), (3, "ab " * 200_000, 0), (4, "😀", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = bpe.encode(docs, PATH, spans=True)
    got = coded.collect()
    assert [r.id for r in got] == [1, 2, None, 3, 3, 4] and all(len(r.ids) == 4 * len(r.starts) == 4 * len(r.ends) for r in got)
    assert [r.ids for r in got] == [OWN.encode(x) for _, x, _ in rows] and bytes(got[0].ids) == b""
    back = bpe.decode(coded.withColumn("decoded", F.lit(1)), PATH).collect()
    assert [bytes(r.decoded).decode() for r in back] == [x or "" for _, x, _ in rows]
    assert [r.n_split for r in back][-1] == len(ids_of("😀")) - 1
    slices = bpe.decode_slices(coded, PATH, 2).orderBy("id", "slice").collect()
    assert "".join(r.text for r in slices if r.id == 4) == "😀" and "".join(r.text for r in slices if r.id is None) == "é漢" * 3
    assert not [r for r in slices if r.id in (1, 2)]
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "id long, ids binary"), PATH).collect()[0].decoded == b""
