"""Token files and packing against the tokenizer itself."""

import zlib
from collections import defaultdict
from itertools import product
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attnmaps.llm import packing, queries, token_store, tokens
from attnmaps.llm.tokens import ID_TYPE, PieceEncoder

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
OWN = PieceEncoder(PATH)
DOC = "doc_id long, text string, n int"


def plain(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids, dtype=ID_TYPE)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n\tab'sé.,!1²½_<|>A ́漢"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_equal_the_whole(text):
    assert OWN.encode(text) == plain(text).tobytes()


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b ", "don't we'll", "x<|endoftext|>y", "<|endoftext|><|endoftext|> a", "a\n b\n\n c", "é" * 3000, "1234 5,6", "　 a", "end "])
def test_hard_texts(text):
    assert OWN.encode(text) == plain(text).tobytes()


COLUMN = [None, "", " ", "a", "b c, d.", "the cat;\nthe cat", "x  y", "p <|endoftext|> q", "q\t r", "é漢 ÿ\xff é漢", " lead", "end ", "w" * 200 + " " + "v" * 200, "the cat; the cat, the"] * 3


@pytest.mark.parametrize(("cache", "chunk", "lot"), [(16 << 20, 4 << 20, 20_000), (0, 1, 1), (200, 30, 2), (1 << 20, 64, 3)])
def test_columns_of_texts(cache, chunk, lot, monkeypatch):
    """Hard texts among others, however words are cut in chunks and lots and whatever the cache holds."""
    for name, value in (("CACHE_BYTES", cache), ("CHUNK_BYTES", chunk), ("LOT_WORDS", lot)):
        monkeypatch.setattr(tokens, name, value)
    own = PieceEncoder(PATH)
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["cut off", *COLUMN], kind).slice(1)
        assert list(own.encode_all(column)) == [plain(x).tobytes() for x in COLUMN]
    assert list(own.encode_all(column.slice(0, 0))) == []


def test_a_piece_of_a_column_is_encoded_once(monkeypatch):
    """A full cache doesn't make words that recur in a column go to the tokenizer again."""
    monkeypatch.setattr(tokens, "CACHE_BYTES", 0)
    own, seen = PieceEncoder(PATH), []
    model = own.model
    own.model = SimpleNamespace(tokenize=lambda x: seen.append(x) or model.tokenize(x))
    words = ["".join(x) for x in product("abcdefgh", repeat=3)]
    texts = ["- " + " ".join(words[k:] + [f"{x}," for x in words[:k]]) for k in range(40)]
    assert list(own.encode_all(pa.array(texts))) == [plain(x).tobytes() for x in texts]
    assert len(seen) == len(words) + 2  # the words, a comma and a dash


def test_another_kind_of_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    assert PieceEncoder(path).encode("Some Text") == np.array(other.encode("Some Text", add_special_tokens=False).ids, dtype=ID_TYPE).tobytes()


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packing_of_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000).astype(ID_TYPE)
    data = token_store.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8) and (token_store.unpack(data, 1000, bits) == ids).all()


@pytest.mark.parametrize("bits", [13, 16])
def test_random_access(bits):
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 2**bits, n).astype(ID_TYPE) for n in (0, 5, 100, 1, 700)]
    file = token_store.TokenFile(token_store.file_bytes([3, None, 4, 5, 9], [x.tobytes() for x in ids], bits, block=64))
    assert file.doc_ids == [3, None, 4, 5, 9] and all((file.document(k) == x).all() for k, x in enumerate(ids))
    flat = np.concatenate(ids)
    assert (file.tokens_at(63, 130) == flat[63:130]).all() and len(file.tokens_at(5, 5)) == 0
    with pytest.raises(ValueError):
        token_store.file_bytes([1], [np.array([2**bits], dtype=ID_TYPE).tobytes()], bits)


def texts(spark):
    return {r[0]: r[1] for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_token_files_query(spark):
    at, expected = 0, {}
    for i, text in sorted(texts(spark).items()):
        ids = np.append(plain(text), 2).astype(ID_TYPE)
        expected[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, SF).collect()} == expected


def test_token_files_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_DOCS", 2)
    rows = [(4, "b", 0), (None, "x", 0), (2, None, 0), (4, "a", 0), (3, "", 0), (9, "long " * 20000, 0)]
    folder = f"file://{tmp_path}/tokens"
    written = token_store.write_tokens(spark.createDataFrame(rows, DOC), folder, PATH, 2)
    assert written.agg({"n_docs": "sum"}).first()[0] == len(rows)
    found = token_store.read_tokens(folder, written).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 2, 3, 4, 4, 9] and [r.n_tokens for r in found[1:3]] == [1, 1]
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found[:-1]]]).tolist()


def test_token_files_of_one_id_and_of_no_rows(spark, tmp_path):
    """Rows of one id are spread over many ranges, and still follow each other."""
    rows = spark.createDataFrame([(None if k % 2 else 7, f"text {k} <|endoftext|>", k) for k in range(400)], DOC).withColumn("hash", F.lit(1))
    folder = f"file://{tmp_path}/tokens"
    found = token_store.read_tokens(folder, token_store.write_tokens(rows, folder, PATH, 2, parts=8)).orderBy("start").collect()
    assert len({r.file for r in spark.read.parquet(f"{folder}/files").collect()}) > 4
    assert [r.doc_id for r in found] == [None] * 200 + [7] * 200
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found[:-1]]]).tolist()
    assert found[0].n_tokens == len(plain("text 1 <|endoftext|>")) + 1
    empty = f"file://{tmp_path}/empty"
    assert token_store.read_tokens(empty, token_store.write_tokens(rows.limit(0), empty, PATH, 2)).count() == 0


def check_packed(rows, ids, end):
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        own = np.append(own, end).astype(ID_TYPE)
        at = 0
        for k, r in enumerate(sorted(parts[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            assert k == 0 or r.length == packing.CAPACITY
            at += r.length
        assert at == len(own)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(sequences)


@pytest.mark.parametrize("partitions", [1, 9])
def test_packing_query(spark, partitions):
    docs = queries.table(spark, SF, "documents").repartition(partitions)
    ids = {i: plain(t) for i, t in texts(spark).items()}
    n = check_packed(packing.pack_documents(docs, PATH, 0).collect(), ids, 0)
    bound = -(-sum(len(x) + 1 for x in ids.values()) // packing.CAPACITY)
    assert bound <= n <= bound + 1 + (partitions > 1)  # 200 documents leave little to choose from


@pytest.mark.parametrize("run", [7, 50])
def test_packing_in_many_runs_of_a_partition(spark, run, monkeypatch):
    """Bins that runs of one partition carry meet in one node; no piece is lost or placed twice."""
    monkeypatch.setattr(packing, "RUN", run)
    docs = queries.table(spark, SF, "documents").coalesce(1).withColumns({"bin": F.lit(1), "room": F.lit(2), "piece": F.lit(3)})
    ids = {i: plain(t) for i, t in texts(spark).items()}
    n = check_packed(packing.pack_documents(docs, PATH, 0).collect(), ids, 0)
    bound = -(-sum(len(x) + 1 for x in ids.values()) // packing.CAPACITY)
    assert bound <= n <= 1.1 * bound + 2


def test_packing_edges(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "word " * 5000, 0)], DOC)
    out = packing.pack_documents(rows, PATH, 0).collect()
    check_packed(out, {1: plain(""), 2: plain(""), None: plain("a b"), 3: plain("word " * 5000)}, 0)
    assert packing.pack_documents(rows.limit(0), PATH, 0).count() == 0


def packed_sizes(spark, sizes, partitions):
    """Sequences of 50 tokens at most from documents of so many tokens, with the end id, dealt out in order."""
    rows = spark.sparkContext.parallelize([(i, " a" * (n - 1)) for i, n in enumerate(sizes)], partitions)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return check_packed(packing.pack_documents(docs, PATH, 0, capacity=50).collect(), {i: plain(" a" * (n - 1)) for i, n in enumerate(sizes)}, 0)


def test_packing_into_nearly_full_bins(spark):
    """The last token of a bin is room for a document of one token in another partition."""
    assert packed_sizes(spark, [49] * 4 + [1], 5) == 4
    nearly = spark.createDataFrame([(0, " a" * 2044), (1, " a" * 2)], "doc_id long, text string").repartitionByRange(2, "doc_id")
    assert check_packed(packing.pack_documents(nearly, PATH, 0).collect(), {0: plain(" a" * 2044), 1: plain(" a" * 2)}, 0) == 1


def test_packing_with_all_hosts_in_one_run(spark, monkeypatch):
    """A run has the only hosts, more than 64, and all other runs of the partition a light bin each."""
    monkeypatch.setattr(packing, "RUN", 100)
    monkeypatch.setattr(packing, "CAPACITY", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert packed_sizes(spark, [30] * 100 + [99 * 50 + 20] * 80, 1) == 100 + 80 * 99
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packing_leaves_no_host_behind(spark):
    """As many sequences as a tree in which all bins go on."""
    sizes = [30 + k % 21 for k in range(1500)] + [5 + 7 * k % 19 for k in range(27)]
    rng = np.random.default_rng(5)
    sizes = [sizes[k] for k in rng.permutation(len(sizes))]
    for partitions in (9, 70):
        ends = [len(sizes) * k // partitions for k in range(partitions + 1)]
        fills = [sizes[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        pack = lambda items: [50 - r for r in packing.best_fit(items, 50)[2]]
        fills = [pack(x) for x in fills]
        while len(fills) > 1:
            fills = [pack(sum(fills[k : k + packing.FAN_IN], [])) for k in range(0, len(fills), packing.FAN_IN)]
        assert packed_sizes(spark, sizes, partitions) <= len(fills[0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(sizes):
    bins, offsets, rooms = packing.best_fit(sizes, 50)
    filled = defaultdict(list)
    for b, o, s in zip(bins, offsets, sizes, strict=True):
        filled[b].append((o, s))
    for b, items in filled.items():
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
        assert at == 50 - rooms[b]
    assert sum(r >= 25 for r in rooms) <= 1


def test_only_one_bin_needs_a_host():
    assert packing.cuts(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cuts(4096, 2048) == [(0, 2048), (2048, 2048)] and packing.cuts(1, 2048) == [(0, 1)]
