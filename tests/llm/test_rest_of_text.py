"""The compression verdict covers the text after the last full chunk."""

import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from attnmaps.llm import quality, queries


def prose(rng, size):
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(800)]
    return " ".join(rng.choice(words, size))[:size].encode()


def noise(rng, size):
    return bytes(rng.integers(33, 123, size, dtype=np.uint8))


def test_noise_after_one_chunk_is_seen():
    rng = np.random.default_rng(0)
    own = quality.Compression()
    for _ in range(10):
        text = prose(rng, 4100) + noise(rng, 4000)
        ratio, chunks, bad, fine = own.judge(text)
        low, high = quality.band(len(text))
        assert low <= ratio <= high and (chunks, bad, fine) == (2, 1, False)


def test_rest_counts_as_a_chunk():
    rng = np.random.default_rng(1)
    own = quality.Compression()
    assert own.judge(prose(rng, 4096))[1:] == (1, 0, True)
    assert own.judge(prose(rng, 8192))[1:] == (2, 0, True)
    assert own.judge(prose(rng, 9000))[1:] == (3, 0, True)
    assert own.judge(prose(rng, 8192) + b"again " * 600)[2:] == (1, False)
    assert own.judge(prose(rng, 16384) + noise(rng, 4000))[1:] == (5, 1, True)  # a fifth is within the share
    assert own.judge(b"")[1:3] == (0, 0)


#: The bands as stated in the README's terms: bytes from, least and greatest ratio.
LIMITS = [(32768, 1.6, 4.5), (8192, 1.5, 3.8), (2048, 1.35, 3.2), (1024, 1.25, 2.8), (512, 1.15, 2.6), (256, 1.0, 2.4), (128, 0.8, 2.2), (64, 0.6, 1.6), (0, 0.0, 1.3)]


def plain_verdict(text):
    """Whether the base rule and the bands keep a text, step by step."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = set()
    for k in range(len(words) - 4):
        if windows[tuple(words[k : k + 5])] > 1:
            repeated |= set(range(k, k + 5))
    if len(words) < 10 or 100 * len(repeated) > 20 * len(words):
        return False
    parameters = zstandard.ZstdCompressionParameters.from_level(3, write_checksum=False)

    def inside(part):
        ratio = len(part) / len(zstandard.ZstdCompressor(compression_params=parameters).compress(part))
        low, high = next((a, b) for n, a, b in LIMITS if len(part) >= n)
        return low <= ratio <= high

    if not inside(data):
        return False
    if len(data) <= 4096:
        return True
    parts = [data[k : k + 4096] for k in range(0, len(data) - 4095, 4096)]
    if len(data) % 4096:
        parts.append(data[-4096:])
    return sum(not inside(p) for p in parts) <= 0.3 * len(parts)


def test_verdicts_against_a_plain_version(spark):
    rows = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    found = {r.doc_id: r.kept for r in queries.op7_compression_bands(spark, "/root/testdata/sf0.01").collect()}
    assert found == {i: plain_verdict(t) for i, t in rows} and 0 < sum(found.values()) < len(found)


def test_edges_of_the_table(spark):
    rng = np.random.default_rng(3)
    text = prose(rng, 5000).decode()
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "x" * 300_000), (5, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("own") for x in ("id", "kept", "ratio", "n_words")})
    found = sorted(((r.id or -1, r.n_words, r.kept) for r in quality.quality(docs).collect()))
    assert [(i, k) for i, _, k in found] == [(-1, True), (1, True), (1, True), (2, False), (3, False), (4, False), (5, False)]
    assert quality.quality(docs.limit(0)).count() == 0
