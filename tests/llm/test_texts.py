"""Language ID, quality rules, personal data, chat formatting and URL filters."""

import hashlib
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import pytest
import regex
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, connect
from pyspark.sql import functions as F

from attnmaps.llm import chat, langid, pii, quality, queries, urlfilter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string"


def texts(spark, sf=SF):
    return {r[0]: r[1] for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()}


# --- language ID -------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r[0]: r[1] for r in queries.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    found = queries.op3_language_id(spark, sf).collect()
    assert len(found) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in found) <= 0.02 * len(found)


def test_language_edges(spark):
    rows = [(k, w * 40, lang) for k, (w, lang) in enumerate([("the house is big ", "en"), ("la maison est grande ", "fr")])]
    train = spark.createDataFrame([*rows, (7, "x", None), (8, None, "en"), (9, "", "fr")], DOC)
    model = langid.train(train)
    assert sorted(model) == ["en", "fr"]
    asked = spark.createDataFrame([(1, "THE HOUSE is big", None), (2, None, None), (3, "123 !!", None), (None, "la maison est grande", None), (4, "q", None), (1, "THE HOUSE is big", None)], DOC)
    found = [(r.id, r.lang_pred, r.rejected) for r in langid.classify(asked, model).collect()]
    assert found == [(1, "en", False), (2, "und", True), (3, "und", True), (None, "fr", False), (4, "en", True), (1, "en", False)]
    assert sorted(r.doc_id or -1 for r in langid.keep_identified(asked.withColumn("id", F.lit(3)), model).collect()) == [-1, 1, 1]
    assert langid.train(train.limit(0)) == {}
    assert [r.lang_pred for r in langid.classify(asked, {}).collect()] == ["und"] * 6
    assert langid.classify(asked.limit(0), model).count() == 0


def plain_language(text, dictionaries):
    """Predictions by a second, direct use of the compressor."""
    if not any(c.isalpha() for c in text or ""):
        return "und", True
    data, sizes = text.lower().encode(), {}
    for lang, own in dictionaries.items():
        shared = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=shared, compression_params=parameters).compress(data[k : k + 8192])) for k in range(0, len(data), 8192))
    (best, lang), (second, _) = sorted((n, k) for k, n in sizes.items())[:2]
    return lang, not (second > best and second - best >= 0.01 * best)


def test_language_against_plain_compression(spark):
    docs = queries.table(spark, SF, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    own = texts(spark)
    found = {r.doc_id: (r.lang_pred, r.rejected) for r in queries.op3_language_id(spark, SF).collect()}
    agree = sum(found[i] == plain_language(t, model) for i, t in own.items())
    assert agree >= 0.98 * len(own)  # compressors with and without a prepared dictionary may differ by a byte


def test_few_texts_copied_often_stay_a_language(spark):
    fr, en = [f"la petite maison numéro {k} est près de la grande forêt " * 3 for k in range(5)], "the little house number {} stands by the old forest "
    rows = [(k, fr[k % 5], "fr") for k in range(6000)] + [(10_000 + k, en.format(k) * 3, "en") for k in range(300)] + [(20_000, "una casa", "es")]
    model = langid.train(spark.createDataFrame(rows, DOC))
    assert sorted(model) == ["en", "es", "fr"]


def test_texts_of_no_known_language_are_mostly_rejected(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").where("lang is not null")
    model = langid.train(docs.where("lang <> 'de'").where(~langid.held_out()))
    found = langid.classify(docs.where("lang = 'de'"), model).groupBy().agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    kept = langid.classify(docs.where("lang <> 'de'"), model).groupBy().agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert found > 0.7 and kept < 0.02


# --- quality rules ------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    data = text.encode()
    ratio = len(data) / len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(data))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed, round(ratio, 2)


def test_quality_query(spark):
    own = texts(spark)
    found = {r.doc_id: r for r in queries.op7_compression_bands(spark, SF).collect()}
    for i, text in own.items():
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text)[:6]
        assert not (r.base_failed and r.kept)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té#|\x0b\x1f\x85", max_size=80))
def test_text_stats(text):
    assert quality.text_stats(text.encode()) == brute_quality(text)[:5]


def test_quality_verdicts(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(800)]
    prose = " ".join(rng.choice(words, 3000))
    mixed = " ".join(rng.choice(words, 900)) + " " + " ".join(f"again{k % 3}" for k in range(3000))
    noise = "".join(chr(33 + int(x)) if x < 90 else " " for x in rng.integers(0, 100, 6000))
    rows = [(1, prose, ""), (2, mixed, ""), (3, noise, ""), (4, None, ""), (5, "", ""), (None, prose, ""), (6, "few words", "")]
    found = {r.id: r for r in quality.quality(spark.createDataFrame(rows, DOC)).collect()}
    assert found[1].kept and found[None].kept and not any(found[k].kept for k in (2, 3, 4, 5, 6))
    assert found[3].ratio < quality.band(6000)[0] and found[4].n_words == 0


# --- personal data ------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            s, digits = m[0], re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((kind, m.start(), m.end()))
    return found


HARD = [
    "a@b.c_d@e.f", "x@y", "a@b..c", "_@-.-.", "é a.b+c@d-e.f.g, ü 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111111",
    "+1 (555) 123-4567 and +12 and +1234567890123456", "1" * 30000, "a" * 30000 + "@b.c", "+1" + "(" * 5000, None, "", "12 34\t56", "😀 a@b.co 😀 c@d.co",
]


def test_base_rules_on_hard_texts(spark):
    rows = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    found = {r.id: r for r in pii.find(rows, pii.Boosted(None, {})).collect()}
    for i, text in enumerate(HARD):
        assert [tuple(x) for x in found[i].base] == brute_spans(text)
        assert found[i].spans == found[i].base and found[i].n_email == sum(k == "email" for k, _, _ in brute_spans(text))


def test_personal_data_query(spark):
    found = queries.op9_personal_data(spark, "/root/testdata/sf0.01").collect()
    own, added = texts(spark, "/root/testdata/sf0.01"), Counter()
    assert len(found) == len(own)
    for r in found:
        base = [f"{k}:{s}:{e}" for k, s, e in brute_spans(own[r.doc_id])]
        spans = r.spans.split(",") if r.spans else []
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(spans)
        added.update(x.partition(":")[0] for x in set(spans) - set(base))
    assert added["secret"] > 0


def test_training_without_data(spark):
    rows = spark.createDataFrame([(1, "nothing"), (None, None)], "doc_id long, text string")
    assert pii.train(rows).trees == [] and pii.train(rows.limit(0)).trees == []
    assert pii.find(rows.limit(0), pii.Boosted(None, {})).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([("mail a@b.co or +1 555 123 4567.",)], "t string").withColumn("doc_id", F.lit(1))
    spans = pii.find(df, pii.Boosted(None, {}), text_col="t")
    out = df.crossJoin(spans.select("spans")).select(pii.redact(F.col("t"), F.col("spans"))).first()[0]
    assert out == "mail <email> or <phone>."


# --- chat ------------------------------------------------------------------------------------


TRICKY = ["<|start|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<\\\\</s>", "[\\INST]", "<|", "a\nb", "", "<|body|>x<|turn|>", "$1\\$2"]


def test_chat_round_trip(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", x) for k, x in enumerate(TRICKY)]
    rows += [(2, 300, "end", "b"), (2, 1, "end", "a"), (2, None, "<|end|>", None), (2, 299, None, "c"), (None, 0, "user", "n"), (2, 300, "end", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("run", F.lit(0))
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert read[1] == [(r, x) for _, _, r, x in rows[: len(TRICKY)]]
    assert read[2] == [("<|end|>", ""), ("end", "a"), ("", "c"), ("end", "b"), ("end", "b")] and read[None] == [("user", "n")]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_adjacent_turns_share_a_block(spark):
    turns = spark.createDataFrame([(1, k, "user", str(k)) for k in range(600)], "conv_id long, turn long, role string, text string")
    text = chat.format_conversations(turns).first()["formatted"]
    assert text.count("<|start|>") == 1 and text.count("<|turn|>") == 599


def test_loss_mask_lies_over_the_formatted_text(spark):
    said = ["a" * 3000, "", "😀 é [INST]", "<|end|> ok", "b\n" * 1500, "<|turn|>"]
    rows = [(1, k, "assistant" if k % 4 < 2 else "user", x) for k, x in enumerate(said * 3)] + [(2, 0, "user", "x"), (3, 0, "assistant", None)]
    masked = chat.loss_texts(chat.loss_mask(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    for r in masked.collect():
        want = [x or "" for i, _, role, x in rows if i == r.conv_id and role == "assistant"]
        assert r.loss_texts == want and len(r.loss_spans) == len(want)
        for s, x in zip(r.loss_spans, want, strict=True):  # places in the text as Python counts them
            assert r.formatted[s.start : s.end].replace("\\", "") == x.replace("\\", "")
        outside = list(r.formatted)
        for s in reversed(r.loss_spans):
            del outside[s.start : s.end]
        assert "".join(outside).count("<|start|>assistant<|body|>") == "".join(outside).count("<|start|>assistant")


def test_a_conversation_of_very_many_turns(spark):
    turns = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, repeat(' é', 20)) AS text")
    r = chat.loss_texts(chat.loss_mask(chat.format_conversations(turns))).selectExpr("size(loss_texts) AS n", "loss_texts[9999] AS last").first()
    assert (r.n, r.last) == (10_000, "turn 19999" + " é" * 20)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="<[\\|/sINT]> a", max_size=12), min_size=1, max_size=20))
def test_escape_is_reversible(spark, found):
    df = spark.createDataFrame([(x,) for x in found], "t string")
    out = df.select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u and not regex.search(r"<\||</?s>|\[/?INST\]", r.e) for r in out)


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_chat_format"])
def test_query_against_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])


# --- URL filters --------------------------------------------------------------------------------


def test_hosts(spark):
    urls = {"http://A.b.Com:80/x?u=http://c.d": "a.b.com", "https://u:p@h.org./": "h.org", "no url": None, "": None, None: None, "ftp://x": "x", "//h.org": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(urlfilter.url_host(F.col("u"))).collect()] == list(urls.values())


def test_keys_of_hosts(spark):
    hosts = {"a.b.com": ["a.b.com", "b.com"], "b.com": ["b.com"], "x": ["x"], "1.2.3.4": ["1.2.3.4"], "[::1]": ["[::1]"], None: None}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert [r[0] for r in df.select(urlfilter.host_keys(F.col("h"))).collect()] == list(hosts.values())


def test_columns_that_clash(spark):
    listed = spark.createDataFrame([("b.com", "x", "add", date(2024, 1, 5), 1)], "entry string, list string, action string, at date, valid_from int")
    rows = spark.createDataFrame([(1, "http://b.com/", date(2024, 1, 9), "e", "l", 7, "h")], "id long, url string, at date, entry string, list string, n_lists int, host string")
    assert [tuple(r) for r in urlfilter.block(rows, listed, "id", "url", "at").collect()] == [(1, "b.com", date(2024, 1, 9), True, "b.com", "x", 1)]


def test_validity_and_as_of(spark):
    day = lambda n: date(2024, 1, n)
    events = [("b.com", "x", "add", day(5)), ("b.com", "x", "add", day(6)), ("b.com", "x", "remove", day(10)), ("b.com", "x", "add", day(20)), ("a.b.com", "y", "add", day(8)), ("c.com", "x", "remove", day(1)), (None, "x", "add", day(1)), ("d.com", "x", "add", day(3)), ("d.com", "x", "remove", day(3))]
    listed = spark.createDataFrame(events, "entry string, list string, action string, at date")
    rows = [(1, "http://a.b.com/", day(4)), (2, "http://a.b.com/", day(5)), (3, "http://a.b.com/", day(9)), (4, "http://b.com/", day(10)), (5, "http://b.com/", day(25)), (6, None, day(9)), (7, "http://b.com/", None), (8, "http://notb.com/", day(9)), (9, "http://d.com", day(3)), (None, "http://b.com", day(7)), (2, "http://a.b.com/", day(5))]
    found = urlfilter.block(spark.createDataFrame(rows, "id long, url string, at date").withColumn("host", F.lit("z")), listed, "id", "url", "at").collect()
    assert len(found) == len(rows)
    assert {(r.id, r.blocked, r.entry, r.n_lists) for r in found} == {(1, False, None, 0), (2, True, "b.com", 1), (3, True, "a.b.com", 2), (4, False, None, 0), (5, True, "b.com", 1), (6, False, None, 0), (7, False, None, 0), (8, False, None, 0), (9, False, None, 0), (None, True, "b.com", 1)}
    assert urlfilter.block(spark.createDataFrame([], "id long, url string, at date"), listed, "id", "url", "at").count() == 0
