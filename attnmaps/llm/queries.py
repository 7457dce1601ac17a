"""Queries over the given tables that apply each operator with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attnmaps.llm import audit, bpe, chat, decontam, langid, linededup, packing, pii, quality, simhash, token_store, urlfilter, variants
from attnmaps.llm.common import new_folder

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids to packed files and read them back."""
    folder = new_folder(spark, "token-files")
    files = token_store.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), end_id=2)
    return token_store.read_tokens(folder, files)


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex().alias("fingerprint"), F.col("component").alias("component_id"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=0)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document, and a digest of what stays."""
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.train(docs.where(~langid.held_out()))
    rows = langid.classify(docs, dictionaries)
    return rows.select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "lang_pred", "score", "margin", "rejected")


def list_events(pages: DataFrame) -> DataFrame:
    """Dated events of a URL list, derived from the hosts of the pages themselves.

    A quarter of all hosts and parent domains enters one of three lists on a day that
    its hash gives, half of these leave it and a part of them comes back.
    """
    hosts = pages.select(urlfilter.url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    entries = hosts.select(F.explode(urlfilter.host_keys(F.col("host"))).alias("entry")).distinct()
    n = F.conv(F.substring(F.md5(F.col("entry").cast("binary")), 1, 7), 16, 10).cast("int")
    listed = entries.withColumn("n", n).where("n % 4 = 0")
    lists = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (F.col("n") % 3 + 1).cast("int"))
    event = lambda action, at, when: F.when(when, F.struct(F.lit(action).alias("action"), at.alias("at")))
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int"))
    added = F.col("n") % 200
    removed = added + 20 + F.col("n") % 90
    turns = F.array(
        event("add", day(added), F.lit(True)),
        event("remove", day(removed), F.col("n") % 8 == 0),
        event("add", day(removed + 15), F.col("n") % 24 == 0),
    )
    rows = listed.select("entry", lists.alias("list"), F.explode(turns).alias("e")).where("e is not null")
    return rows.select("entry", "list", "e.action", "e.at")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page held against the list entries that were active on its fetch day."""
    pages = table(spark, sf_dir, "pages")
    at = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    captures = pages.select("page_id", "url", at.alias("fetched_at"))
    return urlfilter.block(captures, list_events(pages), "page_id", "url", "fetched_at").withColumnRenamed("id", "page_id")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS fetched_at,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host
  FROM pages),
k AS (
  SELECT DISTINCT host, array_to_string(list_slice(l, i, len(l)), '.') AS entry
  FROM (SELECT host, string_split(host, '.') AS l, unnest(range(1, CASE WHEN regexp_matches(host, '^[0-9.]+$|^\[') THEN 1 ELSE greatest(1, len(string_split(host, '.')) - 1) END + 1)) AS i
        FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL))),
n AS (SELECT entry, CAST('0x' || substr(md5(entry), 1, 7) AS INT) AS n FROM (SELECT DISTINCT entry FROM k)),
v AS (
  SELECT entry, n, ['adult', 'malware', 'spam'][n % 3 + 1] AS list, n % 200 AS a, n % 200 + 20 + n % 90 AS r FROM n WHERE n % 4 = 0),
i AS (
  SELECT entry, list, DATE '2024-01-01' + a AS f, CASE WHEN n % 8 = 0 THEN DATE '2024-01-01' + r END AS t FROM v
  UNION ALL SELECT entry, list, DATE '2024-01-01' + (r + 15), NULL FROM v WHERE n % 24 = 0),
h AS (
  SELECT p.page_id, i.entry, i.list,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.entry) DESC, i.list, i.entry) AS rn,
    count(*) OVER (PARTITION BY p.page_id) AS n_lists
  FROM p JOIN k USING (host) JOIN i ON i.entry = k.entry AND p.fetched_at >= i.f AND (i.t IS NULL OR p.fetched_at < i.t))
SELECT p.page_id, p.host, p.fetched_at, h.entry IS NOT NULL AS blocked, h.entry, h.list, coalesce(h.n_lists, 0) AS n_lists
FROM p LEFT JOIN h ON h.page_id = p.page_id AND h.rn = 1
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and read digests back from what was written."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    parsed = chat.loss_texts(chat.loss_mask(chat.read_back(chat.format_conversations(turns.unionAll(more)))))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(all_turns).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '([<\[])(\\*)(\||/?s>|/?INST\])')) AS chars,
    length(role) + len(regexp_extract_all(role, '([<\[])(\\*)(\||/?s>|/?INST\])')) AS role_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN before IS NULL OR before <> role THEN role_chars + 24 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words FROM l),
o AS (SELECT *, len(words) AS n, array_to_string(words, ' ') AS body, CAST(doc_id AS HUGEINT) * 4294967296 + line_no AS pos FROM w),
d AS (SELECT body, any_value(words) AS words, any_value(n) AS n, min(pos) AS pos FROM o WHERE n >= 1 GROUP BY body),
x AS (
  SELECT body, pos, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 5)),
p AS (
  SELECT x.body, g.first AS best FROM x JOIN (SELECT v, i, min(pos) AS first FROM x GROUP BY v, i) g USING (v, i)
  UNION ALL SELECT x.body, d.pos FROM x JOIN d ON d.body = x.v AND d.n >= 5
  UNION ALL SELECT d.body, x.pos FROM x JOIN d ON d.body = x.v AND d.n >= 5
  UNION ALL SELECT body, pos FROM d),
b AS (SELECT body, min(best) AS best FROM p GROUP BY body),
f AS (SELECT o.doc_id, o.line_no, o.line, coalesce(o.n >= 1 AND o.pos > b.best, false) AS gone FROM o LEFT JOIN b ON b.body = o.body),
t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text
  FROM f GROUP BY doc_id)
SELECT a.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_dropped, 0) AS n_dropped,
  length(t.text) AS kept_chars, md5(t.text) AS kept_md5
FROM documents a LEFT JOIN t USING (doc_id)
"""


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line statistics, compression ratios and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the base rules' spans and those that trees add."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select(
        F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.BASE],
        F.sha2(pii.span_text("base").cast("binary"), 256).alias("base_sha256"), pii.span_text("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with test items, with the number of items and the worst."""
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.contamination(found).withColumnRenamed("id", "doc_id")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document by a rank file and decode the ids, with digests of both."""
    path = public_tokenizers.path(RANKS)
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split",
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, its frequent form and the end of its chain of forms."""
    return variants.variants(variants.counted_words(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT run, doc_id, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z\x{C0}-\x{FF}]{5,}')) AS run FROM d) GROUP BY ALL),
tb AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(0, 256) r(i))),
h AS (SELECT run, times, xor(list_reduce([CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(doc_id || ':' || run)), '..')], lambda c, b: xor(c >> 8, tab[1 + xor(c & 255, b)]), 4294967295), 4294967295) AS h FROM u, tb),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
x AS (SELECT DISTINCT word, n, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
y AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near, b.n FROM y a JOIN y b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN v b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM x a JOIN v b ON a.cut = b.word),
g AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM p GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n,
    CASE WHEN best_n >= 2 * v.n THEN (SELECT min(near) FROM p WHERE p.word = v.word AND p.n = g.best_n) END AS form
  FROM v LEFT JOIN g USING (word)),
c AS (
  SELECT word, word AS root, 0 AS depth FROM f
  UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root
FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM c GROUP BY word) r USING (word)
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language's documents, in all orders."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
b AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
q AS (
  SELECT part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b, 100 * capitals > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, doc_id > first AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM b LEFT JOIN labels USING (doc_id)),
m AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM q GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT v.x || w.x || y.x || z.x || k.x AS filter_order FROM l v JOIN l w ON w.x <> v.x JOIN l y ON y.x NOT IN (v.x, w.x) JOIN l z ON z.x NOT IN (v.x, w.x, y.x) JOIN l k ON k.x NOT IN (v.x, w.x, y.x, z.x)),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o),
r AS (
  SELECT part, filter_order, step, filter_order[step] AS x,
    CAST(coalesce(sum(n) FILTER (len(translate(filter_order[1:step], fails, '')) = step), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (len(translate(filter_order[1:step - 1], fails, '')) = step - 1 AND contains(fails, filter_order[step])), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (len(translate(filter_order[1:step - 1], fails, '')) < step - 1 AND contains(fails, filter_order[step])), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = filter_order[step]), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (len(translate(filter_order[1:step - 1], fails, '')) = step - 1 AND contains(fails, filter_order[step])), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (len(translate(filter_order[1:step - 1], fails, '')) = step - 1 AND contains(fails, filter_order[step])), 0) AS BIGINT) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_files": op2_token_files,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_chat_format": op5_chat_format,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_compression_bands": op7_compression_bands,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_personal_data": op9_personal_data,
    "op10_decontamination": op10_decontamination,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op4_url_filter": OP4_SQL, "op5_chat_format": OP5_SQL, "op12_spelling_variants": OP12_SQL, "op13_filter_audit": OP13_SQL}
