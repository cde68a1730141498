"""The queries of this subpackage and the SQL that states the same rows."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import functions as F

from creditlens.llm import audit, bpe, chat, credentials, exact, jaccard, mixing, phrases, pii, quality, substring, toxicity, warc

VOCABULARY = "byte_bpe_50k.json"

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``, with its SQL if there is one."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"
_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_substring_dedup", sql=r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM rows, unnest(range(1, len(w) - 33)) t(i)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
covered AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM again)),
words AS (SELECT r, i, w[i] AS word FROM rows, unnest(range(1, len(w) + 1)) t(i)),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM words s WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.r = s.r AND c.p = s.i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM rows LEFT JOIN kept USING (r)""")
def op1_substring_dedup(spark, sf_dir):
    return substring.remove_repeats(documents(spark, sf_dir))


@query("op2_jaccard_join")
def op2_jaccard_join(spark, sf_dir):
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op4_mixing", sql=f"""
WITH sized AS (SELECT doc_id, source, {_WORDS_SQL} AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM totals),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, encode(source) NULLS LAST) AS place FROM weighed),
shared AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::BIGINT
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS share
  FROM ranked WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ended AS (
  SELECT place, share FROM shared WHERE share * weight <= 3 * source_size ORDER BY place LIMIT 1),
targets AS (
  SELECT s.source, s.source_size,
    CASE WHEN s.place >= e.place THEN e.share * s.weight ELSE (3 * s.source_size)::DOUBLE END AS target
  FROM shared s, ended e),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated""")
def op4_mixing(spark, sf_dir):
    mixed = mixing.with_copies(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op5_exact_dedup", sql=f"""
WITH normal AS (SELECT doc_id, sha256({_LOWER_SQL}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY text_sha256)""")
def op5_exact_dedup(spark, sf_dir):
    found = exact.verdicts(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op6_bpe")
def op6_bpe(spark, sf_dir):
    encoded = bpe.encode_frame(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_quality", sql=rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM rows),
windows AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS k FROM split, unnest(range(1, len(w) - 3)) t(i)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letters,
    len(list_distinct(w)) AS differing
  FROM split s LEFT JOIN covered c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words
    OR (n_dup_lines >= 3 AND 10 * n_dup_lines > n_words) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * letters < 40 * n_words OR (n_words >= 100 AND 100 * differing < 5 * n_words)) AS kept
FROM measured""")
def op7_quality(spark, sf_dir):
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


@query("op8_warc", sql="""
WITH paid AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 AND count(*) OVER (PARTITION BY payload_digest) > 1
    THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM paid)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts""")
def op8_warc(spark, sf_dir):
    folder, index = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_records(folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_pii")
def op9_pii(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(pii.KINDS.index(k)))).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


_ESCAPED_SQL = "(length({0}) + len(regexp_extract_all({0}, '" + "|".join(["\\\\", *map(re.escape, chat.CONTROL)]) + "')))"
_MARKS = len(chat.TURN) + len(chat.TEXT) + len(chat.END) + 1
OWN_TURN = "</s>[INST] ok [/INST]"


@query("op10_chat_format", sql=f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{OWN_TURN}'), (-1, 1, 'assistant', '{OWN_TURN}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_ESCAPED_SQL.format("role")} + {_ESCAPED_SQL.format("text")} + {_MARKS})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""")
def op10_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(OWN_TURN).alias("text"),
    )
    pieces = chat.format_conversations(rows.unionByName(own), public_tokenizers.path(VOCABULARY))
    return chat.conversation_digests(pieces).drop("n_tokens")


@query("op11_filter_audit", sql=r"""
WITH firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1),
split AS (
  SELECT d.doc_id, coalesce(lang, '') AS part, f.t, regexp_extract_all(f.t, '[^\x20\x09-\x0D]+') AS w, d.doc_id > f.first AS copy
  FROM documents d JOIN firsts f ON coalesce(d.text, '') = f.t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(copy, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM split s LEFT JOIN marks m ON s.doc_id = m.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT p, array_to_string([('ABCDE')[x] for x in p], '') AS filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders),
run AS (
  SELECT part, filter_order, step, p[step] AS f, n, good, toxic, fails[p[step]] AS own, len(list_filter(fails, lambda x: x)) AS failing,
    len(list_filter(p[:step - 1], lambda x: fails[x])) > 0 AS gone
  FROM cells, steps),
audited AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT own), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND own), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND own), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (own AND failing = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND own), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND own), 0)::BIGINT AS toxic_lost
  FROM run GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM audited""")
def op11_filter_audit(spark, sf_dir):
    return audit.audit_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op12_secret_scan")
def op12_secret_scan(spark, sf_dir):
    found = credentials.find(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(credentials.BASE)]
    digest = F.sha2(credentials.listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), *counts, digest, credentials.listed(F.col("spans")).alias("spans"))


@query("op13_collocations", sql=r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS (
  SELECT lang, k, w[i : i + k - 1] AS w, count(*) AS n FROM split, (VALUES (1), (2), (3)) s(k), unnest(range(1, len(w) - k + 2)) t(i) GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
several AS (SELECT * FROM counts WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.w, c.n AS a, x.n AS l, y.n AS r, cut, (1000000::HUGEINT * c.n * c.n) // (x.n::HUGEINT * y.n) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM several) c
  JOIN counts x ON x.lang = c.lang AND x.w = c.w[:cut] JOIN counts y ON y.lang = c.lang AND y.w = c.w[cut + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, w, max(n) AS n FROM (SELECT lang, w[1:2] AS w, n FROM several WHERE k = 3 UNION ALL SELECT lang, w[2:3], n FROM several WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT b.*, array_to_string(b.w, ' ') AS phrase FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.w = b.w
  WHERE len(b.w) = 3 OR i.n IS NULL OR 100 * i.n < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, t.n, score::BIGINT AS score
FROM kept JOIN totals t USING (lang) QUALIFY rank <= 2000""")
def op13_collocations(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))
