"""The operators as queries over the given tables: the digest columns come from each operator's own results."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweetframe.llm import chat, decontaminate, divergence, language_id, licenses, mixing, oddsketch, periodic, quality, secrets, simhash, suffix_tree, url_filter
from sweetframe.llm._common import NOT_SPACE, crc_mod, cut, table

#: Where the vocabulary files of public tokenizers lie; read on the driver only.
TOKENIZERS = os.environ.get("SWEETFRAME_TOKENIZERS", "/opt/tokenizers")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))).alias("held_out"))
    model = language_id.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1), f"{TOKENIZERS}/piece_bpe_32k.model")
    found = docs.select("doc_id", "held_out", language_id.identify(spark, model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(chat.swapped_replies(table(spark, sf_dir, "conversations")))


#: The contract's rules: verdict, host, path, place.
URL_RULES = (("block", "net", "/", 0), ("allow", "example.net", "/en/", 1), ("block", "example.com", "/de/", 2), ("allow", "org", "/fr/", 3))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string, place int")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", licenses.scan(spark, F.col("text")).alias("found"))
    joined = lambda name: F.array_join(f"found.{name}", ",").alias(name)
    return docs.select("doc_id", "found.n_words", "found.n_base", "found.first_word", "found.last_word", joined("base_labels"), joined("labels"), "found.score")


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = crc_mod(F.col("doc_id"), 10)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(left == 0, F.lit(False)).alias("held_out"))
    found = suffix_tree.assess(docs, docs.where(left != 0))
    return found.withColumnRenamed("tree_score", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.rates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prints = cut(docs.select("doc_id", simhash.fingerprint(F.col("text"), size=4).alias("fp")))
    return simhash.group(prints).select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", secrets.scan(spark, F.col("text")).alias("found"))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found.strong", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = lambda x: F.array_position(F.array(*map(F.lit, secrets.KINDS)), x["kind"])
    every = F.transform(F.array_sort(F.transform(F.concat("found.strong", "found.linked"), lambda x: F.struct(x["start"], rank(x), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: x)
    return docs.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(written(F.col("found.strong")), 256).alias("base_sha256"), written(every).alias("spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def looped(text: Column, doc_id: Column) -> Column:
    """The contract's texts: a tenth of the documents, by crc32 of the id, repeat a stretch up to their end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.regexp_extract_all(text, F.lit(NOT_SPACE), F.lit(0))
    n = F.nullif(F.size(words), F.lit(0))
    a = F.pmod(g, n)
    turns = 3 + F.pmod(g, F.lit(8))
    p = 1 + F.floor((n - a) / turns)
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), turns.cast("int"))), 1, (n - a).cast("int"))
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.rlike(text, F.lit(NOT_SPACE)), F.array_join(F.concat(F.slice(words, 1, a.cast("int")), again), " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.periodic_runs(docs)
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))  # runs come by start, then period
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digests = F.sha2(lines, 256).alias("runs_sha256"), F.sha2(periodic.collapsed(F.col("text"), F.col("runs")), 256).alias("collapsed_sha256")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), *digests)
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


def op13_odd_sketch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_url_filter": op3_url_filter,
    "op4_license_scan": op4_license_scan,
    "op5_benchmark_leaks": op5_benchmark_leaks,
    "op6_lm_score": op6_lm_score,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mix": op8_source_mix,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_secret_scan": op10_secret_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_odd_sketch_groups": op13_odd_sketch_groups,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": """
WITH replies AS (
  SELECT conv_id, max(turn) AS t, arg_max(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
pairs AS (
  SELECT a.conv_id, a.t, b.reply AS other FROM replies a JOIN replies b ON b.conv_id = xor(a.conv_id, 1)),
told AS (
  SELECT c.conv_id, c.turn, c.role, c.text AS chosen, CASE WHEN c.turn = p.t THEN p.other ELSE c.text END AS rejected,
         min(CASE WHEN c.turn = p.t AND c.text <> p.other THEN c.turn END) OVER (PARTITION BY c.conv_id) AS differs
  FROM conversations c JOIN pairs p ON c.conv_id = p.conv_id AND c.turn <= p.t),
shown AS (
  SELECT conv_id, turn, differs IS NULL OR turn < differs AS shared,
         '<|im_start|>' || role || chr(10) || chosen || '<|im_end|>' || chr(10) AS chosen,
         '<|im_start|>' || role || chr(10) || rejected || '<|im_end|>' || chr(10) AS rejected, length(role) + 13 AS head
  FROM told)
SELECT conv_id AS pair_id, count(*) FILTER (shared) AS n_prompt_turns,
       coalesce(string_agg(chosen, '' ORDER BY turn) FILTER (shared), '') AS prompt,
       coalesce(string_agg(chosen, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
       coalesce(string_agg(rejected, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected,
       coalesce(string_agg(CAST(head AS VARCHAR) || ':' || CAST(length(chosen) AS VARCHAR), ',') FILTER (NOT shared), '') AS chosen_mask,
       coalesce(string_agg(CAST(head AS VARCHAR) || ':' || CAST(length(rejected) AS VARCHAR), ',') FILTER (NOT shared), '') AS rejected_mask
FROM shown GROUP BY conv_id
""",
    "op3_url_filter": """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM parts)
""",
    "op8_source_mix": """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
base AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w
  FROM sized GROUP BY source),
fill AS (  -- rounds of resharing: each caps the sources that the level exceeds
  SELECT 0 AS round, source, source_size, w, false AS capped,
         CAST(sum(source_size) OVER () * 3 / 2 AS DOUBLE) / sum(w) OVER () AS level FROM base
  UNION ALL
  SELECT round + 1, source, source_size, w, now_capped,
         (sum(source_size) OVER () * 3 / 2 - coalesce(sum(CASE WHEN now_capped THEN 2 * source_size END) OVER (), 0))
           / CAST(sum(CASE WHEN NOT now_capped THEN w END) OVER () AS DOUBLE)
  FROM (SELECT *, capped OR 2 * source_size <= w * level AS now_capped FROM fill WHERE round < 40)),
goals AS (
  SELECT source, source_size, CASE WHEN capped OR level IS NULL THEN 2.0 * source_size ELSE w * level END AS target FROM fill WHERE round = 40),
rated AS (
  SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN CAST(target AS DOUBLE) / source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('20240229:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0 AS draw
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
""",
    "op11_source_divergence": """
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
said AS (SELECT doc, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM said GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
cells AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS size FROM groups LEFT JOIN cells USING (lang, source) GROUP BY ALL),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS lang_size FROM kept GROUP BY lang),
prices AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2) // (size + 2 * v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (total + 2) // (lang_size + 2 * v) AS q
  FROM sizes JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN cells USING (lang, source, term)),
told AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT p.lang, p.source, o.source AS other, sum((p.p - o.p) * (p.p - o.p) // (p.p + o.p)) AS value
             FROM prices p JOIN prices o ON p.lang = o.lang AND p.term = o.term AND p.source <> o.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM prices WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op12_periodic_runs": """
WITH hashed AS (  -- crc32 of the id's digits, bit by bit
  SELECT doc_id, text, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, d: list_reduce(list_concat([xor(c, d)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE z END)))) AS h
  FROM documents),
original AS (SELECT row_number() OVER () AS doc, doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM hashed),
placed AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM original),
docs AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
words AS (SELECT doc, n, i, CASE WHEN i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS word FROM docs, LATERAL (SELECT unnest(range(n)) AS i)),
matches AS (
  SELECT x.doc, y.i - x.i AS q, x.i AS i, x.i - row_number() OVER (PARTITION BY x.doc, y.i - x.i ORDER BY x.i) AS island
  FROM words x JOIN words y ON x.doc = y.doc AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc, min(i) AS start, count(*) + q AS length, q FROM matches GROUP BY doc, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc, start, length, min(q) AS period FROM stretches GROUP BY doc, start, length),
of_doc AS (
  SELECT doc, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc),
best AS (
  SELECT a.* FROM runs a WHERE NOT EXISTS (
    FROM runs b WHERE a.doc = b.doc AND (b.length * a.period > a.length * b.period
      OR b.length * a.period = a.length * b.period AND (b.start < a.start OR b.start = a.start AND b.period < a.period)))),
gone AS (SELECT DISTINCT doc, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc, i) GROUP BY doc)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN of_doc USING (doc) LEFT JOIN best USING (doc) LEFT JOIN kept USING (doc)
""",
    "op13_odd_sketch_groups": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
""",
}
