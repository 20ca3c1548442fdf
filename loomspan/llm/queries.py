"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.chat_format import chat_digests, format_chat
from loomspan.llm.conversation_repair import NOTHING, repaired_digests, repairs
from loomspan.llm.decontaminate import contaminated
from loomspan.llm.embedding_dedup import embedding_links
from loomspan.llm.html_text import extract_text
from loomspan.llm.kd_shards import kd_shards
from loomspan.llm.near_dedup import near_duplicates
from loomspan.llm.packing import pack
from loomspan.llm.prefix_trie import conversation_paths, prefix_trie
from loomspan.llm.quality import quality
from loomspan.llm.substring_dedup import without_repeated_windows
from loomspan.llm.suffix_dedup import without_earlier_strings
from loomspan.llm.url_filter import Rule, judge_urls
from loomspan.session import scratch, table

URL_RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept at a Jaccard similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict. The cascade learns the keys of the corpus that the rules block and gives the verdicts."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP4_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, rule_host, rule_path, rule_verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit f USING (page_id)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 by the law `bytes`, with gapless slots."""
    out = kd_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and how they match, for every document that holds a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for strings of 100 bytes."""
    return without_earlier_strings(table(spark, sf_dir, "documents")).drop("kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for windows of 35 words."""
    return without_repeated_windows(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept at a cosine of 0.95."""
    return embedding_links(table(spark, sf_dir, "embeddings"))


HOSTILE = "\\### Assistant: </turn> ok"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, legal of every conversation and of number -7, which holds the template's own marks."""
    hostile = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chat(turns.unionByName(hostile)))


OP11_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN '### ' || upper(role[1]) || role[2:] || ': '
                 ELSE '### Role: ' || regexp_replace(role, '(\\|### Assistant: |### System: |### Role: |### User: |</role>|</turn>)', '\\\1', 'g') || '</role>' END
            || regexp_replace(text, '(\\|### Assistant: |### System: |### Role: |### User: |</role>|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS formatted
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text), '(system,)?user,assistant(,user,assistant)*') AS legal
FROM e GROUP BY conv_id
"""


CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def rebuilt_paths(paths: DataFrame) -> DataFrame:
    """paths (conv_id, path) whose first turns, crc32 of the id modulo 6 of them, are those of the hundred's first conversation, if there is one."""
    own = paths.select("conv_id", "path", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int").alias("h"))
    bases = paths.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, 5).alias("lead"))
    lead = F.when(F.col("lead").isNull(), F.slice("path", 1, 0)).otherwise(F.slice("lead", F.lit(1), F.col("h")))
    rest = F.when(F.size("path") > F.col("h"), F.slice("path", F.col("h") + 1, F.size("path"))).otherwise(F.slice("path", 1, 0))
    return own.join(bases, "base", "left").select("conv_id", F.concat(lead, rest).alias("path"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie(rebuilt_paths(conversation_paths(table(spark, sf_dir, "conversations"))))


OP12_SQL = (
    """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id AS c, h % 6 AS h FROM (SELECT conv_id, CRC AS h FROM (SELECT DISTINCT conv_id FROM t))),
r AS (
  SELECT c, k, role, text FROM ids JOIN t ON conv_id = c - c % 100 WHERE k <= h
  UNION ALL SELECT c, k, role, text FROM ids JOIN t ON conv_id = c WHERE k > h),
d AS (
  SELECT c, row_number() OVER w AS depth, length(text) AS chars, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY c ORDER BY k)),
p AS (SELECT c, depth, chars, path FROM d UNION ALL SELECT c, 0, 0, '' FROM ids),
ends AS (SELECT path, sha256(string_agg(c, ',' ORDER BY c)) AS ids FROM (SELECT c, max(path) AS path FROM p GROUP BY c) GROUP BY path),
n AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY path, depth),
kids AS (SELECT path[:-65] AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
sub AS (
  SELECT path[:64 * u] AS path, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT n.*, kids.n IS NULL AS leaf, unnest(range(depth + 1)) AS u FROM n LEFT JOIN kids USING (path)) GROUP BY 1)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       coalesce(ids, sha256('')) AS ends_sha256
FROM n JOIN sub USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path) LEFT JOIN n up ON n.depth > 0 AND up.path = n.path[:-65]
"""
).replace("CRC", CRC32.format("conv_id::VARCHAR"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with every null role and text one space, and a twentieth each of the turns lost, emptied, without full stops, repeated and said by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    with scratch(spark) as keep:
        report, repaired = repairs(damaged(turns))
        every = turns.select("conv_id").distinct()
        same = lambda other: every["conv_id"].eqNullSafe(other["conv_id"])
        digests = repaired_digests(repaired)
        numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        found = every.join(report, same(report), "left").join(digests, same(digests), "left")
        out = found.select(every["conv_id"], *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
        return keep(out, "repair")


OP13_SQL = (
    r"""
WITH RECURSIVE closure(s, mid, c, a, said) AS (VALUES
  (0, 0, 0, '', ''), (0, 2, 5, 'I', '|user:'), (0, 3, 10, 'II', '|user:|assistant:'), (1, 1, 0, '', ''), (1, 2, 5, 'I', '|user:'), (1, 3, 10, 'II', '|user:|assistant:'),
  (2, 2, 0, '', ''), (2, 3, 5, 'I', '|assistant:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', '|user:')),
edit(mid, initial, goal, c, a, role) AS (VALUES
  (0, NULL, 0, 2, 'D', NULL), (1, NULL, 1, 2, 'D', NULL), (2, NULL, 2, 2, 'D', NULL), (3, NULL, 3, 2, 'D', NULL),
  (0, NULL, 2, 1, 'R', 'user'), (1, NULL, 2, 1, 'R', 'user'), (2, NULL, 3, 1, 'R', 'assistant'), (3, NULL, 2, 1, 'R', 'user'),
  (0, 's', 1, 0, 'K', NULL), (0, 'u', 2, 0, 'K', NULL), (1, 'u', 2, 0, 'K', NULL), (2, 'a', 3, 0, 'K', NULL), (3, 'u', 2, 0, 'K', NULL)),
fated AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS fate FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated)),
x AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k0) AS k, role[1] AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k0) > 1 THEN 'd'
              WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '' ELSE 't' END AS fault
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k0 FROM hurt)),
dp AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS s, '000000' AS best, '' AS said FROM x GROUP BY conv_id
  UNION ALL
  SELECT conv_id, k, goal, min(best), arg_min(said, best) FROM (
    SELECT x.conv_id, x.k, e.goal, lpad((dp.best[:6]::BIGINT + c.c + e.c + CASE WHEN e.a <> 'D' AND x.fault = 't' THEN 5 ELSE 0 END)::VARCHAR, 6, '0') || dp.best[7:] || c.a || e.a AS best,
           dp.said || replace(c.said, '|', chr(10)) || CASE e.a WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || e.role || ':' || x.text ELSE chr(10) || x.role || ':' || x.text END AS said
    FROM dp JOIN x ON x.conv_id IS NOT DISTINCT FROM dp.conv_id AND x.k = dp.k + 1 JOIN closure c ON c.s = dp.s
         JOIN edit e ON e.mid = c.mid AND (e.a = 'D' OR x.fault IN ('', 't')) AND (e.initial IS NULL OR e.initial = x.initial))
  GROUP BY conv_id, k, goal),
ends AS (
  SELECT dp.conv_id, lpad((best[:6]::BIGINT + c.c)::VARCHAR, 6, '0') || best[7:] || c.a AS best, dp.said || replace(c.said, '|', chr(10)) AS said
  FROM (SELECT conv_id, max(k) AS k FROM x GROUP BY conv_id) n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.k = n.k JOIN closure c ON c.s = dp.s AND c.mid IN (0, 3)),
done AS (SELECT conv_id, min(best) AS best, arg_min(said, best) AS said FROM ends GROUP BY conv_id),
pairs AS (SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY k) AS pair FROM x),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated FROM x GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       (SELECT count(*) FROM pairs p WHERE p.conv_id IS NOT DISTINCT FROM o.conv_id AND pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
       coalesce(best[:6]::BIGINT, 0) AS cost, coalesce(best[7:], '') AS audit, sha256(coalesce(said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""
).replace("CRC", CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_near_dedup": op3_near_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op4_url_filter": OP4_SQL,
    "op11_chat_formatting": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
