"""One query per operator, on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from importlib.resources import files

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shopledger.llm import (
    decontaminate,
    hilbert,
    lexical,
    licenses,
    line_dedup,
    merkle,
    mtree,
    pieces,
    preferences,
    quality,
    repair,
    simhash,
    suffix_dedup,
)
from shopledger.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = preferences.swapped_replies(table(spark, sf_dir, "conversations"))
    pairs = preferences.preference_pairs(chosen, rejected)
    return pairs.withColumns(
        {name: preferences.spans_as_text(F.col(name)) for name in ("chosen_spans", "rejected_spans")}
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known_texts(spark))
    return found.withColumns(
        {name: F.array_join(name, ",") for name in ("text_licenses", "line_licenses")}
    )


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    shards = hilbert.hilbert_shards(documents, ["lang", "source", "n_chars"], n_shards=40)
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(table(spark, sf_dir, "documents"), PIECES)


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_likeness(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), width=200)
    removed = F.aggregate(
        "removed", F.lit(0).cast("long"), lambda n, span: n + span["stop"] - span["start"]
    )
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(
        table(spark, sf_dir, "documents"), threshold=2, min_chars=24, chains=True, scaled=True
    )
    return found.select(
        "doc_id",
        "n_lines",
        "n_removed",
        "n_links",
        F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.nearest(table(spark, sf_dir, "embeddings"), every=50, top=5)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(conversations), conversations)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


QUERIES: dict[str, Query] = {
    "op1_preference_formatting": op1_preference_formatting,
    "op2_license_scan": op2_license_scan,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_merkle_fingerprints": op5_merkle_fingerprints,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_nearest_vectors": op11_nearest_vectors,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ranked_search": op13_ranked_search,
}



def _known_rows() -> str:
    """Digests of the known canonical forms as SQL rows, from a list that is kept by itself."""
    rows = files(__package__).joinpath("known_licenses", "digests.txt").read_text("utf-8").split()
    return ",\n".join(f"('{name}', '{digest}')" for name, digest in zip(rows[::2], rows[1::2]))


# The SQL states the canonical form in its own words: what is dropped, and the spellings.
_SPELLED = """list_reduce([x,
    'licence=license', 'sub license=sublicense', 'organisation=organization',
    'authorisation=authorization', 'acknowledgement=acknowledgment', 'favour=favor',
    'honour=honor', 'fulfilment=fulfillment', 'wilful=willful', 'per cent=percent',
    'non infringement=noninfringement', 'copyright owner=copyright holder', 'https=http'],
    lambda done, pair: replace(done, split_part(pair, '=', 1), split_part(pair, '=', 2)))"""
_HEAD = r"""[^\p{L}\p{N}\n]*((portions|parts)[^\p{L}\p{N}\n]+)?(copyright[^\p{L}\p{N}\n]*(\(c\)|©)|(copyright|\(c\)|©)[^\n]*([0-9][0-9][0-9][0-9]|<year>|\[year\]))"""
_WORDS = r"""list_filter(list_transform(string_split(regexp_replace(array_to_string(list_filter(
    string_split({0}, chr(10)), lambda l: NOT regexp_full_match(l, '[^\p{{L}}\p{{N}}]*all rights reserved[^\p{{L}}\p{{N}}]*')),
    chr(10)), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10)), lambda l: trim(l)), lambda l: l <> '')"""
_LINES_SQL = _WORDS.format(
    rf"""array_to_string(list_filter(string_split(low, chr(10)),
    lambda l: NOT regexp_matches(l, '^{_HEAD}')), chr(10))"""
)
_BLOCKS_SQL = _WORDS.format(
    rf"""array_to_string(list_transform(regexp_split_to_array(low, '\n[^\p{{L}}\p{{N}}\n]*\n'),
    lambda p: regexp_replace(p, '(?ms)^{_HEAD}.*', '')), chr(10))"""
)

# DuckDB twins, where SQL can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op1_preference_formatting": """
WITH replies AS (
  SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM conversations
  WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS k,
    count(*) OVER (PARTITION BY conv_id) AS n FROM replies
), picked AS (
  SELECT conv_id, turn AS swap_turn, text AS reply FROM ranked WHERE k = ((conv_id % n) + n) % n
), paired AS (
  SELECT conv_id, swap_turn, coalesce(lead(reply) OVER (ORDER BY conv_id),
    first_value(reply) OVER (ORDER BY conv_id)) AS swapped FROM picked
), rows AS (
  SELECT c.conv_id AS pair_id, 0 AS side, c.turn, c.role, c.text
  FROM conversations c JOIN paired p USING (conv_id)
  UNION ALL
  SELECT c.conv_id, 1, c.turn, c.role, c.text
  FROM conversations c JOIN paired p USING (conv_id) WHERE c.turn < p.swap_turn OR c.turn IS NULL
  UNION ALL
  SELECT conv_id, 1, swap_turn, 'assistant', swapped FROM paired
), clean AS (
  SELECT DISTINCT pair_id, side, turn, coalesce(role, 'unknown') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text FROM rows
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS k
  FROM clean
), compared AS (
  SELECT a.pair_id, a.k, b.k IS NOT NULL AND a.role = b.role AND a.text = b.text AS same
  FROM (SELECT * FROM numbered WHERE side = 0) a
  LEFT JOIN (SELECT * FROM numbered WHERE side = 1) b ON a.pair_id = b.pair_id AND a.k = b.k
), prefix AS (
  SELECT pair_id, coalesce(min(k) FILTER (WHERE NOT same) - 1, max(k)) AS n
  FROM compared GROUP BY pair_id
), rendered AS (
  SELECT n.pair_id, side, k, p.n, role, '<|' || role || '|>' || chr(10) AS head,
    n.text || '<|end|>' || chr(10) AS body
  FROM numbered n JOIN prefix p USING (pair_id)
), placed AS (
  SELECT *, CASE WHEN k > n THEN coalesce(sum(CASE WHEN k > n THEN length(head) + length(body)
    ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) END AS start
  FROM rendered
)
SELECT pair_id, CAST(any_value(n) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 0 AND k <= n), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 0 AND k > n), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE side = 1 AND k > n), '') AS rejected,
  coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' ||
    CAST(CAST(start AS BIGINT) + length(body) AS VARCHAR), ',' ORDER BY k)
    FILTER (WHERE side = 0 AND k > n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' ||
    CAST(CAST(start AS BIGINT) + length(body) AS VARCHAR), ',' ORDER BY k)
    FILTER (WHERE side = 1 AND k > n AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY pair_id""",
    "op2_license_scan": f"""
WITH forms(license_id, digest) AS (VALUES {_known_rows()}),
d AS (
  SELECT doc_id, {_LINES_SQL} AS lines,
    CASE WHEN regexp_matches(low, '(?m)^{_HEAD}') THEN {_BLOCKS_SQL} END AS blocks
  FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)
), units AS (
  SELECT doc_id, true AS whole, array_to_string(lines, ' ') AS x FROM d WHERE len(lines) > 0
  UNION ALL
  SELECT doc_id, true, array_to_string(blocks, ' ') FROM d WHERE len(lines) > 0 AND len(blocks) > 0
  UNION ALL
  SELECT doc_id, false, unnest(lines) FROM d
), found AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id)
      FILTER (WHERE whole) AS t,
    string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (WHERE NOT whole) AS l,
    count(*) FILTER (WHERE NOT whole) AS n
  FROM (SELECT doc_id, whole, sha256({_SPELLED}) AS digest FROM units) JOIN forms USING (digest)
  GROUP BY doc_id
)
SELECT DISTINCT d.doc_id, coalesce(t, '') AS text_licenses, coalesce(l, '') AS line_licenses,
  CAST(coalesce(n, 0) AS BIGINT) AS n_lines
FROM d LEFT JOIN found USING (doc_id)""",
    "op8_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (
  SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p:p + 9], ' ') AS win FROM starts
), sizes AS (
  SELECT DISTINCT n FROM bw
), places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM places
), found AS (
  SELECT doc_id, p, n, item FROM dw JOIN bw USING (n, win)
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS word FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_nearest_vectors": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND
    len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 5""",
    "op12_conversation_repair": r"""
WITH RECURSIVE byte_sums AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS sums
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
      coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS name
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, name), lambda c, b:
    xor(c >> 8, sums[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS kind
  FROM named, byte_sums
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds WHERE kind <> 0
  UNION ALL
  SELECT conv_id, turn, role, text FROM kinds WHERE kind = 3
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM damaged
), turns AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
  FROM placed
), counted AS (
  SELECT conv_id, max(k) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
), paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k,
    [{'cost': CAST(0 AS BIGINT), 'audit': '', 'st': '', 'made': CAST([] AS VARCHAR[])}] AS ways
  FROM counted
  UNION ALL
  SELECT t.conv_id, t.k, list_filter(list_transform(['', 's', 'u', 'a'], lambda x: list_sort(list_filter(
    flatten(list_transform(flatten(list_transform(ways, lambda p: [p,
      {'cost': p.cost + 3, 'audit': p.audit || 'I', 'st': CASE p.st WHEN 'u' THEN 'a' ELSE 'u' END,
       'made': list_append(p.made, CASE p.st WHEN 'u' THEN 'assistant:' ELSE 'user:' END)},
      {'cost': p.cost + 6, 'audit': p.audit || 'II', 'st': CASE p.st WHEN 'u' THEN 'u' ELSE 'a' END,
       'made': list_concat(p.made, CASE p.st WHEN 'u' THEN ['assistant:', 'user:']
         ELSE ['user:', 'assistant:'] END)}])),
    lambda q: [
      {'cost': q.cost + 4, 'audit': q.audit || 'D', 'st': q.st, 'made': q.made},
      CASE WHEN fault NOT IN ('blank', 'duplicate') AND (left(role, 1) = 's' AND q.st = ''
          OR left(role, 1) = 'u' AND q.st <> 'u' OR left(role, 1) = 'a' AND q.st = 'u') THEN
        {'cost': q.cost + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'audit': q.audit || 'K',
         'st': left(role, 1), 'made': list_append(q.made, role || ':' || text)} END,
      CASE WHEN fault NOT IN ('blank', 'duplicate') THEN
        {'cost': q.cost + CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'audit': q.audit || 'R',
         'st': CASE q.st WHEN 'u' THEN 'a' ELSE 'u' END, 'made': list_append(q.made,
           CASE q.st WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text)} END])),
    lambda c: c IS NOT NULL AND c.st = x))[1]), lambda w: w IS NOT NULL)
  FROM paths p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.k = p.k + 1
), ended AS (
  SELECT c.*, list_sort(list_filter(flatten(list_transform(ways, lambda p: [p,
      {'cost': p.cost + 3, 'audit': p.audit || 'I', 'st': CASE p.st WHEN 'u' THEN 'a' ELSE 'u' END,
       'made': list_append(p.made, CASE p.st WHEN 'u' THEN 'assistant:' ELSE 'user:' END)},
      {'cost': p.cost + 6, 'audit': p.audit || 'II', 'st': CASE p.st WHEN 'u' THEN 'u' ELSE 'a' END,
       'made': list_concat(p.made, CASE p.st WHEN 'u' THEN ['assistant:', 'user:']
         ELSE ['user:', 'assistant:'] END)}])), lambda w: w.st IN ('', 'a')))[1] AS way
  FROM counted c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.k = c.n
)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps,
  CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(way.cost, 0) AS cost,
  coalesce(way.audit, '') AS audit,
  sha256(coalesce(array_to_string(way.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id""",
    "op13_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), total AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), items AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), asked AS (
  SELECT item, unnest(w) AS term FROM items
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf SEMI JOIN asked USING (term) CROSS JOIN total GROUP BY term, n_docs
), lengths AS (
  SELECT r, doc_id, 100 - 90 + (90 * len(w) * n_docs) // n_words AS m FROM d CROSS JOIN total
  WHERE len(w) > 0
), scores AS (
  SELECT item, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (r)
  GROUP BY item, doc_id, r
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM placed JOIN items USING (item) WHERE rank <= 10""",
}
