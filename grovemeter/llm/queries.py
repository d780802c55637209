"""The numbered queries of the training-data operators, and their SQL forms for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemeter.llm import (
    bpe,
    exact_dedup,
    filter_audit,
    hmm,
    html_text,
    language_id,
    line_dedup,
    merkle,
    mixing,
    near_dedup,
    packing,
    token_align,
    url_filter,
)
from grovemeter.llm.common import table

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), width=2)


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.clean_lines(table(spark, folder, "documents"))
    text = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "n_deleted", F.char_length(text).cast("long").alias("n_left"), F.sha2(text, 256).alias("text_sha256"))


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"))


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


def bpe_codes(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest_codes(table(spark, folder, "documents"), BPE_FILE)


def language(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"), PIECES_FILE)


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("doc_id", "size", "source_size", "target", "taken")
    return mixing.mix(table(spark, folder, "documents")).select(*columns)


def hmm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score(table(spark, folder, "documents"))


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.compare_with_edits(table(spark, folder, "documents"))


def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), WORDS_FILE, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_align.token_alignment(table(spark, folder, "documents"), RANKS_FILE, PIECES_FILE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": near_duplicates,
        "op2_clean_lines": clean_lines,
        "op3_url_verdicts": url_verdicts,
        "op4_page_texts": page_texts,
        "op5_bpe_codes": bpe_codes,
        "op6_language": language,
        "op7_source_mix": source_mix,
        "op8_hmm_scores": hmm_scores,
        "op9_exact_duplicates": exact_duplicates,
        "op10_merkle_fingerprints": merkle_fingerprints,
        "op11_packed_sequences": packed_sequences,
        "op12_filter_interactions": filter_interactions,
        "op13_token_alignment": token_alignment,
    }


NEAR_DUPLICATES = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM tokens
), texts AS (
  SELECT s, list_sort(s) AS k, min(doc_id) AS node FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s
), grams AS MATERIALIZED (
  SELECT node, len(s) AS n, unnest(s) AS g FROM texts
), pairs AS (
  SELECT a.node AS x, b.node AS y FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS MATERIALIZED (
  SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reach AS (
  SELECT node AS x, node AS y FROM texts UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), classes AS (
  SELECT x AS node, min(y) AS component FROM reach GROUP BY x
)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.component, d.doc_id) AS kept
FROM sets d LEFT JOIN texts t ON list_sort(d.s) = t.s LEFT JOIN classes c ON t.node = c.node
"""

#: Lines of 25 words, windows of 24 lines, 23 words beyond each end, runs of 30 words.
CLEAN_LINES = r"""
WITH whole AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS pieces
  FROM documents
), split AS MATERIALIZED (
  SELECT doc_id, generate_subscripts(pieces, 1) - 1 AS pos, regexp_replace(unnest(pieces), '^[\x20\x09-\x0D]+', '') AS word FROM whole
), value AS (
  SELECT word, list_reduce(list_prepend(0::HUGEINT, list_reverse(list_transform(regexp_extract_all(hex(word), '..'),
    lambda p: ('0x' || p)::BIGINT::HUGEINT))), lambda h, c: (h + c) * 2685821657736338717 % 18446744073709551616) // 4294967296 AS v
  FROM (SELECT DISTINCT word FROM split)
), word AS MATERIALIZED (
  SELECT doc_id, pos, word, v::BIGINT AS v FROM split JOIN value USING (word)
), line AS (
  SELECT doc_id, pos, list(word) OVER ahead AS line,
    (2 * (sum(v * pos) OVER ahead - pos * sum(v) OVER ahead) + sum(v) OVER ahead) * 1000003 % 2147483647 AS h,
    count(*) OVER ahead AS n
  FROM word WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)
), ordered AS (
  SELECT doc_id, pos, h * 4294967296 + 4294967295 - pos AS h, max(pos) OVER (PARTITION BY doc_id) AS last
  FROM line WHERE n = 25
), picked AS (
  SELECT DISTINCT doc_id, (4294967295 - least_h % 4294967296)::BIGINT AS pos FROM (
    SELECT doc_id, pos, last, min(h) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS least_h
    FROM ordered)
  WHERE pos + 23 <= last OR pos = 0
), placed AS (
  SELECT doc_id, pos, first_value(doc_id) OVER same AS first_doc, first_value(pos) OVER same AS first_at
  FROM picked JOIN line USING (doc_id, pos) WINDOW same AS (PARTITION BY line ORDER BY doc_id, pos)
), later AS (
  SELECT *, coalesce((pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 25)::INT, 1) AS opens
  FROM placed WHERE (doc_id, pos) <> (first_doc, first_at)
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM later
), runs AS (
  SELECT doc_id, run, min(pos) AS head, max(pos) + 25 AS tail,
    arg_min(first_doc, pos) AS head_doc, arg_min(first_at, pos) AS head_at,
    arg_max(first_doc, pos) AS tail_doc, arg_max(first_at, pos) + 25 AS tail_at
  FROM numbered GROUP BY doc_id, run
), step AS (
  SELECT unnest(range(1, 24)) AS t
), lefts AS (
  SELECT r.doc_id, r.run, min(t) - 1 AS n FROM runs r CROSS JOIN step
  LEFT JOIN word a ON a.doc_id = r.doc_id AND a.pos = r.head - t
  LEFT JOIN word b ON b.doc_id = r.head_doc AND b.pos = r.head_at - t
  WHERE (a.word = b.word) IS NOT TRUE GROUP BY r.doc_id, r.run
), rights AS (
  SELECT r.doc_id, r.run, min(t) - 1 AS n FROM runs r CROSS JOIN step
  LEFT JOIN word a ON a.doc_id = r.doc_id AND a.pos = r.tail + t - 1
  LEFT JOIN word b ON b.doc_id = r.tail_doc AND b.pos = r.tail_at + t - 1
  WHERE (a.word = b.word) IS NOT TRUE GROUP BY r.doc_id, r.run
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(head - coalesce(l.n, 23), tail + coalesce(x.n, 23))) AS pos
  FROM runs r LEFT JOIN lefts l USING (doc_id, run) LEFT JOIN rights x USING (doc_id, run)
), gone AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, run) AS n FROM (
      SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM covered))
  WHERE n >= 30
), deleted AS (
  SELECT doc_id, list(pos + 1) AS gone FROM gone GROUP BY doc_id
), cleaned AS (
  SELECT w.doc_id, coalesce(len(gone), 0) AS n_deleted,
    CASE WHEN gone IS NULL THEN text ELSE
      array_to_string(list_transform(list_filter(range(1, len(pieces) + 1), lambda i: NOT list_contains(gone, i)), lambda i: pieces[i]), '')
      || regexp_extract(text, '[\x20\x09-\x0D]*$') END AS left_text
  FROM whole w LEFT JOIN deleted d USING (doc_id)
)
SELECT doc_id, n_deleted, length(left_text) AS n_left, sha256(left_text) AS text_sha256 FROM cleaned
"""

SOURCE_MIX = r"""
WITH sizes AS (
  SELECT doc_id, source, text,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size
  FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / (0.5 + coalesce(length(regexp_replace(text, '[^\p{L} ]', '', 'g')) / nullif(length(text), 0), 0)) AS key
  FROM sizes
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM keyed GROUP BY source
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(2 * sum(source_size) OVER below, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
  FROM sources
  WINDOW below AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
    least(2.0 * source_size, weight * (SELECT max(level) FROM levels))::DOUBLE AS goal
  FROM sources
), budgets AS (
  SELECT source, source_size, round(goal, 6) AS target, CASE WHEN source_size > 0 THEN floor(goal / source_size) ELSE 0 END AS epochs
  FROM targets
), summed AS (
  SELECT k.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS total
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
), gaps AS (
  SELECT *, rest - coalesce(max(CASE WHEN total <= rest AND size > 0 THEN total END) OVER (PARTITION BY source), 0) AS gap FROM summed
), extra AS (
  SELECT source, arg_min(total, {'off': abs(gap - size), 'total': total}) AS total
  FROM gaps WHERE total > rest AND size > 0 AND abs(gap - size) < gap GROUP BY source
)
SELECT g.doc_id, g.size, g.source_size, g.target,
  CASE WHEN g.size = 0 THEN 0
       ELSE g.size * (g.epochs + (g.total <= g.rest)::INT + coalesce((g.total = e.total)::INT, 0)) END::BIGINT AS taken
FROM gaps g LEFT JOIN extra e ON g.source IS NOT DISTINCT FROM e.source
"""

EXACT_DUPLICATES = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY norm)
"""

def _leaf_nodes(text: str) -> str:
    """For each section and paragraph of ``text`` the SHA-256 of its leaves."""
    marked = f"list_transform(regexp_extract_all(p, '{merkle.PIECE}'), lambda w: CASE WHEN md5(w) < '4' THEN w || chr(10) ELSE w END)"
    leaves = f"list_transform(regexp_extract_all(array_to_string({marked}, ''), '{merkle.LEAF}'), lambda leaf: sha256(leaf))"
    sections = f"list_transform(string_split(s, chr(10)), lambda p: {leaves})"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {sections})"


def _root(nodes: str) -> str:
    """The root above leaf nodes."""
    parts = "list_transform(s, lambda p: sha256('paragraph:' || array_to_string(p, ',')))"
    sections = f"list_transform({nodes}, lambda s: sha256('section:' || array_to_string({parts}, ',')))"
    return f"sha256('root:' || array_to_string({sections}, ','))"


MERKLE_FINGERPRINTS = rf"""
WITH whole AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), followed AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id),
                                first_value(text) OVER (ORDER BY doc_id)) AS next_text
  FROM whole
), edits AS (
  SELECT *, left(text, (length(text) - length(text) // 4)::BIGINT) || left(next_text, (length(text) // 4)::BIGINT) AS edited
  FROM followed
), nodes AS (
  SELECT doc_id, text, edited, {_leaf_nodes("text")} AS own_nodes, {_leaf_nodes("edited")} AS edited_nodes
  FROM edits
), trees AS (
  SELECT doc_id, text, edited, {_root("own_nodes")} AS fingerprint, {_root("edited_nodes")} AS edited_fingerprint,
    list_distinct(flatten(flatten(own_nodes))) AS leaves, list_distinct(flatten(flatten(edited_nodes))) AS edited_leaves
  FROM nodes
), pairs AS (
  SELECT *, coalesce(lead(fingerprint) OVER (ORDER BY doc_id), first_value(fingerprint) OVER (ORDER BY doc_id)) AS next_fingerprint,
    coalesce(lead(leaves) OVER (ORDER BY doc_id), first_value(leaves) OVER (ORDER BY doc_id)) AS next_leaves
  FROM trees
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE WHEN len(leaves) + len(edited_leaves) = 0 THEN 0.0::DOUBLE
       ELSE 2.0::DOUBLE * len(list_intersect(leaves, edited_leaves)) / (len(leaves) + len(edited_leaves)) END AS near_edited,
  CASE WHEN fingerprint = next_fingerprint THEN 1.0::DOUBLE WHEN len(leaves) + len(next_leaves) = 0 THEN 0.0::DOUBLE
       ELSE 2.0::DOUBLE * len(list_intersect(leaves, next_leaves)) / (len(leaves) + len(next_leaves)) END AS near_next
FROM pairs
"""

FILTER_INTERACTIONS = r"""
WITH RECURSIVE whole AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), failing AS (
  SELECT doc_id, part,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM whole
), labelled AS (
  SELECT f.*, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM failing f LEFT JOIN (
    SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
  ) l USING (doc_id)
), orders AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS letters(f) WHERE NOT contains(filter_order, f)
), steps AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS filter,
    list_transform(string_split(left(filter_order, step - 1), ''), lambda c: ascii(c) - 64) AS before
  FROM orders, range(1, 6) AS numbers(step) WHERE length(filter_order) = 5
), patterns AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM labelled GROUP BY part, fails
), judged AS (
  SELECT p.part, filter_order, step, filter, n, good, toxic, fails[ascii(filter) - 64] AS failed,
    step > 1 AND len(list_filter(before, lambda b: b > 0 AND fails[b])) > 0 AS gone,
    len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM patterns p, steps
), counted AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND failed), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND failed), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failed), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND failed), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": NEAR_DUPLICATES,
        "op2_clean_lines": CLEAN_LINES,
        "op7_source_mix": SOURCE_MIX,
        "op9_exact_duplicates": EXACT_DUPLICATES,
        "op10_merkle_fingerprints": MERKLE_FINGERPRINTS,
        "op12_filter_interactions": FILTER_INTERACTIONS,
    }
