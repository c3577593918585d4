"""One query per operator over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_filters, chat, hash_index, html_text, merkle, mixing, packing, prefix_trie, private_data, quality, repeats, shingle_join, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: fixed value: the text of the two turns that the chat query adds
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op4_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(turns.unionByName(added)))


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, tokenizer_path()))


@query
def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mixed_sizes(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op7_previous_factors(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op3_cap_filters(spark: SparkSession, folder: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, folder, "embeddings"))


@query
def op2_host_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query
def op1_weak_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, folder, "labels").select("doc_id", "toxic"))


@query
def op6_context_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return private_data.report(private_data.find(table(spark, folder, "documents").select("doc_id", "text")))


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, folder, "conversations")))


@query
def op12_hash_index(spark: SparkSession, folder: str) -> DataFrame:
    return hash_index.duplicates(table(spark, folder, "documents").select("doc_id", "text")).drop("chain")


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tampering_report(table(spark, folder, "documents"))


_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

ORACLES["op10_quality_rules"] = rf"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text='text')} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
marked AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1 AS again FROM windows),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM marked, (VALUES (0), (1), (2)) s(j) WHERE again GROUP BY doc_id),
counted AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop
  FROM split s LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 20.0 AND n_symbols::DOUBLE / n_words <= 0.3
    AND n_stop::DOUBLE / n_words >= 0.05 AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.5 AS kept FROM judged"""

ORACLES["op9_shingle_join"] = rf"""
WITH RECURSIVE split AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4
    THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, (SELECT min(y) FROM reached r WHERE r.x = d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)"""

#: unsigned crc32 of the decimal form of a column, bit by bit
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}::VARCHAR, ''),
    lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_prefix_trie"] = f"""
WITH own AS (SELECT conv_id, list({{'d': sha256(strlen(r) || ':' || r || t), 'n': strlen(t)}} ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
sized AS (SELECT *, ({_CRC32.format('conv_id')} % 9)::INT AS h FROM own),
whole AS (SELECT s.conv_id, list_concat(coalesce(f.turns, [])[1:h], s.turns[h + 1:]) AS turns
  FROM sized s LEFT JOIN own f ON f.conv_id = s.conv_id - s.conv_id % 5),
members AS (SELECT conv_id, len(turns) AS l, turns[d].n AS n, list_transform(turns, lambda t: t.d)[1:d] AS path, d
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * any_value(n) END AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = d), '')) AS ends_sha256 FROM members GROUP BY path, d),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.k, 0) AS n_children FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
  LEFT JOIN (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL) c ON c.d = n.d AND c.path = n.path),
below AS (SELECT path[1:u] AS path, u AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM linked) GROUP BY ALL)
SELECT conv_id, n.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM linked n JOIN below b ON b.d = n.d AND b.path = n.path"""

ORACLES["op12_hash_index"] = f"""
WITH normal AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
    sha256(t) AS text_sha256 FROM normal WINDOW same AS (PARTITION BY t)"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in (*merkle.FIELDS[:-1], text)) + ")"


ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (SELECT doc_id, lang, {_leaf('text')} AS leaf,
    CASE WHEN {_CRC32.format('doc_id')} % 3 = 0 THEN {_leaf(_LOWER.format('text'))} END AS changed FROM documents),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes(tree, lvl, idx, digest, width) AS (SELECT tree, 0, pos, leaf, n FROM leaves UNION ALL
    SELECT tree, lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value((width + 7) // 8) FROM nodes WHERE width > 1 GROUP BY tree, lvl, idx // 8),
subroots AS (SELECT tree, digest, count(*) OVER () AS n FROM nodes WHERE width = 1),
above(lvl, idx, digest, width) AS (SELECT 0, tree, digest, n FROM subroots UNION ALL
    SELECT lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value((width + 7) // 8) FROM above WHERE width > 1 GROUP BY lvl, idx // 8),
beside AS (SELECT tree, pos, 0 AS part, s.lvl, s.idx > pos >> (3 * s.lvl) AS after, s.idx, s.digest FROM leaves l JOIN nodes s USING (tree)
    WHERE s.width > 1 AND s.idx >> 3 = pos >> (3 * s.lvl + 3) AND s.idx <> pos >> (3 * s.lvl)
  UNION ALL SELECT tree, pos, 1, s.lvl, s.idx > tree >> (3 * s.lvl), s.idx, s.digest FROM leaves l JOIN above s
    ON s.width > 1 AND s.idx >> 3 = tree >> (3 * s.lvl + 3) AND s.idx <> tree >> (3 * s.lvl)),
around AS (SELECT tree, pos, part, lvl, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT after), '') AS a,
    coalesce(string_agg(digest, '' ORDER BY idx) FILTER (after), '') AS b FROM beside GROUP BY ALL),
levels AS (SELECT DISTINCT tree, pos, 0 AS part, lvl FROM leaves JOIN nodes USING (tree) WHERE width > 1
  UNION ALL SELECT DISTINCT tree, pos, 1, lvl FROM leaves, above WHERE width > 1),
paths AS (SELECT tree, pos, string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY part, lvl) AS proof,
    list(coalesce(a, '') || '|' || coalesce(b, '') ORDER BY part, lvl) AS steps FROM levels LEFT JOIN around USING (tree, pos, part, lvl) GROUP BY ALL),
found AS (SELECT l.*, s.digest AS subroot, (SELECT digest FROM above WHERE width = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(changed, leaf), coalesce(steps, [])),
        lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots s USING (tree) LEFT JOIN paths USING (tree, pos))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM found"""
