"""SQL that gives the same rows as the queries, for DuckDB over the same tables.

RE2 has no look-around and its ``\\b`` is ASCII: guards are consumed instead, or accented letters are
replaced by a plain one first.
"""

from __future__ import annotations

from tidemark.functions import fixed_values as fixed

from .queries import ALL_POSTS, CATEGORIES, COPIES, INTENSIFIERS, NEGATORS, PER_PERIOD, SALT, VALENCE

ORACLES: dict[str, str] = {}

SPACES = r"[\s\v\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
VISIBLE = SPACES.replace("[", "[^", 1)
ACCENTED = r"[\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{BC}-\x{BE}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"


def text_list(values) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def with_posts(body: str, more: str = "") -> str:
    """The post view and the period of each post, then the query."""
    return f"""
WITH posts AS (
  SELECT source || ':' || doc_id AS post_id, text, source, lang AS author_hash, doc_id, lang,
         TIMESTAMP '2021-06-01' + to_days(CAST(doc_id * 37 % 1000 AS INTEGER)) AS created_at
  FROM documents),
dated AS (SELECT *, CASE WHEN created_at >= TIMESTAMP '2022-10-27' THEN 'post' ELSE 'pre' END AS period FROM posts),
labelled AS (SELECT d.*, l.quality, l.toxic FROM dated d JOIN labels l USING (doc_id)){more}
{body}"""


def r6(expression: str, alias: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {alias}"


# --- text expressions -----------------------------------------------------------------------


def masked(t: str) -> str:
    handles = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_@])@[\p{{L}}\p{{N}}_]{{1,30}}', '\1@user', 'g')"
    return rf"regexp_replace({handles}, '(?i)(?:https?://|www\.){VISIBLE}+', 'http', 'g')"


def light(t: str) -> str:
    decoded = f"replace(replace(replace({masked(t)}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    return f"trim(regexp_replace({decoded}, '{SPACES}+', ' ', 'g'))"


def tokens(t: str) -> str:
    found = f"regexp_extract_all(lower({light(t)}), {quoted(fixed.TOPIC_TOKEN_PATTERN)})"
    return f"list_filter({found}, lambda w: w NOT IN ({text_list(fixed.STOP_WORDS)}))"


def key(t: str) -> str:
    return rf"trim(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def hint_hits(t: str) -> str:
    found = f"regexp_extract_all({t}, '[A-Za-z'']+')"
    return f"len(list_filter({found}, lambda w: lower(w) IN ({text_list(fixed.ENGLISH_HINTS)})))"


def english(t: str, hits: int = 1) -> str:
    letters = rf"length(regexp_replace({t}, '[^\p{{L}}]+', '', 'g'))"
    plain = f"length(regexp_replace({t}, '[^A-Za-z]+', '', 'g'))"
    return f"({letters} > 0 AND {plain} * 10 >= {letters} * 8 AND {hint_hits(t)} >= {hits})"


def spam(t: str) -> str:
    plain = f"regexp_replace({t}, '{ACCENTED}', 'z', 'g')"
    hits = " OR ".join(f"regexp_matches({plain}, {quoted('(?i)' + p)})" for p in fixed.SPAM_PATTERNS)
    hashes = f"length({t}) - length(replace({t}, '#', '')) >= {fixed.SPAM_HASHTAGS}"
    links = f"length(lower({t})) - length(replace(lower({t}), 'http', '')) >= {4 * fixed.SPAM_LINKS}"
    return f"({hits} OR {hashes} OR {links})"


def category_pattern(patterns) -> str:
    return quoted(r"(?i)\b(?:" + "|".join(patterns) + r")\b")


def category_hits(t: str, categories) -> dict[str, str]:
    plain = f"regexp_replace({t}, '{ACCENTED}', 'z', 'g')"
    return {name: f"regexp_matches({plain}, {category_pattern(p)})" for name, p in categories.items()}


def flagged(t: str, categories=CATEGORIES) -> str:
    return "(" + " OR ".join(category_hits(t, categories).values()) + ")"


def category_names(t: str, categories=CATEGORIES) -> str:
    cases = ", ".join(f"CASE WHEN {hit} THEN '{name}' END" for name, hit in category_hits(t, categories).items())
    return f"concat_ws(';', {cases})"


def naive(t: str) -> str:
    return "(" + " OR ".join(f"contains(lower({t}), '{term}')" for term in fixed.BASELINE_TERMS) + ")"


def compound_ctes(source: str, t: str, valence, negators, intensifiers) -> str:
    """``scored``: the rows of ``source`` with ``compound``."""
    points = "MAP {" + ", ".join(f"'{w}': CAST({v} AS DOUBLE)" for w, v in valence.items()) + "}"
    return f""",
worded AS (SELECT *, regexp_extract_all({t}, '[A-Za-z][A-Za-z'']*') AS words, {t} AS scored_text FROM {source}),
lowered AS (SELECT *, list_transform(words, lambda w: lower(w)) AS low,
  len(list_filter(words, lambda w: w = lower(w))) > 0 AS some_lower FROM worded),
pointed AS (SELECT *, list_position(low, 'but') AS but_at,
  list_filter(list_transform(low, lambda w, i: CASE WHEN w IN ({text_list(valence)}) THEN i END), lambda i: i IS NOT NULL) AS hits
  FROM lowered),
summed AS (SELECT *, coalesce(list_sum(list_transform(hits, lambda i:
    {points}[low[i]]
    * CASE WHEN some_lower AND length(words[i]) > 1 AND words[i] = upper(words[i]) THEN 1.5 ELSE 1.0 END::DOUBLE
    * CASE WHEN i > 1 AND low[i - 1] IN ({text_list(intensifiers)}) THEN 1.3 ELSE 1.0 END::DOUBLE
    * CASE WHEN (i > 1 AND low[i - 1] IN ({text_list(negators)})) OR (i > 2 AND low[i - 2] IN ({text_list(negators)}))
             OR (i > 3 AND low[i - 3] IN ({text_list(negators)})) THEN -0.74 ELSE 1.0 END::DOUBLE
    * CASE WHEN coalesce(but_at, 0) = 0 THEN 1.0 WHEN i > but_at THEN 1.5 ELSE 0.5 END::DOUBLE)), 0.0)::DOUBLE AS raw
  FROM pointed),
shouted AS (SELECT *, raw + sign(raw) * 0.292::DOUBLE
  * least(3, length(scored_text) - length(replace(scored_text, '!', ''))) AS total FROM summed),
scored AS (SELECT * EXCLUDE (words, low, hits), total / sqrt(total * total + 15.0::DOUBLE) AS compound FROM shouted)"""


SENTIMENT = "CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END"


def wilson(x: str, n: str) -> tuple[str, str]:
    z = "1.96::DOUBLE"
    p = f"({x}::DOUBLE / {n})"
    middle = f"(({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n})) / (1 + {z} * {z} / {n}))"
    return (f"CASE WHEN {n} > 0 THEN greatest(0.0::DOUBLE, {middle} - {half}) END",
            f"CASE WHEN {n} > 0 THEN least(1.0::DOUBLE, {middle} + {half}) END")


def shares_of(source: str) -> str:
    low, high = wilson("count", "n")
    return f""",
sized AS (SELECT period, count(*) AS n FROM {source} GROUP BY period),
counted AS (SELECT s.period, l.sentiment, s.n,
    (SELECT count(*) FROM {source} c WHERE c.period = s.period AND c.sentiment = l.sentiment) AS count
  FROM sized s CROSS JOIN (VALUES ('negative'), ('neutral'), ('positive')) l(sentiment))
SELECT period, sentiment, count, {r6('count::DOUBLE / n', 'share')}, {r6(low, 'ci_low')}, {r6(high, 'ci_high')} FROM counted"""


def difference_of(source: str, flag: str) -> str:
    """Columns of a share difference over one row of counts."""
    l1, u1 = wilson("pre_x", "pre_n")
    l2, u2 = wilson("post_x", "post_n")
    p1, p2 = "(pre_x::DOUBLE / pre_n)", "(post_x::DOUBLE / post_n)"
    diff = f"({p2} - {p1})"
    return f""",
sums AS (SELECT count(*) FILTER (period = 'pre') AS pre_n, count(*) FILTER (period = 'post') AS post_n,
    count(*) FILTER (period = 'pre' AND {flag}) AS pre_x, count(*) FILTER (period = 'post' AND {flag}) AS post_x FROM {source}),
difference AS (SELECT pre_n, pre_x, post_n, post_x, {r6(p1, 'pre')}, {r6(p2, 'post')}, {r6(diff, 'diff')},
    {r6(f'{diff} - sqrt(pow({p2} - {l2}, 2) + pow({u1} - {p1}, 2))', 'diff_low')},
    {r6(f'{diff} + sqrt(pow({u2} - {p2}, 2) + pow({p1} - {l1}, 2))', 'diff_high')} FROM sums)"""


def cascade(source: str) -> str:
    """``graded``: every post with the first rule it fails, or null."""
    return f""",
keyed AS (SELECT *, {key('text')} AS key FROM {source}),
copied AS (SELECT *, count(*) OVER (PARTITION BY author_hash, key) > {COPIES} AND author_hash <> '' AND key <> '' AS bot FROM keyed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key, bot ORDER BY created_at, post_id) AS copy FROM copied),
graded AS (SELECT *, CASE WHEN key = '' THEN 'empty' WHEN bot THEN 'repeated_author_text' WHEN copy > 1 THEN 'duplicate_text'
    WHEN NOT {english('text')} THEN 'not_english' WHEN {spam('text')} THEN 'spam_pattern' END AS rule FROM ranked)"""


def drawn(source: str, n: str) -> str:
    return f"""
drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY md5('7:' || post_id)) AS place,
    least({n}, (SELECT min(c) FROM (SELECT count(*) AS c FROM {source} GROUP BY period))) AS quota FROM {source})
  WHERE place <= quota)"""


STUDY = cascade("dated") + ",\nkept AS (SELECT * FROM graded WHERE rule IS NULL)," + drawn("kept", str(ALL_POSTS)) + f""",
prepared AS (SELECT post_id, {light('text')} AS text, period, source, author_hash, created_at FROM drawn)"""

# --- text, time, privacy --------------------------------------------------------------------

ORACLES["mask_text"] = with_posts(
    f"SELECT post_id, {masked('t')} AS masked FROM (SELECT post_id, text || ' see @' || lang || '_x and HTTPS://a.b/' || source AS t FROM posts)")
ORACLES["light_clean"] = with_posts(
    f"SELECT post_id, {light('t')} AS light FROM (SELECT post_id, chr(32) || chr(9) || text || ' &amp;lt; &gt;' || chr(10) || ' www.a.b ' AS t FROM posts)")
ORACLES["topic_tokens"] = with_posts(
    f"SELECT post_id, len(w)::BIGINT AS n, array_to_string(w, ' ') AS tokens FROM (SELECT post_id, {tokens('text')} AS w FROM posts)")
ORACLES["dedupe_key"] = with_posts(f"SELECT post_id, {key('text')} AS key FROM posts")

_key = SALT.encode().ljust(64, b"\0")
_inner, _outer = (bytes(b ^ pad for b in _key).hex() for pad in (0x36, 0x5C))
ORACLES["hash_author"] = with_posts(f"""
SELECT post_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE substr(sha256(unhex('{_outer}') || unhex(sha256(unhex('{_inner}')
    || encode(lower(trim(' ' || upper(lang) || '-' || (doc_id % 97))))))), 1, 16) END AS author_hash FROM posts""")
ORACLES["parse_times"] = with_posts(
    "SELECT post_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE epoch(created_at)::BIGINT END AS seconds FROM posts")
ORACLES["period_counts"] = with_posts("SELECT period, count(*) AS n FROM dated GROUP BY period")
ORACLES["english_and_spam"] = with_posts(f"""
SELECT post_id, {english('text')} AS english, {english('text', 5)} AS english_5, {spam('text')} AS spam, {spam('loud')} AS spam_loud
FROM (SELECT *, text || CASE doc_id % 7 WHEN 0 THEN ' Win a nice new NFT' WHEN 1 THEN ' follow back or DM'
    WHEN 2 THEN ' click the link, earn$5' WHEN 3 THEN ' http http HTTP' ELSE ' freely bitcoin' END AS loud FROM posts)""")
ORACLES["confounder_features"] = with_posts(f"""
SELECT post_id, len(regexp_extract_all(t, '{VISIBLE}+'))::BIGINT AS length_words, contains(t, 'http')::BIGINT AS has_link,
    contains(t, '@user')::BIGINT AS has_mention, (length(t) - length(replace(t, '#', '')))::BIGINT AS hashtags
FROM (SELECT post_id, {masked('text')} AS t FROM posts)""")

# --- sources and sinks ----------------------------------------------------------------------


def hashed(author: str) -> str:
    return (f"substr(sha256(unhex('{_outer}') || unhex(sha256(unhex('{_inner}') || encode(lower(trim({author})))))), 1, 16)")


ORACLES["read_labelled_corpus"] = with_posts(f"""
SELECT 'sentiment140:' || doc_id AS post_id, {masked("replace(text, chr(10), ' ')")} AS text,
    (epoch(created_at) + 7 * 3600)::BIGINT AS seconds, 'sentiment140' AS source, {hashed('lang')} AS author_hash,
    CASE coalesce(quality * 4 + toxic, 2) WHEN 0 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 4 THEN 'positive' END AS source_label
FROM posts LEFT JOIN labels USING (doc_id)""")
ORACLES["read_parquet_chunk"] = f"""
SELECT conv_id || '-' || turn AS uri, {masked('text')} AS text, epoch(TIMESTAMP '2023-05-01 10:00:00')::BIGINT AS seconds,
    {hashed('role')} AS author_hash FROM conversations"""
ORACLES["read_own_csv"] = with_posts(f"""
SELECT 'own:' || doc_id AS post_id, {masked('text')} AS text, epoch(TIMESTAMP '2022-11-05 08:30:00')::BIGINT AS seconds,
    'own' AS source, {hashed('lang')} AS author_hash, (doc_id % 2)::VARCHAR AS true_moderation FROM posts""")
_broken = "lang || ' \"said\",' || chr(10) || chr(10) || '\"' || text || '\"' || chr(10)"
ORACLES["read_csv_without_ids"] = with_posts(f"""
SELECT {masked(_broken)} AS text, count(*) AS posts, count(*) AS ids, epoch(TIMESTAMP '2022-11-05 08:30:00')::BIGINT AS seconds
FROM posts GROUP BY 1""")
ORACLES["union_of_sources"] = with_posts(f"""
SELECT 'own' AS kind, count(*) AS posts, 0::BIGINT AS labels, count(*) AS truths, count(DISTINCT lang) AS authors
FROM posts WHERE regexp_matches(text, '{VISIBLE}')
UNION ALL SELECT 'parquet', count(*), 0, 0, count(DISTINCT role) FROM conversations WHERE regexp_matches(text, '{VISIBLE}')
UNION ALL SELECT 'labelled', count(*), count(*) FILTER (coalesce(quality * 4 + toxic, 2) IN (0, 2, 4)), 0, count(DISTINCT lang)
FROM posts LEFT JOIN labels USING (doc_id) WHERE regexp_matches(text, '{VISIBLE}')""")
ORACLES["post_checks"] = with_posts(f"""
SELECT (SELECT count(*) FROM broken) AS posts, (SELECT count(*) FROM broken WHERE blank) AS blank_texts,
    (SELECT count(*) FROM broken WHERE NOT blank AND doc_id % 31 = 0) AS bad_times,
    (SELECT count(*) FROM (SELECT doc_id % 900 FROM broken WHERE NOT blank GROUP BY ALL HAVING count(*) > 1)) AS repeated_ids""",
    f", broken AS (SELECT doc_id, doc_id % 50 = 0 OR NOT regexp_matches(text, '{VISIBLE}') AS blank FROM posts)")
ORACLES["prepared_round_trip"] = with_posts("SELECT post_id, text, period, source, author_hash FROM prepared", STUDY)

_scored = compound_ctes("dated", "text", VALENCE, NEGATORS, INTENSIFIERS)
_labelled_rows = f""",
rows AS (SELECT *, {SENTIMENT} AS sentiment FROM scored)"""
ORACLES["scores_without_text"] = with_posts(f"""
SELECT post_id, source, author_hash, {r6('compound', 'compound')}, sentiment, 'ok' AS status, {category_names('text')} AS moderation_categories,
    {flagged('text')}::INTEGER AS moderation, 'lexicon' AS scorer, period FROM rows""", _scored + _labelled_rows)
ORACLES["sentiment_shares"] = with_posts("", _scored + _labelled_rows + shares_of("rows"))
ORACLES["report_round_trip"] = ORACLES["sentiment_shares"]

# --- quality rules and sampling -------------------------------------------------------------

ORACLES["drop_blank_posts"] = with_posts(
    f"SELECT lang, count(*) AS n FROM posts WHERE doc_id % 9 <> 0 AND regexp_matches(text, '{VISIBLE}') GROUP BY lang")
_report = "SELECT rule, period, count(*) AS removed FROM graded WHERE rule IS NOT NULL GROUP BY rule, period"
ORACLES["filter_report"] = with_posts(_report, cascade("dated"))
ORACLES["filter_totals"] = with_posts(
    "SELECT count(*) AS rows_in, count(*) FILTER (rule IS NULL) AS rows_out FROM graded", cascade("dated"))
ORACLES["filtered_posts"] = with_posts("SELECT post_id, period, lang, text FROM graded WHERE rule IS NULL", cascade("dated"))
ORACLES["filter_report_hot_text"] = with_posts(_report, """,
hot AS (SELECT * REPLACE (CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'It is the HOT text!' ELSE text END AS text,
    CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang END AS author_hash) FROM dated)""" + cascade("hot"))
ORACLES["filter_report_missing_authors"] = with_posts(_report + """
UNION ALL SELECT 'rows in', 'all', count(*) FROM graded UNION ALL SELECT 'rows out', 'all', count(*) FROM graded WHERE rule IS NULL""", """,
missing AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN 'It is the same text' WHEN doc_id % 11 <> 0 THEN text ELSE '' END AS text,
    CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS author_hash) FROM dated)""" + cascade("missing"))
ORACLES["topic_prevalence_interval"] = with_posts("SELECT DISTINCT lang AS topic, true AS as_theory FROM dated")


def batched(size: int) -> str:
    """``batched``: posts with the number of their batch, and whether it fails."""
    return f""",
numbered AS (SELECT *, (row_number() OVER (ORDER BY post_id, text) - 1) // {size} AS batch FROM dated),
batched AS (SELECT *, bool_or(contains(text, 'pathetic')) OVER (PARTITION BY batch) AS fails FROM numbered)"""


ORACLES["scorer_error_counts"] = with_posts("SELECT period, count(*) AS errors FROM batched WHERE fails GROUP BY period", batched(64))
ORACLES["balanced_sample"] = with_posts("SELECT post_id, period FROM drawn", "," + drawn("dated", str(PER_PERIOD)))
ORACLES["stratified_sample"] = with_posts("""
SELECT post_id, period, lang FROM (
  SELECT *, row_number() OVER (PARTITION BY period, lang ORDER BY md5('7:' || post_id)) AS place,
    round_even(count(*) OVER (PARTITION BY period, lang) / count(*) OVER (PARTITION BY period)
      * least(75, (SELECT min(c) FROM (SELECT count(*) AS c FROM dated GROUP BY period))), 0) AS quota FROM dated)
WHERE place <= quota""")
ORACLES["single_sample"] = """
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY md5('3:' || event_id)) AS place FROM events) WHERE place <= 777"""


def sorted_share(source: str, value: str, order: str) -> str:
    return f"""
SELECT greatest(count(*) - 1, 0) AS pairs, {r6('count(*) FILTER (same)::DOUBLE / (count(*) - 1)', 'sortedness')}
FROM (SELECT {value} = lag({value}) OVER (ORDER BY {order}) AS same FROM {source})"""


ORACLES["sortedness_of_languages"] = sorted_share("documents", "lang", "doc_id")
ORACLES["sortedness_of_events"] = sorted_share("events", "event_type", "ts, event_id")

# --- sentiment and patterns -----------------------------------------------------------------

ORACLES["lexicon_scores"] = with_posts(
    f"SELECT post_id, {r6('compound', 'compound')}, {SENTIMENT} AS sentiment, 'ok' AS status FROM scored",
    compound_ctes("posts", "replace(text, ' from ', ' but ')", VALENCE, NEGATORS, INTENSIFIERS))
ORACLES["lexicon_scores_default"] = with_posts(
    f"SELECT post_id, {r6('compound', 'compound')}, {SENTIMENT} AS sentiment FROM scored",
    compound_ctes("posts", "text", fixed.VALENCE, fixed.NEGATORS, fixed.INTENSIFIERS))
_terms = " || ".join(f"regexp_extract_all(plain, {category_pattern(p)})" for p in CATEGORIES.values())
ORACLES["pattern_match"] = with_posts(f"""
SELECT post_id, {flagged('text')} AS flagged, {category_names('text')} AS categories,
    array_to_string(list_transform(list_filter(list_transform(found, lambda w, i: struct_pack(w := lower(w),
      fresh := NOT list_contains(list_transform(found[1:i - 1], lambda v: lower(v)), lower(w)))), lambda s: s.fresh), lambda s: s.w), ';') AS terms
FROM (SELECT *, {_terms} AS found FROM (SELECT *, regexp_replace(text, '{ACCENTED}', 'z', 'g') AS plain FROM posts))""")
ORACLES["default_flags"] = with_posts(f"""
SELECT post_id, {flagged('spiced', fixed.PATTERN_CATEGORIES)} AS flagged, {naive('spiced')} AS naive,
    {category_names('spiced', fixed.PATTERN_CATEGORIES)} AS categories
FROM (SELECT *, text || CASE doc_id % 5 WHEN 0 THEN ' Free speech' WHEN 1 THEN ' bananas, urban' WHEN 2 THEN ' BANNED!' ELSE '' END AS spiced FROM posts)""")


def checked(name: str, hit: str) -> str:
    p_low, p_high = wilson("tp", "(tp + fp)")
    r_low, r_high = wilson("tp", "(tp + fn)")
    p, r = "(tp::DOUBLE / nullif(tp + fp, 0))", "(tp::DOUBLE / nullif(tp + fn, 0))"
    return f"""
SELECT '{name}' AS flag, n, tp, fp, fn, {r6(p, 'precision')}, {r6(r, 'recall')},
    {r6(f'CASE WHEN tp > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END', 'f1')}, {r6(p_low, 'precision_low')},
    {r6(p_high, 'precision_high')}, {r6(r_low, 'recall_low')}, {r6(r_high, 'recall_high')}
FROM (SELECT count(*) AS n, count(*) FILTER ({hit} AND toxic = 1) AS tp, count(*) FILTER ({hit} AND toxic = 0) AS fp,
    count(*) FILTER (NOT {hit} AND toxic = 1) AS fn FROM labelled)"""


ORACLES["flag_check"] = with_posts(
    checked("patterns", flagged("text")) + "\nUNION ALL" + checked("substring_baseline", naive("text")))
ORACLES["wrong_flags"] = with_posts(f"""
SELECT CASE WHEN toxic = 0 THEN 'false_positive' ELSE 'false_negative' END AS kind, count(*) AS n, sum(length(text))::BIGINT AS chars
FROM labelled WHERE {flagged('text')} <> (toxic = 1) GROUP BY kind""")
ORACLES["model_scorer_errors"] = with_posts(f"""
SELECT period, status, sentiment, count(*) AS n, {r6('sum(compound)', 'compound')} FROM (
  SELECT period, CASE WHEN fails THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN fails THEN NULL WHEN length(text) % 2 = 1 THEN 'positive' ELSE 'negative' END AS sentiment,
    CASE WHEN fails THEN NULL WHEN length(text) % 2 = 1 THEN 0.7 - (0.8 - 0.7) ELSE 0.1 - (0.8 - 0.1) END::DOUBLE AS compound
  FROM batched) GROUP BY period, status, sentiment""", batched(16))
ORACLES["analyzer_scores"] = with_posts(f"""
SELECT period, {SENTIMENT} AS sentiment, count(*) AS n, {r6('sum(compound)', 'compound')}
FROM (SELECT period, (length(text) % 21 - 10) / 20.0::DOUBLE AS compound FROM dated) GROUP BY ALL""")

# --- tables and tests -----------------------------------------------------------------------

EVENTS = "WITH timed AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 'post' ELSE 'pre' END AS period FROM events)"
ORACLES["contingency"] = EVENTS + """
SELECT p.period AS row, l.col, (SELECT count(*) FROM timed t WHERE t.period = p.period AND t.event_type = l.col) AS n
FROM (SELECT DISTINCT period FROM timed) p CROSS JOIN (VALUES ('click'), ('error'), ('never'), ('view')) l(col)"""
ORACLES["contingency_wide"] = EVENTS + """
SELECT period, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
    count(*) FILTER (event_type = 'view') AS view FROM timed GROUP BY period"""


def crc32(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''),
    lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
    ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""


def chi_of(source: str, row: str, col: str) -> str:
    """``chi``: statistic and its parts, over all combinations of the rows and columns that occur."""
    return f""",
rows_ AS (SELECT {row} AS r, count(*) AS nr FROM {source} GROUP BY 1),
cols_ AS (SELECT {col} AS c, count(*) AS nc FROM {source} GROUP BY 1),
seen AS (SELECT {row} AS r, {col} AS c, count(*) AS n FROM {source} GROUP BY 1, 2),
cells AS (SELECT coalesce(seen.n, 0) AS o, nr::DOUBLE * nc / (SELECT count(*) FROM {source}) AS e
  FROM rows_ CROSS JOIN cols_ LEFT JOIN seen USING (r, c)),
chi AS (SELECT sum((o - e) * (o - e) / e) AS chi2, sum(o)::BIGINT AS n, min(e) AS min_expected,
    (SELECT count(*) FROM rows_) AS nrows, (SELECT count(*) FROM cols_) AS ncols FROM cells)"""


def chi_columns(p_value: str | None) -> str:
    p = f", {r6(p_value, 'p_value')}" if p_value else ""
    return (f"{r6('chi2', 'chi2')}, ((nrows - 1) * (ncols - 1))::BIGINT AS dof{p}, "
            + r6("sqrt(chi2 / (n * (least(nrows, ncols) - 1)))", "cramers_v"))


ORACLES["chi_square"] = EVENTS + chi_of("timed", "period", "event_type") + f"""
SELECT {chi_columns('exp(-chi2 / 2) * (1 + chi2 / 2)')}, n, {r6('min_expected', 'min_expected')} FROM chi"""
ORACLES["chi_square_users"] = EVENTS + chi_of("timed", "event_type", "user_id") + f"""
SELECT {chi_columns(None)}, n, {r6('min_expected', 'min_expected')} FROM chi"""
_low, _high = wilson("x", "n")
ORACLES["event_share_intervals"] = EVENTS + f"""
SELECT event_type, n, x, {r6(_low, 'ci_low')}, {r6(_high, 'ci_high')}
FROM (SELECT event_type, count(*) AS n, count(*) FILTER (period = 'post') AS x FROM timed GROUP BY event_type)"""
ORACLES["event_value_quantiles"] = EVENTS + f"""
SELECT period, {r6('quantile_cont(value, 0.025)', 'low')}, {r6('quantile_cont(value, 0.975)', 'high')} FROM timed GROUP BY period"""
ORACLES["moderation_share_diff"] = with_posts("SELECT * FROM difference", difference_of("labelled", "toxic = 1"))
ORACLES["negative_share_inside"] = with_posts(
    "SELECT * FROM difference", ", inside AS (SELECT * FROM labelled WHERE toxic = 1)" + difference_of("inside", "quality = 0"))


def mean_difference(source: str, name: str, value: str) -> str:
    pre, post = f"({value}) FILTER (period = 'pre')", f"({value}) FILTER (period = 'post')"
    spread = f"sqrt((var_samp{pre} + var_samp{post}) / 2)"
    return f"SELECT '{name}' AS feature, {r6(f'coalesce((avg{post} - avg{pre}) / nullif({spread}, 0), 0.0)', 'smd')} FROM {source}"


ORACLES["mean_differences_text"] = with_posts("\nUNION ALL ".join([
    mean_difference("dated", "length_words", f"len(regexp_extract_all(text, '{VISIBLE}+'))"),
    mean_difference("dated", "has_link", "contains(text, 'http')::INTEGER"),
    mean_difference("dated", "has_mention", "contains(text, '@user')::INTEGER"),
    mean_difference("dated", "hashtags", "length(text) - length(replace(text, '#', ''))")]))
ORACLES["mean_differences_events"] = EVENTS + "\n" + "\nUNION ALL ".join([
    mean_difference("timed", "value", "value"), mean_difference("timed", "user", "user_id"), mean_difference("timed", "flat", "1")])


def standardized(source: str, outcome: str, stratum: str) -> str:
    return f"""
SELECT {r6('(SELECT avg(y) FILTER (period = $q$post$q$) - avg(y) FILTER (period = $q$pre$q$) FROM outcomes)', 'crude_diff')},
    {r6('sum(w * (b - a)) / sum(w)', 'standardized_diff')}
FROM (SELECT s, count(*) AS w, avg(y) FILTER (period = 'pre') AS a, avg(y) FILTER (period = 'post') AS b FROM outcomes GROUP BY s)
WHERE a IS NOT NULL AND b IS NOT NULL""".replace("$q$", "'"), f""",
outcomes AS (SELECT period, {stratum} AS s, ({outcome})::INTEGER AS y FROM {source})"""


ORACLES["standardized_diff"] = with_posts(*standardized("labelled", "quality = 0", "lang"))
ORACLES["standardized_diff_sources"] = with_posts(*standardized("labelled", "quality = 0", "source || '/' || lang"))
ORACLES["topic_prevalence_point"] = with_posts(f"""
SELECT lang AS topic, {r6('a', 'pre_share')}, {r6('b', 'post_share')}, {r6('b - a', 'diff')} FROM (
  SELECT lang, count(*) FILTER (period = 'pre')::DOUBLE / (SELECT count(*) FROM dated WHERE period = 'pre') AS a,
    count(*) FILTER (period = 'post')::DOUBLE / (SELECT count(*) FROM dated WHERE period = 'post') AS b FROM dated GROUP BY lang)""")
ORACLES["logit_saturated"] = with_posts("""
SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(coef / se, 4) AS z, round(exp(coef), 4) AS odds_ratio FROM (
  SELECT 'intercept' AS term, l00 AS coef, sqrt(v00) AS se FROM wide
  UNION ALL SELECT 'post', l10 - l00, sqrt(v10 + v00) FROM wide
  UNION ALL SELECT 'toxic', l01 - l00, sqrt(v01 + v00) FROM wide
  UNION ALL SELECT 'post_x_toxic', l11 - l10 - l01 + l00, sqrt(v11 + v10 + v01 + v00) FROM wide)""", """,
odds AS (SELECT period, toxic, ln(count(*) FILTER (quality = 0)::DOUBLE / count(*) FILTER (quality = 1)) AS l,
    1.0::DOUBLE / count(*) FILTER (quality = 0) + 1.0::DOUBLE / count(*) FILTER (quality = 1) AS v FROM labelled GROUP BY ALL),
wide AS (SELECT max(l) FILTER (period = 'pre' AND toxic = 0) AS l00, max(l) FILTER (period = 'post' AND toxic = 0) AS l10,
    max(l) FILTER (period = 'pre' AND toxic = 1) AS l01, max(l) FILTER (period = 'post' AND toxic = 1) AS l11,
    max(v) FILTER (period = 'pre' AND toxic = 0) AS v00, max(v) FILTER (period = 'post' AND toxic = 0) AS v10,
    max(v) FILTER (period = 'pre' AND toxic = 1) AS v01, max(v) FILTER (period = 'post' AND toxic = 1) AS v11 FROM odds)""")
ORACLES["truth_check"] = with_posts(f"""
SELECT {r6("count(*) FILTER (m AND toxic = 1)::DOUBLE / greatest(1, count(*) FILTER (m))", 'moderation_precision')},
    {r6("count(*) FILTER (m AND toxic = 1)::DOUBLE / greatest(1, sum(toxic))", 'moderation_recall')},
    {r6("avg((s = CASE WHEN quality = 0 THEN 'negative' ELSE 'positive' END)::INTEGER)", 'sentiment_accuracy')}
FROM (SELECT *, {flagged('text')} AS m, {SENTIMENT} AS s FROM scored)""",
    compound_ctes("labelled", "text", VALENCE, NEGATORS, INTENSIFIERS))

# --- topics ---------------------------------------------------------------------------------

TERMS = f""",
cut AS (SELECT post_id, lang, regexp_extract_all(array_to_string({tokens('text')}, ' '), '[a-z]{{2,}}') AS w FROM posts),
termed AS (SELECT post_id, lang, w || list_transform(w[1:len(w) - 1], lambda a, i: a || ' ' || w[i + 1]) AS terms FROM cut),
counted AS (SELECT post_id, lang, term, count(*) AS n FROM (SELECT post_id, lang, unnest(terms) AS term FROM termed) GROUP BY ALL),
words AS (SELECT term, documents, ln((1 + total)::DOUBLE / (1 + documents)) + 1 AS idf FROM (
    SELECT term, count(*) AS documents, (SELECT count(*) FROM posts) AS total FROM counted GROUP BY term)
  WHERE documents >= 2 AND documents <= 0.5 * total)"""
ORACLES["vocabulary"] = with_posts(f"SELECT term, documents, {r6('idf', 'idf')} FROM words", TERMS)
ORACLES["tfidf_top_terms"] = with_posts("""
SELECT lang, term, weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM (
    SELECT lang, term, round(sum(v / norm), 6) + 0.0 AS weight FROM normed GROUP BY lang, term))
WHERE rank <= 10""", TERMS + """,
weighed AS (SELECT post_id, lang, term, (1 + ln(n)) * idf AS v FROM counted JOIN words USING (term)),
normed AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY post_id)) AS norm FROM weighed)""")

ORACLES["tfidf_repeated_ids"] = with_posts(f"""
SELECT lang, count(*) AS entries, count(DISTINCT term) AS terms, {r6('sum(v / norm)', 'weight')}, {r6('sum((v / norm) * (v / norm))', 'posts')}
FROM normed GROUP BY lang""", TERMS + """,
weighed AS (SELECT post_id, lang, term, (1 + ln(n)) * idf AS v FROM counted JOIN words USING (term)),
normed AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY post_id)) AS norm FROM weighed)""")
# properties that any right fit has; the numbers themselves are not SQL
ORACLES["topic_assignment_again"] = "SELECT lang, count(*) AS posts FROM documents GROUP BY lang"
ORACLES["topic_of_own_words"] = "SELECT 4::BIGINT AS topics, 4::BIGINT AS found"
ORACLES["topic_loss_falls"] = "SELECT count(*) AS posts, true AS falls, true AS ended, true AS solved FROM documents"
ORACLES["topic_purity"] = "SELECT lang, count(*) AS posts, true AS pure FROM documents GROUP BY lang"

# --- jobs -----------------------------------------------------------------------------------

ORACLES["prepare_manifest"] = with_posts(f"""
SELECT '2022-10-27' AS cutoff, least((SELECT count(*) FROM prepared WHERE period = 'pre'), (SELECT count(*) FROM prepared WHERE period = 'post')) AS n_per_period,
    (SELECT count(*) FROM prepared WHERE period = 'pre') AS pre, (SELECT count(*) FROM prepared WHERE period = 'post') AS post,
    (SELECT strftime(min(created_at), '%Y-%m-%d') FROM prepared WHERE period = 'pre') AS first_day,
    (SELECT strftime(max(created_at), '%Y-%m-%d') FROM prepared WHERE period = 'post') AS last_day,
    (SELECT count(*) FROM graded) AS rows_in, (SELECT count(*) FROM kept) AS rows_out,
    (SELECT string_agg(rule || ' ' || a || ' ' || b, ';' ORDER BY rule) FROM (SELECT rule, count(*) FILTER (period = 'pre') AS a,
        count(*) FILTER (period = 'post') AS b FROM graded WHERE rule IS NOT NULL GROUP BY rule)) AS removed,
    (SELECT string_agg(source || ' ' || n, ';' ORDER BY source) FROM (SELECT source, count(*) AS n FROM prepared
        WHERE period = 'pre' GROUP BY source)) AS pre_sources""", STUDY)
_study_rows = STUDY + compound_ctes("prepared", "text", VALENCE, NEGATORS, INTENSIFIERS) + _labelled_rows
ORACLES["study_shares"] = with_posts("", _study_rows + shares_of("rows"))
ORACLES["study_report"] = with_posts(f"""
SELECT {chi_columns('exp(-chi2 / 2)')}, pre, post, diff, diff_low, diff_high FROM chi CROSS JOIN difference""",
    _study_rows + chi_of("rows", "period", "sentiment") + difference_of("rows", flagged("text")))
ORACLES["study_post_counts"] = with_posts("SELECT period, count(*) AS posts FROM rows GROUP BY period", _study_rows)
ORACLES["study_confounders"] = with_posts("\nUNION ALL ".join([
    mean_difference("rows", "length_words", f"len(regexp_extract_all(text, '{VISIBLE}+'))"),
    mean_difference("rows", "has_link", "contains(text, 'http')::INTEGER"),
    mean_difference("rows", "has_mention", "contains(text, '@user')::INTEGER"),
    mean_difference("rows", "hashtags", "length(text) - length(replace(text, '#', ''))")]), _study_rows)
_inside = f", inside AS (SELECT * FROM rows WHERE {flagged('text')})"
ORACLES["study_inside_chi_square"] = with_posts(
    f"SELECT {chi_columns(None)} FROM chi", _study_rows + _inside + chi_of("inside", "period", "sentiment"))
ORACLES["study_inside_share"] = with_posts(
    "SELECT pre, post, diff, diff_low, diff_high FROM difference", _study_rows + _inside + difference_of("inside", "sentiment = 'negative'"))
ORACLES["study_errors"] = with_posts(f"""
SELECT period, count(*) FILTER (NOT bad) AS posts, count(*) FILTER (bad) AS errors
FROM (SELECT period, {crc32('post_id')} % 7 = 0 AS bad FROM rows) GROUP BY period""", _study_rows)
ORACLES["study_truth_check"] = ORACLES["truth_check"]
ORACLES["study_topics"] = with_posts("""
SELECT 1.0::DOUBLE AS pre_share, 1.0::DOUBLE AS post_share, 0.0::DOUBLE AS diff, 0::BIGINT AS outside, 0::BIGINT AS unnamed,
    4::BIGINT AS topics, 32::BIGINT AS words, 'intercept moderation post post_x_moderation' AS terms, diff AS crude_diff
FROM difference""", _study_rows + difference_of("rows", "sentiment = 'negative'"))
ORACLES["logit_score_equations"] = with_posts("""
SELECT count(*) AS posts, sum((quality = 0)::INTEGER)::BIGINT AS poor, 0.0::DOUBLE AS intercept, 0.0::DOUBLE AS size, 0.0::DOUBLE AS post, 0.0::DOUBLE AS toxic
FROM labelled""")
