"""The same results in SQL, for the queries that SQL can express on whole tables."""

import re

from corvane.functions.lang import EXTENSIONS
from corvane.llm import generated_files as G
from corvane.llm import truncation
from corvane.llm.dialect import DUCK

_TERMS = r"""
code AS (SELECT DISTINCT cand_id, code FROM candidate WHERE code IS NOT NULL),
words AS (SELECT cand_id, unnest(regexp_extract_all(code, '[A-Za-z0-9]+')) AS w FROM code),
counted AS (SELECT cand_id, w, count(*) AS n FROM words GROUP BY ALL),
split AS (SELECT w, unnest(list_distinct(list_concat([lower(w)], string_split(lower(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'),
    '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')), ' ')))) AS term FROM (SELECT DISTINCT w FROM counted)),
tf AS (SELECT cand_id, term, sum(n) AS n FROM counted JOIN split USING (w) WHERE length(term) >= 2 GROUP BY ALL)
"""

_UNITS = "ceil((length({0}) + length(regexp_replace({0}, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g'))) / 4.0)"

P1_FOUND = f"""
WITH {_TERMS}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT cand_id, term FROM tf JOIN df USING (term) WHERE n >= 4 AND df BETWEEN 2 AND 6
"""

# Shingles of five words of a file without the comments at its head, joined file to file.
_LANG = f"map {{{', '.join(f'{DUCK.quoted(e)}: {DUCK.quoted(g)}' for e, g in EXTENSIONS.items())}}}[regexp_extract(lower(split_part(path, '/', -1)), '\\.[^.]*$')]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
P2_COPIES = rf"""
WITH texts AS (SELECT file_id, coalesce('r' || repo, 'f' || file_id) AS repo, content, string_split(content, chr(10)) AS rows FROM files JOIN file_text USING (file_id) WHERE content IS NOT NULL),
heads AS (SELECT *, list_position(list_transform(rows, lambda r: NOT (regexp_matches(r, '^\s*$') OR starts_with(r, '<?')
    OR regexp_matches(r, '^\s*(//|/\*|\*|--|<!--|;|[''"]{{3}})')
    OR regexp_matches(r, '^\s*#') AND NOT regexp_matches(r, '^\s*#(include|define|if|endif|pragma|\[)'))), true) AS first FROM texts),
bodies AS (SELECT file_id, repo, CASE WHEN first > 1 THEN array_to_string(rows[first:], chr(10)) ELSE content END AS body FROM heads),
words AS (SELECT file_id, repo, list_transform(regexp_extract_all(body, '[0-9A-Za-z_\x{{80}}-\x{{10FFFF}}]+'), lambda w: translate(w, '{_UPPER}', '{_LOWER}')) AS w FROM bodies),
shingles AS (SELECT DISTINCT file_id, repo, s FROM (SELECT file_id, repo, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) >= 40)),
sizes AS (SELECT file_id, count(*) AS n FROM shingles GROUP BY file_id),
shared AS (SELECT a.file_id AS x, b.file_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.repo != b.repo GROUP BY ALL),
alike AS (SELECT x, c / (p.n + q.n - c) AS jaccard FROM shared JOIN sizes p ON p.file_id = x JOIN sizes q ON q.file_id = y)
SELECT x AS file_id, round(max(jaccard), 6)::DOUBLE AS copy_similarity FROM alike WHERE jaccard >= 0.8 GROUP BY x
"""

# The layout statistics and marks of each file, and what decides, as in generated_files; RE2 knows neither look-ahead nor possessive repeats.
def _limits(name: str) -> str:
    usual = getattr(G.DEFAULT_LIMITS, name)
    cases = "".join(f" WHEN lang = '{lang}' THEN {getattr(v, name)}::DOUBLE" for lang, v in G.LIMITS.items() if getattr(v, name) != usual)
    return f"CASE{cases} ELSE {usual}::DOUBLE END" if cases else f"{usual}::DOUBLE"


def _re(pattern: re.Pattern | str) -> str:
    """A pattern of Python's as a quoted one of RE2."""
    flags = "(?i)" if isinstance(pattern, re.Pattern) and pattern.flags & re.I else ""
    text = pattern.pattern if isinstance(pattern, re.Pattern) else pattern
    text = text.replace("by\\s+(?!hand\\b)", "by\\s+").replace("(?>", "(?:").replace("*+", "*").replace("++", "+").replace("}+", "}")
    return DUCK.quoted(flags + text)


_IS_COMMENT = r"""(regexp_matches({0}, '^\s*(//|/\*|\*|--|<!--|;|[''"]{{3}})') OR regexp_matches({0}, '^\s*#') AND NOT regexp_matches({0}, '^\s*#(include|define|if|endif|pragma|\[)'))"""
_NO_STRINGS = DUCK.replace("r", G._STRING.pattern, "")
_CODE_OF = "CASE WHEN length(r) > 200 THEN regexp_replace(r, " + _re("^" + G._ASSIGNED.pattern) + ", '') ELSE r END"
_HEAD = r"""^(?:[^\S\n]*\n|\s*/\*(?s:.*?)\*/[^\n]*(?:\n|$)|\s*<!--(?s:.*?)-->[^\n]*(?:\n|$)|\s*"{3}(?s:.*?)"{3}[^\n]*(?:\n|$)|\s*'{3}(?s:.*?)'{3}[^\n]*(?:\n|$)|\s*(?:<\?|package\b|["']use strict["'])[^\n]*(?:\n|$)|\s*(?:#(?:[^idep\[\n][^\n]*)?|#(?:i[^nf]|d[^e]|e[^n]|p[^r])[^\n]*|//[^\n]*|\*[^\n]*|--[^\n]*|;[^\n]*)(?:\n|$))*"""
_MADE = f"regexp_matches(regexp_replace(r, '(?i)\\bby\\s+hand\\b', 'hand', 'g'), {_re(G._MADE)})"
_PATH = "coalesce(path, '')"
P2_FOUND = f"""
{P2_COPIES.replace(")\nSELECT x AS file_id", "),\ncopies AS (SELECT x AS file_id", 1).rstrip()}),
src AS (SELECT file_id, path, coalesce(lower(files.lang), {_LANG}, 'text') AS lang, content, string_split(content, chr(10)) AS rows FROM files JOIN file_text USING (file_id) WHERE content IS NOT NULL),
full_rows AS (SELECT file_id, unnest(list_filter(rows, lambda r: NOT regexp_matches(r, '^\\s*$'))) AS r FROM src),
per_row AS (SELECT file_id, length(r) AS n, ceil(length(r) / 200.0) AS units, CASE WHEN length(r) > 200 AND NOT {_IS_COMMENT.format("r")} AND length({_NO_STRINGS}) > 200 THEN length({_NO_STRINGS}) ELSE 0 END AS in_long,
    regexp_full_match({_CODE_OF}, {_re(G._LITERAL_LINE)}) AS literal, length(r) < 1000 AND regexp_matches(r, {_re(G._ACCESSOR)}) AS accessor FROM full_rows),
layout AS (SELECT file_id, max(n) AS max_line, avg(n) AS mean_line, sum(in_long) / greatest(1, sum(n)) AS long_share, coalesce(sum(units) FILTER (literal), 0) AS literal_lines,
    coalesce(sum(units) FILTER (literal), 0) / greatest(1, sum(units)) AS literal_share, count(*) FILTER (accessor) / count(*) AS accessor_share FROM per_row GROUP BY file_id),
chars AS (SELECT file_id, greatest(1, strlen(content)) AS size, length(content) AS n, strlen(content) - length(regexp_replace(content, '[\\x00-\\x7F]', '', 'g')) AS a0,
    length(content) - length(regexp_replace(content, '[\\x09-\\x0D ]', '', 'g')) AS spaces, length(content) - length(regexp_replace(content, '[0-9]', '', 'g')) AS digits,
    strlen(regexp_replace(content, '[\\x00-/:-@\\[-`{{-\\x7F]', '', 'g')) AS alnum,
    coalesce(list_sum(list_transform(regexp_extract_all(content, '[A-Za-z0-9+/=_-]{{160,}}'), lambda x: length(x))), 0) / greatest(1, length(content)) AS encoded_share FROM src),
head_of AS (SELECT file_id, rows, string_split(regexp_extract(content, {DUCK.quoted(_HEAD)}), chr(10)) AS h FROM src),
head_rows AS (SELECT file_id, unnest(list_concat(list_filter(h, lambda r: NOT regexp_matches(r, '^\\s*(<\\?|package\\b)')),
    list_filter(rows[greatest(len(h), len(rows) - 5):], lambda r: {_IS_COMMENT.format("r")}))) AS r FROM head_of),
marked AS (SELECT file_id, CASE WHEN regexp_matches(r, {_re(G._UNMADE)}) THEN 'hand' WHEN {_MADE} THEN 'made' WHEN regexp_matches(r, {_re(G._COPIED)}) THEN 'copied' END AS m FROM head_rows),
marks AS (SELECT file_id, bool_or(m = 'hand') AS hand, bool_or(m = 'made') AS made, bool_or(m = 'copied') AS copied FROM marked GROUP BY file_id),
judged AS (SELECT file_id, lang != 'text' AS code, {_PATH} AS path, coalesce(hand, false) AS hand, coalesce(made, false) AS made, coalesce(copied, false) AS copied, copy_similarity, accessor_share,
    long_share >= {_limits("long_share")} AND mean_line >= {_limits("mean_line")} OR spaces / size <= {_limits("space_share")} AND max_line > 200 AND long_share >= {G.SOME_LONG}
        OR regexp_matches({_PATH}, {_re(G.MINIFIED_PATH)}) AND mean_line >= 80 AS minified,
    literal_lines >= {_limits("literal_lines")} AND (literal_share >= {_limits("literal_share")} OR digits / size >= {_limits("digit_share")} AND literal_share >= {G.HALF_LITERAL})
        OR encoded_share >= {_limits("encoded_share")} OR alnum / size >= {_limits("alnum_share")} AND spaces / size <= {_limits("space_share")} AS data
    FROM src JOIN chars USING (file_id) LEFT JOIN layout USING (file_id) LEFT JOIN marks USING (file_id) LEFT JOIN copies USING (file_id))
SELECT DISTINCT file_id FROM judged WHERE code AND coalesce(minified OR data, false) OR made OR NOT hand AND code AND (regexp_matches(path, {_re(G.GENERATED_PATH)}) OR coalesce(accessor_share >= {G.ACCESSOR_SHARE}, false))
    OR copied OR regexp_matches(path, {_re(G.VENDORED_PATH)}) OR copy_similarity IS NOT NULL
"""

P4_FOUND = f"""
WITH c AS (SELECT DISTINCT cand_id, start_line AS s, code FROM candidate WHERE code IS NOT NULL),
t AS (SELECT chunk_id, array_to_string(list_slice(string_split(code, chr(10)), i.start_line - s + 1, i.end_line - s + 1), chr(10)) AS text
    FROM included_chunk i JOIN c USING (cand_id))
SELECT DISTINCT chunk_id FROM t WHERE {_UNITS.format("text")} > 384
"""

_COUNTS = f"""{_TERMS},
names AS (SELECT file_id, unnest(symbols).name AS term FROM files WHERE symbols IS NOT NULL),
counts AS (
    SELECT 'code' AS field, term, sum(n)::BIGINT AS occurrences, count(*) AS records, (SELECT count(DISTINCT cand_id) FROM candidate WHERE code IS NOT NULL) AS total
    FROM tf GROUP BY term
    UNION ALL
    SELECT 'symbol', term, count(*), count(DISTINCT file_id), (SELECT count(*) FROM files WHERE symbols IS NOT NULL) FROM names WHERE term IS NOT NULL GROUP BY term),
judged AS (SELECT field, term, occurrences, records, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.05 * total THEN 'common' END AS verdict FROM counts)"""

P5_FOUND = f"WITH {_COUNTS} SELECT field, term, verdict FROM judged WHERE verdict IS NOT NULL"
P5_TERMS = f"WITH {_COUNTS} SELECT field, term, occurrences, records, verdict FROM judged"

P7_FOUND = f"""
WITH sizes AS (SELECT source, sum({_UNITS.format("text")}) AS size FROM documents WHERE text IS NOT NULL GROUP BY source),
s AS (SELECT m.source, weight, max_repeat, coalesce(size, 0) AS size FROM mix_target m LEFT JOIN sizes USING (source))
SELECT source FROM s WHERE size * max_repeat < weight * (SELECT sum(size) FROM s)
"""

_CUT = f"""
counts AS ({truncation.trigram_counts(DUCK, "(SELECT DISTINCT text FROM documents)")}),
last AS ({truncation.last_trigrams(DUCK, "documents")}),
judged AS ({truncation.judged_trigrams(DUCK, "last", "counts")}),
placed AS ({truncation.placed_texts("last", "judged")}),
spikes AS ({truncation.spikes("placed")}),
sharp AS ({truncation.sharp_limits("placed", "spikes")}),
rest AS ({truncation.rest_texts("placed", "sharp")}),
mounds AS ({truncation.mounds("rest")}),
wide AS ({truncation.wide_limits("rest", "mounds")}),
verdicts AS ({truncation.cut_texts("placed", "sharp", "wide")})"""
P8_FOUND = f"WITH {_CUT} SELECT DISTINCT doc_id FROM verdicts WHERE by_limit OR by_trigram"
P8_RATES = f"""
WITH {_CUT}, cut AS (SELECT source, count(DISTINCT doc_id) AS truncated FROM verdicts WHERE by_limit OR by_trigram GROUP BY source),
n AS (SELECT source, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY source)
SELECT n.source, documents, coalesce(truncated, 0) AS truncated, round(coalesce(truncated, 0) / documents, 9)::DOUBLE AS rate FROM n LEFT JOIN cut ON n.source IS NOT DISTINCT FROM cut.source
"""

# Words of the rendered page: fixed clean-up, then links, parameters and templates from the inside, one argument a round.
def _rendered(source: str, key: str, name: str) -> str:
    def gone(t: str, pattern: str, by: str = "") -> str:
        return DUCK.replace(t, pattern, by)

    t = "replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
    t = gone(t, r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]")
    t = gone(gone(t, r"(?i)<ref\b[^<>]*/>"), r"(?is)<ref\b[^<>]*>.*?</ref\s*>")
    t = gone(t, r"(?i)<!--|-->|</?(?:br|p|div|hr|li|ul|ol|tr|td|th|table|center|blockquote)\b[^<>]*>", " ")
    t = gone(gone(t, r"</?[a-zA-Z][^<>]*>"), r"'{2,}")
    t = gone(t, r"\[(?:https?:|ftp:)?//[^\s\]]+\s*([^\]\n]*)\]", r"\1")
    step = gone("t", r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", r"\1")
    step = gone(step, r"\{\{\{[^{}|]*\|?([^{}]*)\}\}\}", r"\1")
    step = gone(step, r"\{\{[^{}|]*\|(?:[^|={}]*=)?([^{}|]*)((?:\|[^{}]*)?)\}\}", r" \1{{\2}}")
    step = gone(step, r"\{\{[^{}|]*\}\}")
    return f"""
{name}_steps AS (SELECT {key}, {t} AS t, 0 AS k FROM {source} WHERE text IS NOT NULL UNION ALL SELECT {key}, {step}, k + 1 FROM {name}_steps WHERE t != {step}),
{name}_words AS (SELECT {key}, regexp_extract_all(replace(lower(arg_max(t, k)), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS w FROM {name}_steps GROUP BY {key}),
{name}_windows AS (SELECT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS p FROM {name}_words WHERE len(w) >= 12)"""


_LEAKS = f"""WITH RECURSIVE {_rendered("documents", "doc_id", "doc")}, {_rendered("eval_item", "item_id", "item")}
SELECT doc_id, item_id, count(*)::INT AS windows FROM doc_windows JOIN (SELECT DISTINCT item_id, p FROM item_windows) i USING (p) GROUP BY doc_id, item_id"""
P6_FOUND = f"SELECT doc_id, item_id FROM ({_LEAKS})"

_MIX = f"""
targets AS (SELECT source, max(weight) AS weight, max(max_repeat) AS max_repeat FROM mix_target WHERE source IS NOT NULL GROUP BY source),
docs AS (SELECT doc_id, source, {_UNITS.format("text")}::BIGINT AS tokens FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT source, count(*) AS documents, sum(tokens)::BIGINT AS size FROM docs GROUP BY source),
plan AS (SELECT source, weight, max_repeat, coalesce(documents, 0) AS documents, coalesce(size, 0) AS size, sum(coalesce(size, 0)) OVER ()::BIGINT AS total
    FROM targets LEFT JOIN sizes USING (source)),
sized AS (SELECT *, greatest(10000, (total + 1048575) // 1048576) AS slots FROM plan),
blocked AS (SELECT *, greatest(total / slots, 1.0::DOUBLE) AS block, greatest(ceil(size / greatest(total / slots, 1.0::DOUBLE)), 1)::BIGINT AS blocks FROM sized),
bands AS (SELECT source, sum(weight) OVER (ORDER BY source) / sum(weight) OVER () AS high FROM blocked WHERE weight > 0),
points AS (SELECT slot, ((slot * 2654435769) & 4294967295) / 4294967296.0::DOUBLE AS point FROM range((SELECT max(slots) FROM sized)) r(slot)),
placed AS (SELECT slot, coalesce((SELECT min(source) FROM bands WHERE point < high), (SELECT max(source) FROM bands)) AS source FROM points),
ranked AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM placed),
uses AS (SELECT slot, source, (rank // blocks)::INT AS copy, rank % blocks AS b FROM ranked JOIN blocked USING (source) WHERE rank // blocks < max_repeat),
hashed AS (SELECT doc_id, source, tokens, block, buckets, h, h % buckets AS bucket FROM (
    SELECT doc_id, source, tokens, block, greatest(256, ceil(documents / 262144))::BIGINT AS buckets, ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT AS h
    FROM docs JOIN blocked USING (source) WHERE doc_id IS NOT NULL)),
cut AS (SELECT doc_id, source, tokens,
    floor((sum(tokens) OVER (PARTITION BY source ORDER BY bucket, h, doc_id ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT / block)::BIGINT AS b FROM hashed),
mixed AS (SELECT slot, doc_id, source, copy, tokens FROM cut JOIN uses USING (source, b))"""
P7_MIXED = f"WITH {_MIX} SELECT slot, doc_id, source, copy, tokens FROM mixed"
P7_SHARES = f"""
WITH {_MIX}, got AS (SELECT source, count(*) AS n, sum(tokens)::BIGINT AS t FROM mixed GROUP BY source)
SELECT source, weight, size, max_repeat, size * max_repeat < weight * total AS short, coalesce(n, 0) AS mixed_documents, coalesce(t, 0) AS mixed_tokens,
    round(coalesce(coalesce(t, 0) / nullif(sum(coalesce(t, 0)) OVER (), 0), 0), 9)::DOUBLE AS share FROM blocked LEFT JOIN got USING (source)
"""

SQL = {"p1_found": P1_FOUND, "p2_copies": P2_COPIES, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_terms": P5_TERMS, "p6_found": P6_FOUND, "p6_leaks": _LEAKS, "p7_found": P7_FOUND, "p7_mixed": P7_MIXED, "p7_shares": P7_SHARES, "p8_found": P8_FOUND, "p8_rates": P8_RATES}
