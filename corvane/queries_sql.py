"""DuckDB SQL with the same results as the engine's queries, built from shared parts."""

from __future__ import annotations

import os
import re

from corvane.functions.lang import EXTENSIONS, FAMILIES, IMPORT_RULES, SYMBOL_RULES
from corvane.functions.paths import NON_SOURCE_DIR, NON_SOURCE_SUFFIX, NON_SOURCE_WORD
from corvane.operators.graph import CANDIDATE_SUFFIXES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pieces(w: str) -> str:
    """Lower-cased identifier and its pieces, with repeats, as a list."""
    s = f"regexp_replace({w}, '[_\\-]+', ' ', 'g')"
    for pattern in ("([a-z])([A-Z])", "([A-Z]+)([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        s = f"regexp_replace({s}, '{pattern}', '\\1 \\2', 'g')"
    return f"list_concat([lower({w})], list_filter(string_split(lower({s}), ' '), lambda p: p != ''))"


def _tf(source: str, keys: str = "") -> str:
    """CTEs that end in tf (keys, id, term, tf), for a source of (keys, id, text)."""
    k = f"{keys}, " if keys else ""
    return f"""
words AS (SELECT {k}id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM {source} WHERE text IS NOT NULL),
counted AS (SELECT {k}id, w, count(*) AS n FROM words GROUP BY ALL),
vocabulary AS (SELECT w, unnest(list_distinct({_pieces("w")})) AS term FROM (SELECT DISTINCT w FROM counted)),
tf AS (SELECT {k}id, term, sum(n)::INT AS tf FROM counted JOIN vocabulary USING (w) WHERE length(term) >= 2 GROUP BY ALL)"""


_DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
_EXT = "regexp_extract(lower(split_part(path, '/', -1)), '\\.[^.]*$')"


def _lang(ext: str = _EXT) -> str:
    return f"coalesce(map {{{', '.join(f'{_q(e)}: {_q(g)}' for e, g in EXTENSIONS.items())}}}[{ext}], 'text')"


_PRIORITY = f"""CASE WHEN regexp_matches(path, {_q(NON_SOURCE_DIR)}) OR regexp_matches(path, {_q(NON_SOURCE_SUFFIX)})
    OR regexp_matches(split_part(path, '/', -1), {_q(NON_SOURCE_WORD)}) THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END"""
_LENGTH = "(length({0}) + length(regexp_replace({0}, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')))"


def _tokens(c: str) -> str:
    return f"ceil({_LENGTH.format(c)} / 4.0)::INT"


# The last scan of each path, and its text.
_NEWEST = """
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC, file_id DESC) AS rn
    FROM files WHERE repo IS NOT NULL AND path IS NOT NULL) WHERE rn = 1)"""


def _symbols(lines: str) -> str:
    """CTEs that end in syms (file_id, name, kind, line, end_line), for lines (file_id, lang, total, n, row)."""
    parts = []
    named = [x for langs in FAMILIES.values() for x in langs]
    for family, rules in SYMBOL_RULES.items():
        where = f"lang IN ({', '.join(map(_q, FAMILIES[family]))})" if family in FAMILIES else f"lang NOT IN ({', '.join(map(_q, named))})"
        for i, (kind, pattern) in enumerate(rules):
            extra = ""
            if pattern.endswith("(?!.*=>)"):  # RE2 has no look-ahead: keep what follows, and look there
                pattern = pattern.removesuffix("(?!.*=>)") + "(.*)$"
                extra = f" AND NOT contains(regexp_extract(row, {_q(pattern)}, 2), '=>')"
            if words := re.search(r"\(\?!((?:\w+\\b\|?)+)\)", pattern):
                pattern = pattern.replace(words[0], "")
                extra = f" AND name NOT IN ({', '.join(_q(w) for w in words[1].replace(chr(92) + 'b', '').split('|'))})"
            parts.append(f"SELECT * FROM (SELECT file_id, total, n, row, {i} AS rule, {_q(kind)} AS kind, regexp_extract(row, {_q(pattern)}, 1) AS name FROM {lines} WHERE {where}) WHERE name != ''{extra}")
    union = "\nUNION ALL ".join(parts)
    return f"""
found AS ({union}),
firsts AS (SELECT file_id, total, n AS line, name, min(rule) AS rule, arg_min(kind, rule) AS kind FROM found GROUP BY ALL),
syms AS (SELECT file_id, name, kind, line::INT AS line,
    coalesce(greatest(line, lead(line) OVER (PARTITION BY file_id ORDER BY line, rule, name) - 1), line)::INT AS e0,
    lead(line) OVER (PARTITION BY file_id ORDER BY line, rule, name) AS following, total FROM firsts),
symbols_of AS (SELECT file_id, name, kind, line, (CASE WHEN following IS NULL THEN total ELSE e0 END)::INT AS end_line FROM syms)"""


_LINES = f"""
texts AS (SELECT file_id, {_lang()} AS lang, string_split(content, chr(10)) AS rows FROM files JOIN file_text USING (file_id) WHERE content IS NOT NULL),
lines AS (SELECT file_id, lang, len(rows) AS total, unnest(rows) AS row, generate_subscripts(rows, 1) AS n FROM texts)"""


def _chunks(keys: str, sized: str, symbols: str, size: int = 60) -> str:
    """CTEs that end in chunks (keys, chunk_index, start_line, end_line, symbol)."""
    return f"""
spans AS (SELECT {keys}, name, greatest(1, least(line, n)) AS a, greatest(1, least(end_line, n)) AS b
    FROM {symbols} JOIN {sized} USING ({keys}) WHERE line IS NOT NULL AND end_line IS NOT NULL),
swept AS (SELECT *, 1 + coalesce(max(b) OVER (PARTITION BY {keys} ORDER BY a, b, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM spans WHERE a <= b),
kept AS (SELECT *, greatest(a, cur) AS s FROM swept WHERE greatest(a, cur) <= b),
regions AS (
    SELECT {keys}, cur AS a, s - 1 AS b, NULL::VARCHAR AS symbol FROM kept WHERE cur < s
    UNION ALL SELECT {keys}, s, b, name FROM kept
    UNION ALL SELECT {keys}, 1 + coalesce(m, 0), n, NULL FROM {sized} LEFT JOIN (SELECT {keys}, max(b) AS m FROM kept GROUP BY ALL) USING ({keys}) WHERE coalesce(m, 0) < n),
windows AS (SELECT {keys}, b, symbol, unnest(range(a, b + 1, {size})) AS s FROM regions),
chunks AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY s) - 1)::INT AS chunk_index, s::INT AS start_line, least(s + {size - 1}, b)::INT AS end_line, symbol FROM windows)"""


# Import graph.
_BASE = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END || '/' || specifier"
_NORMAL = f"regexp_replace(regexp_replace({_BASE}, '(^|/)(\\./)+', '\\1', 'g'), '/\\.$', '')"
for _ in range(10):
    _NORMAL = f"regexp_replace({_NORMAL}, '(^|/)[^/.][^/]*/\\.\\.(/|$)', '\\1')"
_IMPORTS = f"""{_NEWEST},
ahead AS (SELECT repo, path, imports, './' || repeat('../', (len(string_split(path, '/')) - 1)::INT) AS up, lead(path, 1) OVER w AS n1, lead(path, 3) OVER w AS n3
    FROM newest WINDOW w AS (PARTITION BY repo ORDER BY path)),
all_of AS (SELECT repo, path, list_concat(coalesce(imports, []), list_filter([up || n1, up || regexp_replace(n3, '\\.(js|ts|py)$', '')], lambda s: s IS NOT NULL)) AS l FROM ahead),
listed AS (SELECT repo, path, unnest(l) AS specifier, (generate_subscripts(l, 1) - 1)::INT AS ord FROM all_of),
targets AS (SELECT repo, path, ord, rtrim({_NORMAL}, '/') AS target FROM listed WHERE specifier LIKE '.%')"""
_TRIED = " UNION ALL ".join(f"SELECT repo, path AS src, ord, target || '{s}' AS dst, {i} AS r FROM targets" for i, s in enumerate(CANDIDATE_SUFFIXES))
_EDGES = f"""{_IMPORTS},
resolved AS (SELECT repo, src, ord, arg_min(dst, r) AS dst FROM ({_TRIED}) t WHERE EXISTS (SELECT 1 FROM newest n WHERE n.repo = t.repo AND n.path = t.dst) GROUP BY repo, src, ord),
pairs AS (SELECT repo, src, dst, min(ord) AS o FROM resolved WHERE src != dst GROUP BY ALL),
edges AS (SELECT repo, src, dst, (row_number() OVER (PARTITION BY repo, src ORDER BY o, dst) - 1)::INT AS out_pos,
    (row_number() OVER (PARTITION BY repo, dst ORDER BY src) - 1)::INT AS in_pos FROM pairs)"""
_AROUND = f"""{_EDGES},
links AS (SELECT repo, 'imports' AS direction, src AS f, dst AS t FROM edges UNION ALL SELECT repo, 'imported_by', dst, src FROM edges),
one AS (SELECT DISTINCT repo, f AS start, direction, t AS path FROM links),
two AS (SELECT DISTINCT o.repo, start, o.direction, l.t AS path FROM one o JOIN links l ON l.repo = o.repo AND l.direction = o.direction AND l.f = o.path
    WHERE l.t != start AND NOT EXISTS (SELECT 1 FROM one x WHERE x.repo = o.repo AND x.start = o.start AND x.direction = o.direction AND x.path = l.t))"""


def _scores(k1: float = 1.5, b: float = 0.75, task: str = "task") -> str:
    """CTEs that end in bm (task_id, repo, chunk_id, path, start_line, end_line, symbol, score)."""
    return f"""
cand AS (SELECT DISTINCT ON (cand_id) repo, cand_id AS id, file AS path, start_line, end_line, symbol, code AS text FROM candidate WHERE cand_id IS NOT NULL AND repo IS NOT NULL),
{_tf("cand", "repo")},
df AS (SELECT repo, term, count(*) AS df FROM tf GROUP BY ALL),
len_of AS (SELECT cand.repo, id, coalesce(sum(tf), 0)::INT AS doc_len FROM cand LEFT JOIN tf USING (repo, id) GROUP BY ALL),
corpus AS (SELECT repo, count(*) AS n, avg(doc_len) AS avgdl FROM len_of GROUP BY repo),
tasks AS (SELECT task_id, repo, {task} AS task, coalesce(top_n, 20) AS top_n, budget FROM task_run),
tw AS (SELECT task_id, repo, unnest(l) AS w, generate_subscripts(l, 1) AS wi FROM (SELECT task_id, repo, regexp_extract_all(task, '[A-Za-z0-9]+') AS l FROM tasks WHERE task IS NOT NULL)),
tp AS (SELECT task_id, repo, wi, unnest(l) AS term, generate_subscripts(l, 1) AS pi FROM (SELECT task_id, repo, wi, {_pieces("w")} AS l FROM tw)),
t1 AS (SELECT task_id, repo, wi, term, min(pi) AS pi FROM tp WHERE length(term) >= 2 GROUP BY ALL),
t2 AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY wi, pi) AS o FROM t1),
q AS (SELECT task_id, repo, term, count(*)::INT AS q_count, min(o) AS q_ord FROM t2 GROUP BY ALL),
parts AS (SELECT task_id, q.repo, tf.id, q_ord,
    ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * ((tf * ({k1}::DOUBLE + 1)) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * (doc_len / CASE WHEN avgdl = 0 THEN 1.0::DOUBLE ELSE avgdl END)))) * q_count AS c
    FROM q JOIN df USING (repo, term) JOIN corpus USING (repo) JOIN tf ON tf.repo = q.repo AND tf.term = q.term JOIN len_of ON len_of.id = tf.id),
bm0 AS (SELECT task_id, repo, id, sum(c ORDER BY q_ord) AS score FROM parts GROUP BY ALL),
bm AS (SELECT task_id, bm0.repo, id AS chunk_id, path, start_line, end_line, symbol, score FROM bm0 JOIN cand USING (id))"""


_BOOSTED = f"""{_scores()},
names AS (SELECT symbol, list_distinct({_pieces("symbol")}) AS parts FROM (SELECT DISTINCT symbol FROM bm WHERE symbol IS NOT NULL AND symbol != '')),
tq AS (SELECT task_id, list(term ORDER BY o) AS terms FROM t2 GROUP BY task_id),
sb AS (SELECT bm.*, score AS bm25, coalesce(list_filter(terms, lambda t: list_contains(parts, t)), []) AS matched, coalesce(len(list_filter(terms, lambda t: list_contains(parts, t))), 0)::INT AS matches FROM bm JOIN tq USING (task_id) LEFT JOIN names USING (symbol)),
boosted AS (SELECT * EXCLUDE (score), bm25 + CASE WHEN matches > 0 THEN least(1.5::DOUBLE * matches, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS score FROM sb)"""
_GRAPH = f"""{_BOOSTED},
{_EDGES.strip()},
seeds AS (SELECT * FROM (SELECT task_id, repo, path, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path, start_line, chunk_id) AS r FROM boosted) WHERE r <= 10),
reach AS (SELECT repo, src AS source, dst AS path, 0 AS dir, out_pos AS p FROM edges UNION ALL SELECT repo, dst, src, 1, in_pos FROM edges),
near AS (SELECT task_id, path, source AS graph_source FROM (
    SELECT task_id, reach.path, source, row_number() OVER (PARTITION BY task_id, reach.path ORDER BY r, dir, p) AS k
    FROM seeds JOIN reach ON reach.repo = seeds.repo AND reach.source = seeds.path) WHERE k = 1)"""


def _ranked(tests: bool) -> str:
    priority = "1.0::DOUBLE" if tests else _PRIORITY
    return f"""{_GRAPH},
added AS (SELECT boosted.* EXCLUDE (score), graph_source, CASE WHEN graph_source IS NOT NULL THEN score + 0.5::DOUBLE ELSE score END AS s0, {priority} AS priority
    FROM boosted LEFT JOIN near USING (task_id, path)),
final AS (SELECT *, CASE WHEN priority != 1.0 THEN s0 * priority ELSE s0 END AS score FROM added),
ranked AS (SELECT final.*, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path, start_line, chunk_id)::INT AS rank, top_n FROM final JOIN tasks USING (task_id)),
best AS (SELECT * FROM ranked WHERE rank <= top_n)"""


_REASONS = """array_to_string(list_concat(['bm25:' || printf('%.1f', bm25)], list_transform(matched, lambda t: 'symbol:' || t),
    CASE WHEN graph_source IS NOT NULL THEN ['graph:' || split_part(graph_source, '/', -1)] ELSE [] END, CASE WHEN priority != 1.0 THEN ['demoted:0.2'] ELSE [] END), ' ')"""


def _segments(source: str, rank: str) -> str:
    """CTEs that end in segments (task_id, path, rank, start_line, end_line)."""
    return f"""
covered AS (SELECT task_id, path, min({rank}) AS rank, l FROM (SELECT task_id, path, {rank}, unnest(range(start_line, end_line + 1)) AS l FROM {source}) GROUP BY task_id, path, l),
islands AS (SELECT *, l - row_number() OVER (PARTITION BY task_id, path, rank ORDER BY l) AS i FROM covered),
segments AS (SELECT task_id, path, rank, min(l)::INT AS start_line, max(l)::INT AS end_line FROM islands GROUP BY task_id, path, rank, i)"""


_PACKED = f"""{_ranked(False)},
{_segments("best", "rank")},
repo_of AS (SELECT task_id, repo, budget FROM tasks),
cost AS (SELECT s.*, budget, coalesce(array_to_string(list_slice(string_split(content, chr(10)), s.start_line, s.end_line), chr(10)), '') AS text
    FROM segments s JOIN repo_of USING (task_id) LEFT JOIN newest n ON n.repo = repo_of.repo AND n.path = s.path LEFT JOIN file_text f ON f.file_id = n.file_id),
costed AS (SELECT *, {_tokens("text")} AS tokens FROM cost),
fitted AS (SELECT *, sum(tokens) OVER (PARTITION BY task_id ORDER BY rank, start_line ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM costed)"""

_FENCE = """'```' || coalesce(nullif({lang}, ''), 'text') || E'\\n// ' || path || ':' || start_line || '-' || end_line || E'\\n' || text || E'\\n```\\n'"""
_PACK_TEXT = f"""{_PACKED},
shown AS (SELECT *, used <= budget AS inc, {_FENCE.format(lang=_lang())} AS x FROM fitted),
per_file AS (SELECT task_id, path, min(rank) FILTER (inc) AS first, min(rank) FILTER (NOT inc) AS lost, count(*) FILTER (inc) AS n, coalesce(sum(tokens) FILTER (inc), 0) AS used,
    coalesce(string_agg(x, '' ORDER BY start_line) FILTER (inc), '') AS chunks FROM shown GROUP BY task_id, path),
named AS (SELECT *, '## ' || path || E'\\n\\n' || chunks || CASE WHEN lost IS NOT NULL THEN '_(more of ' || path || ' omitted — budget exceeded; see `corvane outline ' || path || E'`)_\\n' ELSE '' END || E'\\n' AS section FROM per_file),
per_task AS (SELECT task_id, sum(n) AS n, count(*) FILTER (n > 0) AS files, sum(used) AS used, string_agg(section, '' ORDER BY first) FILTER (n > 0) AS sections,
    string_agg('- ' || path || ' — see `corvane outline ' || path || E'`\\n', '' ORDER BY lost) FILTER (n = 0) AS gone FROM named GROUP BY task_id)
SELECT r.task_id, rtrim('# corvane pack: ' || coalesce(task, '') || E'\\n\\n' ||
    CASE WHEN coalesce(n, 0) = 0 THEN '_no chunks fit within budget ' || budget || '_' ELSE '_' || n || ' chunk(s) from ' || files || ' file(s), ~' || used || ' tokens (budget ' || budget || ')_' END
    || E'\\n\\n' || coalesce(sections, '') || CASE WHEN gone IS NOT NULL THEN E'## Trimmed (not included)\\n\\n' || gone ELSE '' END, E'\\n') || E'\\n' AS text
FROM task_run r LEFT JOIN per_task USING (task_id)"""

# Imports: the rules of a family in one alternation give the matches in order; of rules that see one place, the longest first.
_ORDER = {"other": [0, 1, 3, 2, 4, 5, 6]}


def _import_lists() -> str:
    cases = []
    for family, rules in IMPORT_RULES.items():
        rules = [rules[i] for i in _ORDER.get(family, range(len(rules)))]
        either = "(?m)" + "|".join(r.replace("(?:", "\0").replace("([", "(?:[").replace("\0", "(?:") for r in rules)
        each = ", ".join(f"nullif(regexp_extract(m, {_q('(?m)' + r)}, 1), '')" for r in rules)
        when = f"lang IN ({', '.join(map(_q, FAMILIES[family]))})" if family in FAMILIES else "true"
        cases.append(f"WHEN {when} THEN list_transform(regexp_extract_all(content, {_q(either)}), lambda m: coalesce({each}))")
    return f"CASE {' '.join(cases)} END"


_RESULTS = "results AS (SELECT DISTINCT task_id, pos, cand_id, file AS path, start_line, end_line FROM rank_result)"
_INDEX = f"""
{_NEWEST.strip()},
texts AS (SELECT file_id, {_lang()} AS lang, string_split(content, chr(10)) AS rows FROM newest JOIN file_text USING (file_id) WHERE content IS NOT NULL),
lines AS (SELECT file_id, lang, len(rows) AS total, unnest(rows) AS row, generate_subscripts(rows, 1) AS n FROM texts),
{_symbols("lines").strip()},
sized AS (SELECT file_id, len(rows) AS n FROM texts),
{_chunks("file_id", "sized", "symbols_of").strip()},
chunk_text AS (SELECT file_id || ':' || chunk_index AS id, array_to_string(list_slice(rows, start_line, end_line), chr(10)) AS text FROM chunks JOIN texts USING (file_id)),
{_tf("chunk_text").strip()},
lengths AS (SELECT id, sum(tf) AS doc_len FROM tf GROUP BY id),
full_chunks AS (SELECT repo, path, chunk_index, start_line, end_line, symbol, coalesce(doc_len, 0)::INT AS doc_len
    FROM chunks JOIN newest USING (file_id) LEFT JOIN lengths ON id = file_id || ':' || chunk_index)"""

SQL: dict[str, str] = {
    "tokenize_tf": f"WITH {_DOCS}, {_tf('docs')} SELECT id AS doc_id, term, tf FROM tf",
    "token_doc_len": f"WITH {_DOCS}, {_tf('docs')} SELECT d.id AS doc_id, coalesce(sum(tf), 0)::INT AS doc_len FROM docs d LEFT JOIN tf USING (id) GROUP BY ALL",
    "corpus_stats": f"WITH {_DOCS}, {_tf('docs')}, l AS (SELECT d.id, coalesce(sum(tf), 0) AS n FROM docs d LEFT JOIN tf USING (id) GROUP BY ALL) SELECT count(*) AS n, round(avg(n), 6) AS avgdl FROM l",
    "term_df_top": f"WITH {_DOCS}, {_tf('docs')} SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY df DESC, term LIMIT 100",
    "raw_token_lengths": "SELECT length(w)::INT AS length, count(*) AS words FROM (SELECT unnest(regexp_extract_all(code, '[A-Za-z0-9]+')) AS w FROM candidate) GROUP BY ALL",
    "identifier_split": f"WITH n AS (SELECT DISTINCT unnest(symbols).name AS name FROM files) SELECT name, array_to_string(list_filter({_pieces('name')}, lambda x, i: list_position({_pieces('name')}, x) = i), ' ') AS parts FROM n WHERE name IS NOT NULL",
    "line_counts": "SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines FROM documents WHERE text IS NOT NULL",
    "line_slice": """WITH c AS (SELECT DISTINCT cand_id, file_id, start_line, end_line FROM candidate)
        SELECT cand_id, substr(sha1(array_to_string(list_slice(string_split(content, chr(10)), start_line, end_line), chr(10))), 1, 12) AS hash FROM c JOIN file_text USING (file_id)""",
    "content_hash": "SELECT file_id, substr(sha1(content), 1, 12) AS hash FROM file_text",
    "token_estimate": f"SELECT cand_id, {_tokens('code')} AS tokens FROM candidate WHERE code IS NOT NULL",
    "lang_detect": f"SELECT file_id, {_lang()} AS lang FROM files",
    "source_priorities": f"SELECT file_id, {_PRIORITY} AS priority FROM files",
    "ignore_filter": """SELECT file_id FROM files WHERE NOT (path LIKE 'docs/%' OR path LIKE '%/docs/%' OR regexp_matches(path, '(^|/)[^/]*\\.test\\.js(/|$)') OR path LIKE 'tools/%'
        OR regexp_matches(path, '^lib/(.*/)?item(/|$)') OR regexp_matches(path, '^src/[^/]*\\.md(/|$)') OR regexp_matches(path, '(^|/)gen[^/](/|$)')
        OR regexp_matches(path, '(^|/)(\\.git|node_modules|\\.corvane)/'))""",
    "binary_size_filter": "SELECT file_id FROM files WHERE size <= 8000",
    "subtree_files": "SELECT file_id FROM files WHERE path = 'src' OR starts_with(path, 'src/')",
    "symbol_extract": f"WITH {_LINES}, {_symbols('lines')} SELECT file_id, name, kind, line, end_line FROM symbols_of",
    "import_extract": f"""WITH t AS (SELECT file_id, {_lang()} AS lang, content FROM files JOIN file_text USING (file_id) WHERE content IS NOT NULL), l AS (SELECT file_id, {_import_lists()} AS l FROM t)
        SELECT file_id, (generate_subscripts(l, 1) - 1)::INT AS ord, unnest(l) AS specifier FROM l""",
    "numbered_lines": """WITH c AS (SELECT DISTINCT cand_id, start_line, code FROM candidate WHERE code IS NOT NULL AND start_line IS NOT NULL)
        SELECT cand_id, substr(sha1(array_to_string(list_transform(string_split(code, chr(10)), lambda r, i: (start_line + i - 1) || ': ' || r), chr(10))), 1, 12) AS hash FROM c""",
    "posix_paths": "SELECT file_id, path FROM files",
    "file_numbers": "SELECT path, (row_number() OVER (ORDER BY path) - 1)::INT AS file_index FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL)",
    "outline_files": f"""WITH {_NEWEST}, s AS (SELECT repo, path, unnest(symbols) AS s, (generate_subscripts(symbols, 1) - 1)::INT AS ord FROM newest)
        SELECT repo, path, ord, '  ' || s.kind || ' ' || s.name || '  (L' || s.line || '-L' || s.end_line || ')' AS line FROM s""",
    "tree_scan": f"SELECT substr(filename, {len(os.path.dirname(os.path.abspath(__file__))) + 2}) AS path, size::BIGINT AS size FROM read_blob({_q(os.path.dirname(os.path.abspath(__file__)) + '/**/*.py')})",
    "chunk_windows_60": "WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, n, unnest(range(1, n + 1, 60)) AS s FROM l) "
    "SELECT doc_id, ((s - 1) // 60)::INT AS chunk_index, s::INT AS start_line, least(s + 59, n)::INT AS end_line FROM w",
    "chunk_windows_4": "WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, n, unnest(range(1, n + 1, 4)) AS s FROM l) "
    "SELECT doc_id, ((s - 1) // 4)::INT AS chunk_index, s::INT AS start_line, least(s + 3, n)::INT AS end_line FROM w",
    "chunk_with_symbols": f"WITH sized AS (SELECT file_id, n_lines AS n FROM files WHERE n_lines >= 1), sym AS (SELECT file_id, s.name AS name, s.line AS line, s.end_line AS end_line FROM (SELECT file_id, unnest(symbols) AS s FROM files)), "
    f"{_chunks('file_id', 'sized', 'sym')} SELECT * FROM chunks",
    "index_chunks": f"WITH {_INDEX} SELECT * FROM full_chunks",
    "index_summary": f"WITH {_INDEX} SELECT repo, count(DISTINCT path) AS files, count(*) AS chunks, round(avg(doc_len), 6) AS avgdl FROM full_chunks GROUP BY repo",
    "path_normalize": f"WITH {_IMPORTS} SELECT repo, path, ord, target FROM targets",
    "import_resolve": f"WITH {_EDGES} SELECT repo, src, ord, dst FROM resolved",
    "graph_edges": f"WITH {_EDGES} SELECT repo, src, dst, out_pos, in_pos FROM edges",
    "neighbors_depth1": f"WITH {_AROUND} SELECT repo, start, direction, path, 1 AS hops FROM one",
    "neighbors_depth2": f"WITH {_AROUND} SELECT repo, start, direction, path, 1 AS hops FROM one UNION ALL SELECT repo, start, direction, path, 2 FROM two",
    "neighbors_depth5": f"""WITH RECURSIVE {_AROUND}, around AS (SELECT repo, start, direction, path, 1 AS hops FROM one WHERE path != start
        UNION SELECT a.repo, start, a.direction, l.t, hops + 1 FROM around a JOIN links l ON l.repo = a.repo AND l.direction = a.direction AND l.f = a.path WHERE hops < 5 AND l.t != start)
        SELECT repo, start, direction, path, min(hops)::INT AS hops FROM around GROUP BY ALL""",
    "rank_reasons": f"WITH {_ranked(False)} SELECT task_id, rank, {_REASONS} AS reasons FROM best",
    "pack_text": f"WITH {_PACK_TEXT}",
    "postings_lookup": f"WITH {_scores()} SELECT task_id, term, q_count, df FROM q JOIN df USING (repo, term)",
    "bm25_score": f"WITH {_scores()} SELECT task_id, chunk_id, round(score, 6) AS score FROM bm",
    "bm25_params": f"WITH {_scores(1.2, 0.5)} SELECT task_id, chunk_id, round(score, 6) AS score FROM bm",
    "bm25_dup_terms": f"WITH {_scores(task=chr(116) + 'ask || chr(32) || task')} SELECT task_id, chunk_id, round(score, 6) AS score FROM bm",
    "symbol_boost": f"WITH {_BOOSTED} SELECT task_id, chunk_id, matches, round(score, 6) AS score FROM boosted",
    "graph_boost": f"WITH {_GRAPH} SELECT * FROM near",
    "rank_full": f"WITH {_ranked(False)} SELECT task_id, rank, chunk_id, round(score, 6) AS score, matches, graph_source, priority FROM best",
    "rank_with_tests": f"WITH {_ranked(True)} SELECT task_id, rank, chunk_id, round(score, 6) AS score FROM best",
    "fit_budget": f"""WITH {_RESULTS}, s AS (SELECT DISTINCT cand_id, {_tokens("code")} AS size FROM candidate WHERE code IS NOT NULL),
        u AS (SELECT task_id, pos, budget, sum(size) OVER (PARTITION BY task_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM results JOIN s USING (cand_id) JOIN task_run USING (task_id))
        SELECT task_id, pos, used, used <= budget AS included FROM u""",
    "range_subtract": f"""WITH {_RESULTS}, wide AS (SELECT task_id, path, pos, greatest(1, start_line - 10) AS start_line, end_line + 10 AS end_line FROM results),
        {_segments("wide", "pos")} SELECT task_id, path, rank AS pos, start_line, end_line FROM segments""",
    "pack_included": f"WITH {_PACKED} SELECT task_id, rank, path, start_line, end_line, tokens, used FROM fitted WHERE used <= budget",
    "pack_trimmed": f"""WITH {_PACKED}, l AS (SELECT task_id, path, NOT bool_or(used <= budget) AS fully, min((rank, start_line)) FILTER (used > budget) AS k FROM fitted GROUP BY task_id, path HAVING bool_or(used > budget))
        SELECT task_id, path, fully, (row_number() OVER (PARTITION BY task_id ORDER BY k) - 1)::INT AS pos FROM l""",
    "outline_tree": f"""WITH {_NEWEST}, p AS (SELECT repo, path, string_split(path, '/') AS parts, symbols FROM newest),
        t AS (
            SELECT repo, list_concat(list_transform(list_slice(parts, 1, len(parts) - 1), lambda x: '0' || x), ['1' || parts[-1]]) AS k, (len(parts) - 1)::INT AS depth,
                parts[-1] || CASE WHEN len(symbols) > 0 THEN ' (' || array_to_string(list_transform(symbols, lambda s: concat_ws(' ', s.kind, s.name)), ', ') || ')' ELSE '' END AS x FROM p
            UNION ALL SELECT DISTINCT repo, list_transform(list_slice(parts, 1, i), lambda x: '0' || x), (i - 1)::INT, parts[i] || '/'
                FROM (SELECT repo, parts, unnest(range(1, len(parts))) AS i FROM p))
        SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY k)::INT AS pos, depth, repeat('  ', depth) || x AS line FROM t""",
    "lang_statistics": f"WITH {_NEWEST} SELECT repo, {_lang()} AS lang, count(*) AS files FROM newest GROUP BY ALL",
    "rescans": f"""WITH {_NEWEST}, o AS (SELECT * FROM (SELECT repo, path, hash, row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC, file_id DESC) AS n
        FROM files WHERE indexed_at < TIMESTAMPTZ '2024-01-01 00:00:00+00') WHERE n = 1)
        SELECT repo, path, CASE WHEN p IS NULL THEN 'added' ELSE 'changed' END AS change FROM newest LEFT JOIN (SELECT *, path AS p FROM o) o USING (repo, path)
        WHERE p IS NULL OR newest.hash IS DISTINCT FROM o.hash""",
}
