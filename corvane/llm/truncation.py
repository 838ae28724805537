"""Texts cut off by field limits or in transfer.

Word trigrams are counted inside all texts and at their ends, in SQL.  A text
whose last trigram is frequent inside texts but almost never the last one lost its
end.  Words of four letters and more stand for their class (lower case or
capitalised), numbers for one number, while short words, punctuation and markup stay
as they are.  Trailing ellipses and "[more]" marks are taken off before counting, so
that the text before them is judged.  Copies don't vote: places inside are counted
over distinct texts, ends over distinct tails other than the text's own, and the
verdict goes to every row.

Rates decide, not counts.  An end is a cut if its rate lies below
``MAX_END_RATE`` with the confidence of ``Z`` standard errors, and a way to end if it
lies above ``END_RATE`` so.  Where a trigram is too rare to say either, the trigram
with short words as classes too is asked; where that is too rare as well, the end is a
cut if its last word is almost never an end and its last two are no way to end, so only
a last word that is rare itself stays unjudged.  A short last word may be what a cut left of a longer one, so its
ends are weighed against all places of the two words before it.

A cut may fall on the end of a sentence, which no trigram shows.  Such cuts are
found by the pile-up they leave: a length, in characters or in bytes, anywhere among
those of a source, at which texts gather far above the density on both sides, and of
which a good part ends in a cut by the trigrams, as natural pile-ups (stubs, texts
made by a script) don't.  A limit at one length takes the texts of that length; one
that moves to word ends takes those of its window that don't end in closed markup.  A
text that stops in the middle of a tag, link or template, in half a character or in
white space is cut whatever its last trigram.

Defined results: null and blank texts are not judged, nor are redirects; a null
source is a source of its own; a text whose last word's class is too rare to have an
``END_RATE`` with confidence is no cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.durable import staged
from corvane.llm.dialect import SPARK, Dialect
from corvane.llm.records import distinct_texts
from corvane.parallel import spread

#: End rates below which an end is a cut and above which it is a way to end, and standard errors of confidence.
MAX_END_RATE, END_RATE, Z = 0.002, 0.02, 2.0
TAIL_CHARS = 600
#: Lengths of a limit that moves to word ends, and of the density around a pile-up on either side.
WINDOW, AROUND = 20, 400
#: How far above the density around it a pile-up lies, as a factor and in standard errors, and the share of cut ends it has at least.
PILE_FACTOR, PILE_Z, PILE_CUT = 6, 4.0, 0.2

_MARK = r"\s*(\.\.\.|…|\[(more|\.\.\.|…|truncated|cut|continued)\]|\((more|\.\.\.|…|truncated|cut|continued)\)|&hellip;)\s*\z"

# Ends at which no text stops by itself: white space, half a character, markup that its own line doesn't close.
_OPEN = r"(\s|\x{FFFD}|[\[{<]|\[\[[^\[\]\n]*|\{\{[^{}\n]*|<[^<>\n]*)\z"

# Words and numbers by their classes.
_CLASSES = [
    (r"'{2,}", ""),
    (r"\p{Lu}\p{L}*", "W"),
    (r"\p{Ll}\p{L}{3,}", "w"),
    (r"\d+", "0"),
    (r"<ref\b[^<>\n]*/>", "<r/>"),
    (r"<(?:/ref)\b[^<>\n]*>", "</r>"),
    (r"<ref\b[^<>\n]*>", "<r>"),
]
_TOKEN = r"(\n|\p{L}+|0|\[\[|\]\]|\{\{+|\}\}+|\|\}|\{\||\|\||\|-|==+|<!--|-->|</?r/?>|\.\.\.|\S)"
_ENDED = "c IN ('.', '|}', '-->', '</r>', '<r/>') OR c LIKE '}}%'"
_CLOSED = "c IN (']]', '|}', '-->', ')') OR c LIKE '}}%' OR c LIKE '==%'"


def _tokens(q: Dialect, text: str) -> str:
    """The words and marks of a text, classed, without a mark of continuation at its end."""
    text = q.replace(text, _MARK, "")
    for pattern, by in _CLASSES:
        text = q.replace(text, pattern, by)
    return q.extract_all(text, _TOKEN)


def trigram_counts(q: Dialect, texts: str) -> str:
    """Occurrences of each trigram at any place of texts that differ."""
    grams = q.unnest_zip([f"{q.list_concat(q.array(['^', '^']), 't')}", f"{q.list_concat(q.array(['^']), 't')}", "t"], ["a", "b", "c"])
    listed = f"SELECT {_tokens(q, 'text')} AS t FROM {texts} WHERE trim(text) != ''"
    return f"SELECT a, b, c, count(*) AS n FROM (SELECT {grams} FROM ({listed})) WHERE c IS NOT NULL GROUP BY a, b, c"


def last_trigrams(q: Dialect, docs: str) -> str:
    """The last trigram of each text; only the tail decides it."""
    tail = f"right(text, {TAIL_CHARS})"
    return f"""
    SELECT doc_id, source, chars, bytes, whole, ending, marked, is_open, coalesce({q.at('t', -3)}, '^') AS a, coalesce({q.at('t', -2)}, '^') AS b, {q.at('t', -1)} AS c
    FROM (SELECT doc_id, source, chars, bytes, whole, {q.hash(q.replace('tail', _MARK, ''))} AS ending, {q.matches('tail', _MARK)} AS marked,
            {q.matches('tail', _OPEN)} AS is_open, {_tokens(q, 'tail')} AS t
        FROM (SELECT doc_id, coalesce('s' || source, '') AS source, length(text) AS chars, {q.octets('text')} AS bytes, {q.hash('text')} AS whole, {tail} AS tail
            FROM {docs} WHERE trim(text) != '' AND NOT ltrim(text) ILIKE '#redirect%'))"""


def _bounds(ends: str, places: str) -> tuple[str, str]:
    """Upper and lower bound of a rate of ``ends`` among ``places`` (score interval)."""
    z2 = Z * Z
    middle, spread_ = f"({ends} + {z2 / 2})", f"({Z} * sqrt({ends} * (1.0 - {ends} / greatest({places}, 1.0)) + {z2 / 4}))"
    return f"(({middle} + {spread_}) / ({places} + {z2}))", f"(({middle} - {spread_}) / ({places} + {z2}))"


def judged_trigrams(q: Dialect, last: str, counts: str) -> str:
    """Trigrams that end some text, their places and other ends at four levels, and whether an end in them is a cut.

    Tables of trigrams grow with the texts, so hints keep Spark from broadcasting them.
    """

    def coarse(c: str) -> str:
        return f"CASE WHEN length({c}) <= 3 AND {q.matches(c, '^' + chr(92) + 'p{Ll}+' + chr(92) + 'z')} THEN 'w' ELSE {c} END"

    def rates(ends: str, inside: str) -> tuple[str, str]:
        return _bounds(f"({ends} - 1.0)", f"({inside} + {ends} - 1.0)")

    (upper, _), (_, lower), (upper3, lower3), (_, lower2) = rates("ends", "inside"), rates("ends", "before"), rates("ends3", "inside3"), rates("ends2", "inside2")
    upper1, _ = rates("ends1", "inside1")
    return f"""
    WITH tails AS (SELECT a, b, c, ending, count(DISTINCT whole) AS texts FROM {last} WHERE c IS NOT NULL GROUP BY a, b, c, ending),
    stops AS (SELECT a, b, c, count(*) AS e, sum(texts) AS texts FROM tails GROUP BY a, b, c),
    fine AS (SELECT /*+ MERGE(stops) */ t.a, t.b, t.c, t.n - coalesce(texts, 0) AS inside, coalesce(e, 0) AS ends,
            {coarse("t.a")} AS ca, {coarse("t.b")} AS cb, {coarse("t.c")} AS cc
        FROM {counts} t LEFT JOIN stops ON t.a = stops.a AND t.b = stops.b AND t.c = stops.c),
    pairs AS (SELECT a, b, sum(inside) AS after FROM fine GROUP BY a, b),
    three AS (SELECT ca, cb, cc, sum(inside) AS inside3, sum(ends) AS ends3 FROM fine GROUP BY ca, cb, cc),
    two AS (SELECT cb, cc, sum(inside3) AS inside2, sum(ends3) AS ends2 FROM three GROUP BY cb, cc),
    one AS (SELECT cc, sum(inside2) AS inside1, sum(ends2) AS ends1 FROM two GROUP BY cc)
    SELECT /*+ MERGE(three) */ a, b, c, CASE WHEN {upper} < {MAX_END_RATE} THEN true WHEN {lower} > {END_RATE} THEN false
        WHEN {upper3} < {MAX_END_RATE} THEN true WHEN {lower3} > {END_RATE} OR {lower2} > {END_RATE} THEN false
        ELSE {upper1} < {END_RATE} AND (ends1 - 1.0) / (inside1 + ends1 - 1.0) < {MAX_END_RATE} END AS internal
    FROM (SELECT /*+ MERGE(pairs) */ fine.*, CASE WHEN c = cc THEN inside ELSE after END AS before FROM fine JOIN pairs USING (a, b) WHERE ends > 0) f
    JOIN three USING (ca, cb, cc) JOIN two USING (cb, cc) JOIN one USING (cc)"""


def placed_texts(last: str, judged: str) -> str:
    """The last trigrams with their verdicts."""
    return f"""
    SELECT /*+ MERGE(j) */ doc_id, source, chars, bytes, ending, marked, is_open, d.c, coalesce(internal, false) AS internal
    FROM {last} d LEFT JOIN {judged} j ON d.a = j.a AND d.b = j.b AND d.c = j.c"""


_, _SHARE = _bounds("(cut * 1.0)", "(k * 1.0)")
_HIGH = f"k >= {PILE_FACTOR} * usual AND 2 * (sqrt(k) - sqrt(usual)) >= {PILE_Z} AND {_SHARE} > {PILE_CUT}"


def _piles(texts: str, width: int) -> str:
    """Lengths of each source in both units: distinct ends within ``width`` up to each, those that are cuts, and as many as the density around gives."""
    w = "PARTITION BY source, unit ORDER BY size"
    return f"""
    SELECT source, unit, size, k, cut, {width} * (greatest(coalesce(below, 0), coalesce(above, 0)) + 1.0) / {AROUND} AS usual FROM (
        SELECT source, unit, size, sum(n) OVER ({w} RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS k,
            sum(cut) OVER ({w} RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS cut,
            sum(n) OVER ({w} RANGE BETWEEN {width - 1 + AROUND} PRECEDING AND {width} PRECEDING) AS below,
            sum(n) OVER ({w} RANGE BETWEEN 1 FOLLOWING AND {AROUND} FOLLOWING) AS above
        FROM (SELECT source, unit, size, count(DISTINCT ending) AS n, count(DISTINCT CASE WHEN internal OR is_open THEN ending END) AS cut FROM (
            SELECT source, 'chars' AS unit, chars AS size, ending, internal, is_open FROM {texts} UNION ALL SELECT source, 'bytes', bytes, ending, internal, is_open FROM {texts})
            GROUP BY source, unit, size))"""


def _kept(found: str, texts: str, width: int) -> str:
    """Limits without shadows: where the same texts pile up in both units, the unit in which more of them do is the limit's."""
    return f"""
    SELECT f.source, f.unit, f.size FROM {found} f LEFT JOIN (
        SELECT source, CASE WHEN kc < kb THEN 'chars' ELSE 'bytes' END AS unit, CASE WHEN kc < kb THEN chars ELSE bytes END AS size FROM (
            SELECT c.source, c.size AS chars, b.size AS bytes, c.k AS kc, b.k AS kb, count(DISTINCT p.ending) AS shared
            FROM {texts} p JOIN {found} c ON c.unit = 'chars' AND p.source = c.source AND p.chars BETWEEN c.size - {width - 1} AND c.size
            JOIN {found} b ON b.unit = 'bytes' AND p.source = b.source AND p.bytes BETWEEN b.size - {width - 1} AND b.size GROUP BY c.source, c.size, b.size, c.k, b.k)
        WHERE 2 * shared >= least(kc, kb)) s
    ON f.source = s.source AND f.unit = s.unit AND f.size = s.size WHERE s.size IS NULL"""


def rest_texts(placed: str, sharp: str) -> str:
    """Texts that no sharp limit takes."""
    return f"""
    SELECT p.* FROM {placed} p LEFT JOIN (SELECT source, size FROM {sharp} WHERE unit = 'chars') x ON p.source = x.source AND p.chars = x.size
    LEFT JOIN (SELECT source, size FROM {sharp} WHERE unit = 'bytes') y ON p.source = y.source AND p.bytes = y.size WHERE x.size IS NULL AND y.size IS NULL"""


def spikes(placed: str) -> str:
    """(source, unit, size, k): single lengths at which texts pile up, more of them than at all others near."""
    near = "PARTITION BY source, unit ORDER BY size RANGE BETWEEN {0} PRECEDING AND {0} FOLLOWING"
    return f"""
    SELECT source, unit, size, k FROM (
        SELECT *, max(k) OVER ({near.format(WINDOW)}) AS most, sum(k) OVER ({near.format(WINDOW - 1)}) AS all_near FROM ({_piles(placed, 1)}))
    WHERE {_HIGH} AND k = most AND 2 * k > all_near"""


def sharp_limits(placed: str, found: str) -> str:
    """(source, unit, size): lengths at which a limit takes texts; one in bytes may leave half a character out, or a mark of three bytes in its place."""
    return f"""
    SELECT DISTINCT source, unit, CAST(size + i AS INT) AS size FROM ({_kept(found, placed, 1)})
    CROSS JOIN (SELECT -3 AS i UNION ALL SELECT -2 UNION ALL SELECT -1 UNION ALL SELECT 0 UNION ALL SELECT 1 UNION ALL SELECT 2) o WHERE i = 0 OR unit = 'bytes'"""


def mounds(rest: str) -> str:
    """(source, unit, size, k): upper ends of windows of lengths in which texts pile up."""
    return f"""
    SELECT source, unit, max(size) AS size, k FROM (
        SELECT *, max(k) OVER (PARTITION BY source, unit ORDER BY size RANGE BETWEEN {WINDOW} PRECEDING AND {WINDOW} FOLLOWING) AS most FROM ({_piles(rest, WINDOW)}) WHERE {_HIGH})
    WHERE k = most GROUP BY source, unit, k"""


def wide_limits(rest: str, found: str) -> str:
    return _kept(found, rest, WINDOW)


def cut_texts(placed: str, sharp: str, wide: str) -> str:
    """(doc_id, source, by_limit, by_trigram) of all judged texts."""
    reach = f"CASE WHEN marked THEN {2 * WINDOW} ELSE {WINDOW} END"
    near = f"(l.unit = 'chars' AND d.chars <= l.size AND d.chars > l.size - {reach} OR l.unit = 'bytes' AND d.bytes <= l.size AND d.bytes > l.size - {reach})"
    return f"""
    SELECT d.doc_id, CASE WHEN d.source != '' THEN substr(d.source, 2) END AS source,
        x.size IS NOT NULL OR y.size IS NOT NULL AND (d.bytes >= y.top OR NOT ({_CLOSED})) OR n.doc_id IS NOT NULL AS by_limit,
        coalesce(internal AND NOT ({_ENDED}), false) OR is_open AS by_trigram
    FROM {placed} d
    LEFT JOIN (SELECT source, size FROM {sharp} WHERE unit = 'chars') x ON d.source = x.source AND d.chars = x.size
    LEFT JOIN (SELECT source, size, max(size) OVER (PARTITION BY source ORDER BY size RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) - 2 AS top
        FROM {sharp} WHERE unit = 'bytes') y ON d.source = y.source AND d.bytes = y.size
    LEFT JOIN (SELECT DISTINCT d.doc_id, d.source FROM {placed} d JOIN {wide} l ON d.source = l.source AND {near} WHERE marked OR NOT ({_CLOSED})) n
        ON d.doc_id = n.doc_id AND d.source = n.source"""


def _sql(spark: SparkSession, statement: str, **views: DataFrame) -> DataFrame:
    """A statement over data frames, each named in braces; their views go once it is planned."""
    names = {}
    for name, df in views.items():
        names[name] = f"corvane_{name}_{uuid.uuid4().hex}"
        df.createTempView(names[name])
        statement = statement.replace(f"{{{name}}}", names[name])
    out = spark.sql(statement)
    for view in names.values():
        spark.catalog.dropTempView(view)
    return out


def judged_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, by_limit, by_trigram) for each text that is judged: whether each of the two signs shows a cut."""
    spark = documents.sparkSession
    docs = spread(documents.where("text is not null").select("doc_id", "source", "text"), "doc_id")
    counts = staged(_sql(spark, trigram_counts(SPARK, "{texts}"), texts=distinct_texts(docs, "text")), "trigram-counts")  # read for each level
    last = staged(_sql(spark, last_trigrams(SPARK, "{docs}"), docs=docs), "last-trigrams")  # read twice below
    judged = _sql(spark, judged_trigrams(SPARK, "{last}", "{counts}"), last=last, counts=counts)
    placed = staged(_sql(spark, placed_texts("{last}", "{judged}"), last=last, judged=judged), "placed-texts")  # read for the limits and for the verdicts
    # The tables of limits hold a few rows a source; each is read several times.
    found = staged(_sql(spark, spikes("{placed}"), placed=placed), "spikes")
    sharp = staged(_sql(spark, sharp_limits("{placed}", "{found}"), placed=placed, found=found), "sharp-limits")
    rest = _sql(spark, rest_texts("{placed}", "{sharp}"), placed=placed, sharp=sharp)
    found = staged(_sql(spark, mounds("{rest}"), rest=rest), "mounds")
    wide = staged(_sql(spark, wide_limits("{rest}", "{found}"), rest=rest, found=found), "wide-limits")
    return _sql(spark, cut_texts("{placed}", "{sharp}", "{wide}"), placed=placed, sharp=sharp, wide=wide)


def truncated_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, by_limit, by_trigram) of the texts that were cut."""
    return judged_texts(documents).where("by_limit or by_trigram")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, documents, truncated, rate): how often each source cuts, over its documents with non-null text."""
    cut = truncated_texts(documents).groupBy("source").agg(F.countDistinct("doc_id").alias("truncated"))
    n = documents.where("text is not null").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    joined = n.join(cut, n["source"].eqNullSafe(cut["source"]), "left").select(n["source"], "documents", F.coalesce("truncated", F.lit(0)).alias("truncated"))
    return joined.withColumn("rate", F.col("truncated") / F.col("documents"))
