"""Splitting oversized items at natural boundaries.

Recursive bisection: an item above the limit is cut at the strongest boundary
near its midpoint, and halves that would still exceed the limit with their
overlap are cut again.  Every piece after the first then starts with the last
three lines of the piece before.  Sizes are UTF-16 units; four make a token.

A line that doesn't fit the limit by itself is cut inside, at white space or
punctuation where there is any in its middle half, with 40 characters of overlap.
Where three lines of overlap would leave no room for new text, as many whole
lines as fit are shared, and if not even one does, 40 characters.

Defined results: null text gives no piece; a text within the limit is one piece,
itself; surrogate pairs are never cut apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.textops import lines, utf16_units

LIMIT_TOKENS = 384
OVERLAP_LINES = 3
OVERLAP_CHARS = 40
BROADCAST_CHUNKS = 1_000_000
#: Share of the span, on either side of its midpoint, in which a cut is looked for.
NEAR = 0.25

_BLOCK_END = re.compile(r"^\s*(?:[})\]]+[;,]?|end|fi|done|esac)\s*$")
_OPENER = re.compile(
    r"^\s*(?:(?:export|public|private|protected|static|async|pub|abstract|final|default)\s+)*"
    r"(?:function|class|def|fn|func|interface|struct|enum|trait|module|impl|type|const|let|var)\b"
)
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|\"\"\"|''')")


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text) + sum(c > "￿" for c in text)


def boundary_strength(before: str, after: str) -> int:
    """How natural a cut between two lines is: 0 inside running code, more at blank lines, block ends and new definitions."""
    indent = len(after) - len(after.lstrip())
    score = 0
    if not before.strip():
        score += 4
    if _BLOCK_END.match(before):
        score += 3
    if _OPENER.match(after) or _COMMENT.match(after):
        score += 2
    if after.strip() and indent == 0:
        score += 2
    elif after.strip() and indent <= 4:
        score += 1
    if not after.strip():
        score -= 1
    return score


def _cut_line(text: str, limit: int) -> list[str]:
    """A long line in fragments of at most ``limit`` units, by bisection at white space or punctuation within ``NEAR`` of its length from the middle."""
    if units(text) <= limit:
        return [text]
    m = len(text) // 2
    reach = int(NEAR * len(text))
    cut = m
    for marks in (" \t", ",;|)}]"):
        found = [text.rfind(c, m - reach - 1, m) for c in marks] + [text.find(c, m, m + reach) for c in marks]
        if near := [i + 1 for i in found if i >= 0]:
            cut = min(near, key=lambda i: (abs(i - m), i))
            break
    return _cut_line(text[:cut], limit) + _cut_line(text[cut:], limit)


def split_text(text: str, limit_tokens: int = LIMIT_TOKENS) -> list[dict]:
    """Pieces of ``text``: first and last line (from 1), the text, and how much of its start repeats the piece before."""
    limit = 4 * limit_tokens
    rows = text.split("\n")
    if units(text) <= limit:
        return [{"piece": 0, "first_line": 1, "last_line": len(rows), "shared_lines": 0, "shared_chars": 0, "text": text}]
    # Atoms: whole lines, and fragments of lines too long to stand beside an overlap.
    atoms: list[str] = []
    line: list[int] = []
    for i, row in enumerate(rows):
        fragments = _cut_line(row, limit - 2 * OVERLAP_CHARS - 1)
        atoms += fragments
        line += [i] * len(fragments)
    n = len(atoms)
    inside = [i > 0 and line[i] == line[i - 1] for i in range(n)] + [False]  # no line break before the atom
    whole = [not inside[i] and not inside[i + 1] for i in range(n)]
    end = [0]
    for i, atom in enumerate(atoms):
        end.append(end[-1] + units(atom) + (not inside[i]))
    strength = [0] + [-5 if inside[i] else boundary_strength(atoms[i - 1], atoms[i]) for i in range(1, n)]

    def size(a: int, b: int) -> int:
        return end[b] - end[a] - (not inside[a])

    def joined(a: int, b: int) -> str:
        return "".join(("" if i == a or inside[i] else "\n") + atoms[i] for i in range(a, b))

    out: list[dict] = []
    start = 0  # first whole-line atom that the last piece holds
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        s = a  # first shared atom
        while s > start and a - s < OVERLAP_LINES and whole[s - 1]:
            s -= 1
        if size(s, b) > limit or s == a and a and size(a, b) + OVERLAP_CHARS + 1 > limit:
            if b - a > 1:
                middle, reach = (end[a] + end[b]) / 2, NEAR * (end[b] - end[a])
                near = [i for i in range(a + 1, b) if abs(end[i] - middle) <= reach] or range(a + 1, b)
                cut = max(near, key=lambda i: (strength[i], -abs(end[i] - middle)))
                todo += [(cut, b), (a, cut)]
                continue
            while s < a and size(s, b) > limit:
                s += 1
        lead, glue = "", ""
        if s == a and a:
            lead, glue = atoms[a - 1][-OVERLAP_CHARS:], "" if inside[a] else "\n"
            while units(lead) + len(glue) + size(a, b) > limit:
                lead = lead[1:]
        first = line[a - 1] if lead or s == a and a and glue else line[s]
        out.append(
            {
                "piece": len(out),
                "first_line": first + 1,
                "last_line": line[b - 1] + 1,
                "shared_lines": a - s,
                "shared_chars": len(lead),
                "text": lead + glue + joined(s, b),
            }
        )
        start = s
    return out


PIECES = "array<struct<piece:int,first_line:int,last_line:int,shared_lines:int,shared_chars:int,text:string>>"


def pieces_of(text: Column, limit_tokens: int = LIMIT_TOKENS) -> Column:
    """Array of the pieces of each text."""

    @F.pandas_udf(PIECES)
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            yield s.map(lambda t: split_text(t, limit_tokens) if t is not None else None)

    return run(text)


def chunk_texts(included: DataFrame, candidates: DataFrame) -> DataFrame:
    """(chunk_id, start_line, end_line, text): each chunk's lines, cut from its candidate's code, once per chunk.

    Chunks whose candidate is missing or unreadable, or whose range lies outside it, have no text and are left out.
    The chunks, four numbers each, are broadcast up to ``BROADCAST_CHUNKS`` of them, so that no code is shuffled; beyond
    that the join is a plain equi-join on cand_id, and a candidate with very many chunks is split by adaptive execution.
    """
    c = included.select("chunk_id", "cand_id", "start_line", "end_line").where("cand_id is not null and start_line is not null and end_line is not null")
    if c.count() <= BROADCAST_CHUNKS:
        c = F.broadcast(c)
    code = candidates.where("code is not null and start_line is not null").select("cand_id", F.col("start_line").alias("_from"), "code")
    rows = lines(F.col("code"))
    first = F.greatest(F.lit(1), F.col("start_line") - F.col("_from") + 1)
    n = F.least(F.size(rows), F.col("end_line") - F.col("_from") + 1) - first + 1
    return c.join(code, "cand_id").where(n > 0).select(
        "chunk_id", "start_line", "end_line", F.array_join(F.slice(rows, first, F.greatest(n, F.lit(0))), "\n").alias("text")
    )


def oversized_pieces(included: DataFrame, candidates: DataFrame, *, limit_tokens: int = LIMIT_TOKENS) -> DataFrame:
    """(chunk_id, piece, start_line, end_line, shared_lines, shared_chars, tokens, text) for each chunk above the limit."""
    over = chunk_texts(included, candidates).where(F.ceil(utf16_units(F.col("text")) / 4) > limit_tokens).dropDuplicates(["chunk_id"])
    return (
        over.select("chunk_id", F.col("start_line").alias("_s"), F.explode(pieces_of(F.col("text"), limit_tokens)).alias("p"))
        .select(
            "chunk_id",
            "p.piece",
            (F.col("_s") + F.col("p.first_line") - 1).alias("start_line"),
            (F.col("_s") + F.col("p.last_line") - 1).alias("end_line"),
            "p.shared_lines",
            "p.shared_chars",
            F.ceil(utf16_units(F.col("p.text")) / 4).cast("int").alias("tokens"),
            "p.text",
        )
    )
