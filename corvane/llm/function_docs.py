"""Functions paired with their documentation.

Each file is parsed by a packrat grammar of its language: comments, what may stand
between them and a function, the functions themselves (those of the file's symbols),
in Python the string that begins a body, and where a body ends.  Its actions keep
source offsets and emit documentation-function pairs.
A comment block or an unbroken run of comment lines belongs to the function if
it ends on the line directly above, or above decorator lines; so does a string
that is the first statement of a Python body.  Pairs are dropped unless the
documentation holds ``MIN_WORDS`` words of prose besides the words of the
function's name; comment marks, tags with their types and parameter names, linter
directives and commented-out code are no prose.

Code between comments is one terminal, so a file is read once at the speed of the
regular expressions, and only functions that come out have their ends parsed.

Defined results: null text, null symbols, symbols without a line or beyond the
end of the text give nothing; several symbols on one line are one pair each; a
function whose end the grammar doesn't find (brackets never closed) ends where its
symbol does, or with the line before the next symbol.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.lang import detect_lang_py
from corvane.functions.textops import split_identifier
from corvane.llm.peg import Expression, Result, action, balanced, choice, many, maybe, rule, seq, term

MIN_WORDS = 4
KINDS = ("function", "method", "def")

HASH, SLASH = "#", "//"
#: Comment styles by language: line marks, block comments, decorator lines.
_STYLE = {"py": (HASH, False, r"@"), "rb": (HASH, False, r"@(?!@)"), "php": ("//|#(?!\\[)", True, r"#\["), "rust": (SLASH, True, r"#!?\["), "cs": (SLASH, True, r"\["), "text": ("//|#", True, r"@")}
_DEFAULT = (SLASH, True, r"@|\[\[")


def listed(s: str, i: int, memo: dict) -> Result:
    """The start of a line on which the file's symbols have a function; its value is the place."""
    return (i, i) if i in memo["functions"] else None


class Grammar:
    """A language's rules: comments, decorators, strings, and documented functions made of them."""

    def __init__(self, lang: str):
        marks, blocks, decorator = _STYLE.get(lang, _DEFAULT)
        self.python, self.ruby = lang == "py", lang == "rb"
        eol = r"[^\n]*(?:\n|\Z)"
        run = rule(many(term(rf"[ \t]*(?:{marks}){eol}"), 1))
        block = rule(term(r"[ \t]*/\*[^*]*\*+(?:[^/*][^*]*\*+)*/[ \t]*\r?(?:\n|\Z)"))
        comment = choice(block, run) if blocks else run
        documentation = action(comment, lambda s, a, b, v: (a, b))
        decorators = many(rule(term(rf"[ \t]*(?:{decorator}){eol}")))
        documented = action(seq(documentation, decorators, listed), lambda s, a, b, v: (v[2], v[0]))
        opener = rf"{marks}|/\*" if blocks else marks
        code = term(rf"(?:(?![ \t]*(?:{opener}))[^\n]*\n)+|{eol}")
        other = action(choice(comment, code), lambda s, a, b, v: None)
        #: Values are (place of a function, span of its documentation), None for other comments and code.
        self.source: Expression = many(choice(documented, other))

        quoted = choice(
            term(r"'''(?:[^\\]|\\.)*?'''", re.S),
            term(r'"""(?:[^\\]|\\.)*?"""', re.S),
            term(r"'(?:[^'\\\n]|\\.)*'"),
            term(r'"(?:[^"\\\n]|\\.)*"'),
        )
        note = term(r"#[^\n]*") if marks != SLASH else term(r"//[^\n]*|/\*.*?\*/", re.S)
        if marks.startswith(SLASH) and marks != SLASH:
            note = choice(term(r"//[^\n]*|/\*.*?\*/", re.S), note)
        skip = choice(note, rule(quoted), term(r"`(?:[^`\\]|\\.)*`", re.S)) if not self.python else choice(note, rule(quoted))
        nested = rule(balanced(skip))
        header = seq(term(r"[ \t]*(?:async[ \t]+)?def\b[^(\n]*"), nested, many(choice(term(r"[^:\[\](){}'\"#\n]+"), rule(quoted), nested)), term(r":"))
        gap = many(choice(term(r"[ \t\r]+"), term(r"\n"), term(r"#[^\n]*")))
        literal = seq(maybe(term(r"[rRuU]{1,2}(?=['\"])")), action(quoted, lambda s, a, b, v: (a, b)))
        #: A Python function with a string as its first statement; the value is the string's span.
        self.body_string: Expression = action(seq(header, gap, literal), lambda s, a, b, v: v[2][1])
        self.header = header
        #: A function in braces, or a statement up to its semicolon.
        part = choice(term(r"[^(){}\[\];'\"`/#]+"), skip, rule(balanced(skip, "([", ")]")), term(r"[/#'\"`]"))
        self.braced: Expression = seq(many(part), choice(balanced(skip), term(";")))

    def end(self, s: str, start: int, before: int, memo: dict) -> int | None:
        """Where the function that starts at ``start`` ends; its body begins before ``before``, the next symbol."""
        if self.python or self.ruby:
            if self.python and (r := self.header(s, start, memo)) is None:
                return None
            indent = len(_INDENT.match(s, start)[0].expandtabs())
            at = last = s.find("\n", r[0] if self.python else start) + 1 or len(s)
            while at < len(s):  # deeper and blank lines, and Ruby's closing word
                stop = s.find("\n", at) + 1 or len(s)
                row = s[at:stop]
                if row.strip() and len(_INDENT.match(row)[0].expandtabs()) <= indent and not row.lstrip().startswith((")", "]", "}")):
                    return stop if self.ruby and row.split()[0] in ("end", "end;") else last
                if row.strip():
                    last = stop
                at = stop
            return last
        opening = s.find("{", start)
        if not start <= opening < before and ";" not in s[start:before]:
            return None
        r = self.braced(s, start, memo)
        return r[0] if r else None


_INDENT = re.compile(r"[ \t]*")
_grammars: dict[str, Grammar] = {}


def grammar(lang: str) -> Grammar:
    if lang not in _grammars:
        _grammars[lang] = Grammar(lang)
    return _grammars[lang]


_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?!/)|//+!?|#+[:!]?(?!\[)|--+)?\s?")
_CLOSE = re.compile(r"\s*\*+/\s*$")
_QUOTE = re.compile(r"^(?:'''|\"\"\"|['\"])|(?:'''|\"\"\"|['\"])$")
_DIRECTIVE = re.compile(
    r"^\s*(?:eslint|tslint|jshint|jslint|jscs|prettier|istanbul|c8|v8|webpack|biome|stylelint|flow|@flow|@ts-|ts-|@jsx|"
    r"pylint|noqa|flake8|mypy|type:|pyright|pyre|isort|yapf|fmt:|ruff|bandit|nosec|pragma|coverage|doctest|"
    r"nolint|go:|\+build|lint:|golint|staticcheck|revive|rubocop|frozen_string_literal|sorbet|typed:|reek|steep|"
    r"phpcs|phpstan|psalm|@phpstan|@psalm|@codingStandards|clippy|rustfmt|checkstyle|CHECKSTYLE|spotless|NOPMD|NOSONAR|SuppressWarnings|noinspection|@SuppressWarnings|"
    r"clang-format|clang-tidy|NOLINT|cppcheck|cspell|region|endregion|sourceMappingURL|vim:|-\*-|ReSharper|pragma)",
    re.I,
)
_CODE = re.compile(
    r"^\s*(?:[\w.$@\[\]'\"]+\s*(?::=|[-+*/|&]?=(?!=)|=>|<<)\s*\S.*"  # assignments
    r"|(?:(?:await|return|throw|raise|yield|new|delete|let|const|var|echo|print|puts)\s+)?[\w.$>:@-]*[\w$]\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?"  # calls
    r"|(?:if|for|while|switch|elif|unless|foreach)\s*\(?.*[{:]|(?:else|try|do)\s*[{:]|[{}()\[\];,]+"
    r"|(?:import|from|use|require|include|package|using)\b.*[;'\">]|return\b[^.]*;|.*;)\s*$"
)
_INLINE_TAG = re.compile(r"\{@\w+[^{}]*\}")
_PARAM_TAG = re.compile(r"^\s*[@\\](?:param|arg|argument|prop|property|attr|tparam|template|typedef|throws|exception|raises)\b(?:\s*\{[^{}]*\})?(?:\s+(?:[\w\\|?\[\]<>]+\s+)?(?:\[[^\]]*\]|[$&*.]*\$[\w]+)|\s+[\w.$\[\]=]+)?")
_OTHER_TAG = re.compile(r"^\s*[@\\][A-Za-z][\w-]*(?:\s*\{[^{}]*\})?")
_FIELD = re.compile(r"^\s*:(?:param|parameter|arg|argument|key|keyword|type|raises|raise|except|exception|var|ivar|cvar|vartype|returns?|rtype|yields?|meta)\b[^:\n]*:")
_TYPE_FIELD = re.compile(r"^\s*:(?:type|rtype|vartype)\b.*$")
_SECTION = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Attributes|Keyword Args|Keyword Arguments|Other Parameters|Returns?|Yields?|Raises|Throws|Examples?|Notes?|See Also|References|Warnings?|Todo)\s*:?\s*$", re.I)
_ENTRY = re.compile(r"^\s*\*{0,2}\w+\s*(?:\([^()]*\))?\s*:(?!:)")
_TODO = re.compile(r"^\s*(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b(?:\([^)]*\))?:?", re.I)
_HTML = re.compile(r"</?[a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W\d]\w*(?:['’][^\W\d_]+)?")


def prose_words(documentation: str, name: str) -> int:
    """Words of prose in a comment or string, besides the words of ``name``."""
    own = set(split_identifier(name.lstrip("$"))) | {name.lower()}
    words = 0
    entries = False
    body = documentation.strip()
    if body[:1] in "'\"":
        body = _QUOTE.sub("", body)
        body = _QUOTE.sub("", body).strip("'\"")
    for row in body.split("\n"):
        row = _CLOSE.sub("", _MARKS.sub("", row, count=1))
        if not row.strip():
            continue
        if _SECTION.match(row):
            entries = bool(re.match(r"\s*(?:arg|param|attr|key|other|raise|throw)", row, re.I))
            continue
        if _DIRECTIVE.match(row) or _CODE.match(row) or _TYPE_FIELD.match(row):
            continue
        row = _INLINE_TAG.sub(" ", row)
        tagged = _PARAM_TAG.sub(" ", row, count=1)
        if tagged == row:
            tagged = _OTHER_TAG.sub(" ", row, count=1)
        if tagged == row:
            tagged = _FIELD.sub(" ", row, count=1)
        if tagged == row and entries:
            tagged = _ENTRY.sub(" ", row, count=1)
        row = _TODO.sub(" ", _HTML.sub(" ", tagged))
        words += sum(w.lower() not in own for w in _WORD.findall(row))
    return words


OUT = pa.schema(
    [("file_id", pa.int64()), ("sym_line", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("end_line", pa.int32()),
     ("doc_start", pa.int32()), ("doc_end", pa.int32()), ("words", pa.int32()), ("documentation", pa.string()), ("code", pa.string())]
)
DDL = "file_id long, sym_line int, name string, kind string, end_line int, doc_start int, doc_end int, words int, documentation string, code string"


def pairs_of(text: str, lang: str, symbols: list[dict], min_words: int = MIN_WORDS) -> list[tuple]:
    """Documentation-function pairs of one file, in symbol order."""
    rows = text.split("\n")
    starts = [0]
    for row in rows:
        starts.append(starts[-1] + len(row) + 1)
    g = grammar(lang)
    wanted = sorted({(s["line"], s["name"] or "", s["kind"], s["end_line"]) for s in symbols if s and s["line"] is not None and 1 <= s["line"] <= len(rows) and s["kind"] in KINDS}, key=lambda s: s[:3])
    memo: dict = {"functions": {starts[s[0] - 1] for s in wanted}}
    spans: dict[int, list[tuple[int, int]]] = {}
    for place, span in filter(None, g.source(text, 0, memo)[1]):
        spans.setdefault(place, []).append(span)
    if g.python:
        for place in memo["functions"]:
            if r := g.body_string(text, place, memo):
                spans.setdefault(place, []).append(r[1])
    at = sorted({s["line"] for s in symbols if s and s["line"] is not None})
    after = {a: b - 1 for a, b in zip(at, at[1:])}
    out = []
    for line, name, kind, end in wanted:
        best = None
        for a, b in spans.get(starts[line - 1], ()):
            n = prose_words(text[a:b], name)
            if n >= min_words and (best is None or n > best[0]):
                best = (n, a, b)
        if best:
            following = min(after.get(line, len(rows)), len(rows))
            stop = g.end(text, starts[line - 1], starts[max(line, following)], memo)
            if stop is None:
                last = max(line, min(end if end is not None else following, len(rows)))
            else:
                last = max(line, text.count("\n", 0, stop) + (not text[:stop].endswith("\n")))
            n, a, b = best
            out.append((line, name, kind, last, a, b, n, text[a:b].strip("\n"), "\n".join(rows[line - 1 : last])))
    return out


def _run(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for file_id, path, lang, symbols, text in zip(*(c.to_pylist() for c in batch.columns)):
                known = (lang or "").lower() or detect_lang_py(path or "")
                found += [(file_id, *p) for p in pairs_of(text, known, symbols, min_words)]
            columns = list(zip(*found)) or [()] * len(OUT)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, OUT)], schema=OUT)

    return run


def documented_functions(files: DataFrame, file_text: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """(file_id, sym_line, name, kind, end_line, doc_start, doc_end, words, documentation, code), one row per pair.

    ``doc_start`` and ``doc_end`` are character offsets in the file's text.
    """
    wanted = files.where("symbols is not null and file_id is not null and exists(symbols, s -> s.kind in ('function', 'method', 'def'))")
    both = wanted.select("file_id", "path", "lang", "symbols").join(file_text.where("content is not null").select("file_id", "content"), "file_id")
    return both.select("file_id", "path", "lang", "symbols", "content").mapInArrow(_run(min_words), DDL)
