"""Languages: detection by path, and the rules for symbols and imports of each."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language.
EXTENSIONS = {
    ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "jsx", ".ts": "ts", ".mts": "ts", ".cts": "ts", ".tsx": "tsx",
    ".py": "py", ".pyw": "py", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "rb", ".php": "php", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".cs": "cs",
}


def detect_lang_py(path: str) -> str:
    base = path.replace("\\", "/").rpartition("/")[2].lower()
    dot = base.rfind(".")
    return EXTENSIONS.get(base[dot:] if dot >= 0 else "", "text")


def detect_lang(path: Column) -> Column:
    """Language of a path by the last extension of its base name; ``text`` if unknown, null for null."""
    base = F.lower(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1))
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(known, F.regexp_extract(base, r"\.[^.]*$", 0)), F.lit("text")))


# Patterns of declarations, by kind; group 1 is the name.  A word of an identifier:
_ID = r"[A-Za-z_$][\w$]*"
_JS_SYMBOLS = [
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+({_ID})\s*\("),
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_ID})"),
    ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*(?::[^=]+)?=>"),
    ("const", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=(?!.*=>)"),
    (
        "method",
        r"^\s+(?:static\s+)?(?:public\s+|private\s+|protected\s+)?(?:async\s+)?(?:get\s+|set\s+)?"
        rf"(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)({_ID})\s*\(([^()]*)\)\s*(?::[^\{{]+)?\{{",
    ),
    ("other", rf"^\s*export\s+default\s+({_ID})\s*;?\s*$"),
    ("other", rf"^\s*(?:module\.)?exports\.({_ID})\s*="),
]
_TS_SYMBOLS = [
    *_JS_SYMBOLS,
    ("type", rf"^\s*(?:export\s+)?interface\s+({_ID})"),
    ("type", rf"^\s*(?:export\s+)?type\s+({_ID})\s*(?:<[^=]*>)?\s*="),
]
_PY_SYMBOLS = [
    ("def", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("),
    ("class", r"^\s*class\s+([A-Za-z_]\w*)\s*[:(]"),
]
_OTHER_SYMBOLS = [
    ("function", r"^\s*(?:pub\s+|public\s+|private\s+|protected\s+|static\s+)*(?:func|fn|def|function)\s+([A-Za-z_]\w*)\s*\("),
    ("class", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+)*class\s+([A-Za-z_]\w*)"),
    ("other", r"^\s*(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:interface|struct|enum|trait|module)\s+([A-Za-z_]\w*)"),
]
# Patterns of imports; group 1 is the specifier as written.
_JS_IMPORTS = [
    r"^\s*import\s+[^'\"]*from\s+['\"]([^'\"]+)['\"]",
    r"^\s*import\s+['\"]([^'\"]+)['\"]",
    r"^\s*export\s+[^'\"]*from\s+['\"]([^'\"]+)['\"]",
    r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)",
]
_PY_IMPORTS = [r"^\s*from\s+([.\w]+)\s+import\b", r"^\s*import\s+([A-Za-z_][\w.]*)"]
_OTHER_IMPORTS = [
    r"^\s*import\s+\"([^\"]+)\"",
    r"^\s*import\s+([\w.]+)\s*;",
    r"^\s*use\s+([\w:]+)",
    r"^\s*use\s+([\w\\]+)\s*;",
    r"^\s*require(?:_relative)?\s*['\"]?([^'\";\s]+)['\"]?",
    r"^\s*#include\s*[<\"]([^>\"]+)[>\"]",
    r"^\s*using\s+([\w.]+)\s*;",
]

#: The languages of each family; any other has the last family's rules.
FAMILIES = {"js": ("js", "jsx"), "ts": ("ts", "tsx"), "py": ("py",)}
SYMBOL_RULES = {"js": _JS_SYMBOLS, "ts": _TS_SYMBOLS, "py": _PY_SYMBOLS, "other": _OTHER_SYMBOLS}
IMPORT_RULES = {"js": _JS_IMPORTS, "ts": _JS_IMPORTS, "py": _PY_IMPORTS, "other": _OTHER_IMPORTS}


def family_py(lang: str | None) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), "other")


# The characters of white space in the patterns above, the byte-order mark among them.
_SPACES = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def portable(pattern: str) -> str:
    """The pattern for Python, which has other word characters, boundaries and white space: words are ASCII, spaces as above."""

    def outside(m: re.Match) -> str:
        return {"\\w": "[A-Za-z0-9_]", "\\s": f"[{_SPACES}]", "\\S": f"[^{_SPACES}]", "\\b": r"(?a:\b)"}.get(m[0]) or (
            m[0].replace("\\w", "A-Za-z0-9_").replace("\\s", _SPACES) if m[0][0] == "[" else m[0]
        )

    return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\.", outside, pattern)
