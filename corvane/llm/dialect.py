"""The few phrases in which Spark's SQL and DuckDB's differ, so that one statement serves both."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    duck: bool

    def quoted(self, text: str) -> str:
        return "'" + (text.replace("'", "''") if self.duck else text.replace("\\", "\\\\").replace("'", "\\'")) + "'"

    def replace(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.quoted(pattern)}, {self.quoted(by)}{", 'g'" if self.duck else ''})"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.quoted(pattern)})" if self.duck else f"({text} RLIKE {self.quoted(pattern)})"

    def extract_all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.quoted(pattern)}, 1)"

    def octets(self, text: str) -> str:
        return f"strlen({text})" if self.duck else f"octet_length({text})"

    def hash(self, text: str) -> str:
        return f"hash({text})" if self.duck else f"xxhash64({text})"

    def array(self, values: list[str]) -> str:
        listed = ", ".join(self.quoted(v) for v in values)
        return f"[{listed}]" if self.duck else f"array({listed})"

    def list_concat(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})" if self.duck else f"concat({a}, {b})"

    def at(self, array: str, k: int) -> str:
        return f"{array}[{k}]" if self.duck else f"try_element_at({array}, {k})"

    def unnest_zip(self, arrays: list[str], names: list[str]) -> str:
        """Select list that unnests arrays side by side; shorter ones are filled with nulls."""
        if self.duck:
            return ", ".join(f"unnest({a}) AS {n}" for a, n in zip(arrays, names))
        return f"inline(arrays_zip({', '.join(arrays)})) AS ({', '.join(names)})"


SPARK, DUCK = Dialect(False), Dialect(True)
