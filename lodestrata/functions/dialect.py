"""Expressions that are written once and rendered for Spark SQL or for DuckDB."""

from __future__ import annotations


class Dialect:
    """Text of the few functions whose names or arguments differ."""

    def __init__(self, name: str):
        self.name, self.spark = name, name == "spark"

    def text(self, value: str) -> str:
        """A string literal; backslashes stand for themselves."""
        if self.spark:
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + value.replace("'", "''") + "'"

    def replaced(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}" + ("" if self.spark else ", 'g'") + ")"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.text(pattern)})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def all_matches(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def pieces(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.text(pattern)}, -1)" if self.spark else f"regexp_split_to_array({x}, {self.text(pattern)})"

    def mapped(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})" if self.spark else f"list_transform({array}, lambda {var}: {body})"

    def kept(self, array: str, var: str, body: str) -> str:
        return f"filter({array}, {var} -> {body})" if self.spark else f"list_filter({array}, lambda {var}: {body})"

    def joined(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})" if self.spark else "(" + " || ".join(arrays) + ")"

    def among(self, x: str, values) -> str:
        return f"{x} in ({', '.join(self.text(v) for v in sorted(values))})"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")
