"""Globs as regular expressions: `*` any run, `?` one character (or one byte), matched against the whole value."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    parts = ("[\\s\\S]*" if c == "*" else "[\\s\\S]" if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", pattern))
    return "^" + "".join(parts) + "$"


def glob_match(value: Column, pattern: str, bytewise: bool = False) -> Column:
    """bytewise: `?` is one byte of UTF-8, so both sides are compared as one character per byte."""
    if bytewise:
        value = F.decode(F.encode(value, "UTF-8"), "ISO-8859-1")
        pattern = pattern.encode().decode("latin-1")
    return value.rlike(r"(?s)\A" + glob_regex(pattern)[1:-1] + r"\z")


def path_glob(term: str) -> str:
    """A wildcard term for paths: anywhere in the path, but one that starts with `*` is anchored at the end."""
    term = term.replace("/", "\\")
    return term if term.startswith("*") else f"*{term}*"
