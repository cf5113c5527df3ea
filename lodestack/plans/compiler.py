"""ParsedQuery to one predicate over the file index, its cheapest conjuncts first.

The derived columns (name_lower, full_path_lower, ext) are stored, so that equality, range and substring
conditions reach the Parquet scan.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.globs import glob_match, path_glob
from lodestack.functions.times import unix_seconds
from lodestack.plans.query_parser import Bounds, ParsedQuery


def within(value: Column, bounds: Bounds) -> Column:
    parts = ([value >= F.lit(bounds.low)] if bounds.low is not None else []) + (
        [value <= F.lit(bounds.high)] if bounds.high is not None else []
    )
    return reduce(and_, parts)


def term(text: str, bytewise: bool = False) -> Column:
    """A text term: substring of the name; with a separator also of the path; with wildcards a glob of either; or a
    substring of the pinyin columns (null: no Chinese text, so no match)."""
    wild = "*" in text or "?" in text
    options = [F.col("name_lower").contains(text)]
    if "\\" in text or "/" in text:
        options.append(
            glob_match(F.col("full_path_lower"), path_glob(text), bytewise) if wild
            else F.col("full_path_lower").contains(text.replace("/", "\\"))
        )
    if wild:
        options.append(glob_match(F.col("name_lower"), text, bytewise))
    options += [F.coalesce(F.col(c).contains(text), F.lit(False)) for c in ("pinyin_first", "pinyin_full")]
    return reduce(or_, options)


def compile_query(query: ParsedQuery, bytewise: bool = False) -> Column:
    parts: list[Column] = []
    if query.folders_only is not None:
        parts.append(F.col("is_directory") if query.folders_only else ~F.col("is_directory"))
    if query.ext_filters:
        parts.append(~F.col("is_directory") & F.col("ext").isin(*query.ext_filters))
    parts += [within(F.col("size"), b) for b in query.size_filters]
    parts += [within(unix_seconds(F.col("mtime")), b) for b in query.date_filters]
    parts += [F.col("full_path_lower").contains(p) for p in query.path_includes]
    parts += [~F.col("full_path_lower").contains(p) for p in query.path_excludes]
    for pattern in query.regex_patterns:
        parts.append(F.col("name").rlike("(?U)" + pattern) | F.col("full_path").rlike("(?U)" + pattern))
    parts += [term(t, bytewise) for t in query.text_terms]
    return reduce(and_, parts) if parts else F.lit(True)
