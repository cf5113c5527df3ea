"""Content search: the first matching line per document, merged hits, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import scalars
from lodestack.functions.paths import content_candidates

MATCH_COLUMNS = ("file_path", "file_name", "line_number", "line_text", "match_start", "match_end")


def first_line(text: Column, keyword: str) -> Column:
    """struct<at, line> of the first line that contains the keyword in any case, at counted from 1; else null."""
    numbered = F.transform(scalars.lines(text), lambda line, i: F.struct((i + 1).cast("bigint").alias("at"), line.alias("line")))
    return F.get(F.filter(numbered, lambda s: F.lower(s["line"]).contains(keyword.lower())), F.lit(0))


def match_columns(line: Column, keyword: str) -> list[Column]:
    """Trimmed text and the bounds of the match in bytes of the untrimmed lower-case line."""
    lower, word = F.lower(line), keyword.lower()
    start = F.octet_length(F.substring(lower, F.lit(1), F.instr(lower, word) - 1)).cast("bigint")
    return [F.trim(line).alias("line_text"), start.alias("match_start"), (start + len(word.encode())).alias("match_end")]


def first_matches(docs: DataFrame, keyword: str) -> DataFrame:
    """The first match of each document (path, content): no explode, no shuffle. Null and empty contents have none."""
    # the whole content is looked at first, so lines are split only where there is a match
    hits = docs.where(F.lower("content").contains(keyword.lower())).select("path", first_line(F.col("content"), keyword).alias("hit"))
    return hits.where(F.col("hit").isNotNull()).select(
        F.col("path").alias("file_path"), scalars.file_name(F.col("path")).alias("file_name"), F.col("hit.at").alias("line_number"),
        *match_columns(F.col("hit.line"), keyword),
    )


def name_matches(files: DataFrame, keyword: str) -> DataFrame:
    """Files whose decoded name contains the keyword, as matches on line 0: nothing is read for them."""
    name = scalars.percent_decode(F.col("name"))
    hits = files.where(F.lower(name).contains(keyword.lower()))
    return hits.select(
        F.col("full_path").alias("file_path"), name.alias("file_name"), F.lit(0).cast("bigint").alias("line_number"),
        *match_columns(name, keyword),
    )


def search_content(files: DataFrame, docs: DataFrame, keyword: str, limit: int | None = 200) -> DataFrame:
    """Name matches of the candidates and first matches in cached documents, a path's name match before its content,
    by path and line; limit is the feature's size of the answer."""
    names = name_matches(files.where(content_candidates()), keyword)
    contents = first_matches(docs, keyword)
    rest = contents.join(names.select(F.lower("file_path").alias("_p")), F.lower(contents["file_path"]) == F.col("_p"), "left_anti")
    merged = names.unionByName(rest).orderBy("file_path", "line_number", "file_name")
    return merged.limit(limit) if limit is not None else merged


def like_matches(docs: DataFrame, keyword: str, emitted: DataFrame) -> DataFrame:
    """First matches of documents that `emitted` (file_path) doesn't have."""
    return first_matches(docs, keyword).join(emitted.select("file_path"), "file_path", "left_anti")


def preview(docs: DataFrame, keyword: str, context: int = 3) -> DataFrame:
    """(path, line_number, text, is_match): the lines from `context` before a document's first match to `context` behind
    its last. Documents without a match have none."""
    word = keyword.lower()
    numbered = F.transform(
        scalars.lines(F.col("content")),
        lambda line, i: F.struct((i + 1).cast("bigint").alias("line_number"), line.alias("text"), F.lower(line).contains(word).alias("is_match")),
    )
    rows = docs.where(F.lower("content").contains(word)).select("path", numbered.alias("lines"))
    hits = F.filter("lines", lambda s: s["is_match"])
    rows = rows.select("path", "lines", F.get(hits, F.lit(0))["line_number"].alias("first"), F.get(hits, F.size(hits) - 1)["line_number"].alias("last"))
    inside = F.filter("lines", lambda s: (s["line_number"] >= F.col("first") - context) & (s["line_number"] <= F.col("last") + context))
    return rows.select("path", F.inline(inside))
