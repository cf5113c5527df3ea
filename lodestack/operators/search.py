"""Metadata search over the file index: matches, their summary, pages, exclusions, listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import scalars
from lodestack.plans.compiler import compile_query
from lodestack.plans.query_parser import ParsedQuery
from lodestack.session import Scratch

ITEM_COLUMNS = ("name", "full_path", "size", "mtime", "is_directory", "ext")
#: Exclusion rules up to this many become one OR of literals; more are joined.
INLINE_RULES = 200
DEFAULT_LIMIT, LARGEST_LIMIT = 100, 500


def exclude(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files whose path starts with no rule's pattern (or, for rules with is_regex, doesn't match it), in any case.

    Rules are a user's list. Up to INLINE_RULES they are read to the driver and become literals in the scan's filter; a
    longer list of prefixes is joined by their first character, so it needs no nested loop. More than INLINE_RULES regular
    expressions are refused. Null and empty patterns exclude nothing."""
    usable = rules.where(F.length("pattern") > 0).select("pattern", F.coalesce("is_regex", F.lit(False)).alias("is_regex"))
    first = usable.orderBy(F.desc("is_regex")).limit(INLINE_RULES + 1).collect()
    inline = first if len(first) <= INLINE_RULES else [r for r in first if r["is_regex"]]
    if len(inline) > INLINE_RULES:
        raise ValueError(f"more than {INLINE_RULES} exclusion rules are regular expressions")
    for pattern, is_regex in inline:
        hit = F.col("full_path_lower").rlike("(?iU)" + pattern) if is_regex else F.col("full_path_lower").startswith(pattern.lower())
        files = files.where(~F.coalesce(hit, F.lit(False)))
    if len(first) > INLINE_RULES:
        prefixes = usable.where("NOT is_regex").select(F.lower("pattern").alias("_p"))
        on = (F.substring("_p", 1, 1) == F.substring("full_path_lower", 1, 1)) & F.col("full_path_lower").startswith(F.col("_p"))
        files = files.join(prefixes, on, "left_anti")
    return files


@dataclass
class Matches:
    """The matches of one query, lazily: ask for a page, for the summary, or for both."""

    files: DataFrame
    matched: DataFrame

    def page(self, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Matches in order of seq, `limit` from `offset`: a top-k, not a sort of everything."""
        rows = self.matched.orderBy("seq").offset(offset).limit(min(limit, LARGEST_LIMIT))
        return rows.select("seq", *ITEM_COLUMNS)

    def summary(self) -> DataFrame:
        """One row: matches, files in the index, bytes of all matching files (not only of a page)."""
        zero = F.lit(0).cast("bigint")
        found = self.matched.agg(
            F.count("*").alias("total_matches"), zero.alias("total_files"),
            F.coalesce(F.sum(F.when(~F.col("is_directory"), F.col("size"))), zero).alias("total_bytes"),
        )
        everything = self.files.agg(zero.alias("total_matches"), F.count("*").alias("total_files"), zero.alias("total_bytes"))
        return found.unionByName(everything).agg(*[F.sum(c).alias(c) for c in found.columns])


def search(files: DataFrame, query: ParsedQuery, rules: DataFrame | None = None, bytewise: bool = False) -> Matches:
    """The matches of a parsed query. Null sizes and dates match no size or date clause; no clause at all matches every file."""
    matched = files.where(compile_query(query, bytewise))
    return Matches(files, exclude(matched, rules) if rules is not None else matched)


def complete_metadata(page: DataFrame, live: DataFrame) -> DataFrame:
    """Sizes and times of a page that are 0, taken from the live listing (full_path, size, mtime) where it has them."""
    fresh = live.select(F.col("full_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    stale = ~F.col("is_directory") & ((F.col("size") == 0) | (F.col("mtime") == 0))
    names = page.columns
    return page.join(fresh, "full_path", "left").select(*[
        F.when(stale, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in ("size", "mtime") else F.col(c) for c in names
    ])


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """rows with their place in the order, from 1, however many there are: sorted into ranges, numbered within each
    range, and moved by the sizes of the ranges before (one number per range on the driver)."""
    scratch = Scratch(rows.sparkSession, "numbered")
    ranges = scratch.cut(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, total = {}, 0
    for part, size in sorted(ranges.groupBy("_range").count().collect()):
        before[part], total = total, total + size
    offset = F.try_element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_range")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + offset
    return ranges.select(place.cast("bigint").alias(name), *rows.columns)


def list_directory(children: DataFrame) -> DataFrame:
    """A listing, directories first, then by lower-case name: with labels, formatted size and time, and its number."""
    order = [F.col("is_directory").desc(), F.col("name_lower"), F.col("seq")]
    return numbered(children, order).select(
        "number", "name", F.col("is_directory").alias("is_dir"),
        scalars.type_label(F.col("ext"), F.col("is_directory")).alias("type_str"),
        scalars.icon(F.col("ext"), F.col("is_directory")).alias("icon"),
        scalars.format_size(F.col("size"), F.col("is_directory")).alias("size_formatted"),
        scalars.format_time(F.col("mtime")).alias("mtime_formatted"),
    )


def contains_filter(files: DataFrame, text: str) -> DataFrame:
    """Files whose name or path contains the text in any case; all for empty text."""
    word = text.lower()
    return files.where(F.col("name_lower").contains(word) | F.col("full_path_lower").contains(word))


def rebase(files: DataFrame, old: str, new: str) -> DataFrame:
    """Files with the folder `old` (and all below it) moved to `new`: full_path and full_path_lower rewritten."""
    inside = (F.col("full_path") == old) | F.col("full_path").startswith(old + "\\")
    moved = F.when(inside, F.concat(F.lit(new), F.substring("full_path", F.lit(len(old) + 1), F.length("full_path")))).otherwise(F.col("full_path"))
    return files.withColumn("full_path", moved).withColumn("full_path_lower", F.lower("full_path"))


def listing_totals(children: DataFrame) -> DataFrame:
    return children.agg(
        F.count(F.when(F.col("is_directory"), 1)).alias("dirs"), F.count(F.when(~F.col("is_directory"), 1)).alias("files"),
        F.coalesce(F.sum(F.when(~F.col("is_directory"), F.col("size"))), F.lit(0)).alias("bytes"),
    )


def page_totals(page: DataFrame) -> DataFrame:
    """(items, bytes) of a page: how many rows it has and what its files take, folders not counted."""
    return page.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.when(~F.col("is_directory"), F.col("size"))), F.lit(0)).alias("bytes"))


def distinct_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order): each value once, at its first place, in order of those; null is a value."""
    return rows.groupBy(key).agg(F.min(order).alias(order)).orderBy(order, key)
