"""Small keyed tables (history, settings, favorites, exclusion rules) and the document cache, without MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """current with each key of changes replaced by its row with the highest `order` (ties: the greatest row)."""
    names = current.columns
    newest = changes.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(c) for c in names if c not in keys])).alias("_r"))
    fresh = newest.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in names])
    return current.join(fresh.select(*keys), keys, "left_anti").select(*names).unionByName(fresh)


def delete_keys(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return current.join(keys.select(*on), on, "left_anti").select(*current.columns)


def newest(table: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows by `order` descending; a top-k."""
    return table.orderBy(*[F.desc(c) for c in order]).limit(limit)


def stale(candidates: DataFrame, cached: DataFrame) -> DataFrame:
    """Candidates (full_path, mtime) that the cache (path, mtime) doesn't have as they are now."""
    same = (candidates["full_path"] == cached["path"]) & (candidates["mtime"] == cached["mtime"])
    return candidates.join(cached, same, "left_anti")


def existing(results: DataFrame, live: DataFrame) -> DataFrame:
    """Results (full_path) that the live listing still has."""
    return results.join(live.select("full_path"), "full_path", "left_semi").select(*results.columns)
