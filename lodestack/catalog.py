"""The public API: one catalogue folder with its file index, document cache, and metadata tables.

Every table is versioned: a change writes a new version and then renames its number into place, so readers always see a whole
table, a lost writer leaves the old version in place, and the later of two writers of one version fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.functions.extract import extract
from lodestack.functions.paths import content_candidates, is_skipped_by_indexer
from lodestack.functions.scalars import file_name, search_tokens, snippet
from lodestack.operators import content, fulltext, keyed
from lodestack.operators.hierarchy import resolve_hierarchy
from lodestack.operators.search import DEFAULT_LIMIT, Matches, list_directory, search
from lodestack.plans.query_parser import ParsedQuery, parse
from lodestack.session import Scratch, Versions
from lodestack.sources.files import index_files

TABLES = {
    "file_index": schemas.FILE_INDEX, "doc_cache": schemas.DOC_CACHE, "search_history": schemas.SEARCH_HISTORY,
    "settings": schemas.SETTINGS, "favorites": schemas.FAVORITES, "exclusion_rules": schemas.EXCLUSION_RULES,
    "knowledge_folders": "folder STRING, added_at BIGINT", "knowledge": "path STRING, content STRING",
}
HISTORY_LIMIT, CONTENT_LIMIT, KNOWLEDGE_LIMIT, BATCH = 20, 200, 50, 50


INDEX_FIELDS = ("folded", "content", "name")


def tokenised(docs: DataFrame) -> DataFrame:
    """(key, tokens of each field) of documents (path, content), as the text indexes take them."""
    text = F.coalesce("content", F.lit(""))
    return docs.select(
        F.col("path").alias("key"), fulltext.folded_tokens(text).alias("folded"), search_tokens(text).alias("content"),
        search_tokens(file_name(F.translate("path", "/", "\\"))).alias("name"),
    )


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # tables

    def _versions(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.root}/{name}/versions")

    def version(self, name: str) -> int:
        return self._versions(name).newest()[0]

    def read(self, name: str) -> DataFrame:
        _, path = self._versions(name).newest()
        if path is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/{path}")

    def write(self, name: str, rows: DataFrame) -> int:
        version = self.version(name) + 1
        columns = [c.strip().split(" ")[0] for c in TABLES[name].split(",")]
        path = f"v{version}-{uuid.uuid4().hex[:8]}"
        rows.select(*columns).write.parquet(f"{self.root}/{name}/{path}")
        self._versions(name).publish(version, path)
        return version

    def _text_index(self, name: str) -> fulltext.InvertedIndex:
        return fulltext.InvertedIndex(self.spark, f"{self.root}/{name}", INDEX_FIELDS)

    def _rows(self, name: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), TABLES[name])

    # file index

    def ingest(self, entries: DataFrame) -> int:
        """Resolve paths of enumerated entries (volume, frn, parent_frn, name, ...) and make them the file index.
        Entries cut off from their volume's root hang right below it; entries in circles are left out."""
        numbered = entries if "seq" in entries.columns else entries.withColumn("seq", F.monotonically_increasing_id())
        links = numbered.select("volume", F.col("frn").alias("id"), F.col("parent_frn").alias("parent"), "seq", "name")
        paths = resolve_hierarchy(links, ["volume"], "seq", name="name").where("status <> 'loop'").select(
            "volume", F.col("id").alias("frn"), F.concat("volume", F.lit(":\\"), "full_path").alias("full_path")
        )
        values = [c for c in ("name", "parent_frn", "size", "mtime", "is_directory", "file_attributes")]
        latest = numbered.groupBy("volume", "frn").agg(F.max(F.struct("seq", *values)).alias("r")).select("volume", "frn", "r.*")
        return self.write("file_index", index_files(latest.join(paths, ["volume", "frn"])))

    def parse(self, query: str, now: int = 0, category: str | None = None) -> ParsedQuery:
        return parse(query, now, category)

    def search(self, query: str, now: int = 0, category: str | None = None) -> Matches:
        """Metadata search, with the exclusion rules applied."""
        return search(self.read("file_index"), parse(query, now, category), self.read("exclusion_rules"))

    def search_page(self, query: str, now: int, offset: int = 0, limit: int = DEFAULT_LIMIT) -> tuple[DataFrame, DataFrame]:
        """(page, summary); a query that isn't blank is recorded in the history with its number of matches."""
        found = self.search(query, now)
        summary = found.summary()
        if query.strip():
            self.save_search(query, summary.first()["total_matches"], now)
        return found.page(offset, limit), summary

    def list_directory(self, volume: str, parent_frn: int) -> DataFrame:
        files = self.read("file_index")
        return list_directory(files.where((F.col("volume") == volume) & (F.col("parent_frn") == parent_frn)))

    # content

    def index_documents(self, files: DataFrame) -> int:
        """Extract the documents among files (path, mtime, size, ext, content BINARY) that the cache doesn't have as they are
        now, and upsert them."""
        wanted = files.where(~is_skipped_by_indexer(F.lower("path")))
        cached = self.read("doc_cache")
        same = (wanted["path"] == cached["path"]) & (wanted["mtime"] == cached["mtime"])
        scratch = Scratch(self.spark, "documents")
        fresh = scratch.cut(extract(wanted.join(cached.select("path", "mtime"), same, "left_anti")), "fresh")
        self._text_index("doc_cache_index").upsert(tokenised(fresh))
        version = self.write("doc_cache", keyed.upsert(cached, fresh, ["path"], "mtime"))
        scratch.delete()
        return version

    def remove_documents(self, paths: DataFrame) -> int:
        self._text_index("doc_cache_index").delete(paths.select(F.col("path").alias("key")))
        return self.write("doc_cache", keyed.delete_keys(self.read("doc_cache"), paths, ["path"]))

    def index_stats(self) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        candidates = self.read("file_index").where(content_candidates()).agg(zero.alias("total_indexed"), F.count("*").alias("total_candidates"))
        indexed = self.read("doc_cache").agg(F.count("*").alias("total_indexed"), zero.alias("total_candidates"))
        return indexed.unionByName(candidates).agg(F.sum("total_indexed").alias("total_indexed"), F.sum("total_candidates").alias("total_candidates"))

    def search_content(self, query: str, now: int = 0, limit: int | None = CONTENT_LIMIT) -> DataFrame:
        """Content terms of a query, as one phrase, in the files its other clauses match."""
        parsed = parse(query, now)
        if not parsed.has_content_search:
            return content.search_content(self.read("file_index"), self.read("doc_cache"), "", limit).limit(0)
        files = search(self.read("file_index"), parsed, self.read("exclusion_rules")).matched
        docs = self.read("doc_cache").join(files.select(F.col("full_path").alias("path")), "path", "left_semi")
        return content.search_content(files, docs, parsed.content_phrase, limit)

    def search_phrase(self, phrase: str) -> DataFrame:
        """Cached documents (path) with a phrase of whole tokens, from the index."""
        return self._text_index("doc_cache_index").phrase("folded", fulltext.fold_query(self.spark, phrase)).select(F.col("key").alias("path"))

    def preview(self, path: str, keyword: str, context: int = 3) -> DataFrame:
        return content.preview(self.read("doc_cache").where(F.col("path") == path), keyword, context).orderBy("line_number")

    @staticmethod
    def batches(rows: DataFrame, size: int = BATCH) -> Iterator[list[Row]]:
        """Rows in lists of `size`, partition by partition; the driver holds one partition at a time."""
        part = []
        for row in rows.toLocalIterator():
            part.append(row)
            if len(part) == size:
                yield part
                part = []
        if part:
            yield part

    # ranked index

    def index_knowledge(self, docs: DataFrame) -> int:
        """Add documents (path, content); a path that is added again is replaced."""
        changes = docs.select("path", "content", F.lit(0).alias("_order"))
        self._text_index("knowledge_index").upsert(tokenised(docs))
        return self.write("knowledge", keyed.upsert(self.read("knowledge"), changes, ["path"], "_order"))

    def clear_knowledge(self) -> int:
        self._text_index("knowledge_index").delete(self.read("knowledge").select(F.col("path").alias("key")))
        return self.write("knowledge", self.read("knowledge").limit(0))

    def search_knowledge(self, query: str, limit: int = KNOWLEDGE_LIMIT) -> DataFrame:
        docs = self.read("knowledge")
        best = self._text_index("knowledge_index").bm25(query, ("content", "name"), limit).withColumnRenamed("key", "path")
        words = query.split()
        return best.join(docs, "path").select(
            F.col("path").alias("file_path"), file_name(F.translate("path", "/", "\\")).alias("file_name"),
            snippet(F.col("content"), words[0] if words else "").alias("snippet"), F.round("score", 4).alias("score"),
        ).orderBy(F.desc("score"), "file_path")

    def add_folder(self, folder: str, now: int) -> int:
        return self._put("knowledge_folders", (folder, now), "folder", "added_at")

    def remove_folder(self, folder: str) -> int:
        """Remove a folder and the documents below it."""
        below = F.col("path").startswith(folder.rstrip("/\\"))
        self._text_index("knowledge_index").delete(self.read("knowledge").where(below).select(F.col("path").alias("key")))
        self.write("knowledge", self.read("knowledge").where(~below))
        return self.write("knowledge_folders", self.read("knowledge_folders").where(F.col("folder") != folder))

    def folders(self) -> DataFrame:
        return self.read("knowledge_folders").orderBy("added_at", "folder")

    # metadata tables

    def _put(self, name: str, row: tuple, key: str, order: str) -> int:
        return self.write(name, keyed.upsert(self.read(name), self._rows(name, row), [key], order))

    def _next_id(self, name: str) -> int:
        return (self.read(name).agg(F.max("id")).first()[0] or 0) + 1

    def save_search(self, query: str, count: int, now: int) -> int:
        return self.write("search_history", self.read("search_history").unionByName(self._rows("search_history", (self._next_id("search_history"), query, count, now))))

    def recent_searches(self, limit: int = HISTORY_LIMIT) -> DataFrame:
        return keyed.newest(self.read("search_history"), ["searched_at", "id"], limit)

    def clear_history(self) -> int:
        return self.write("search_history", self.read("search_history").limit(0))

    def set_setting(self, key: str, value: str) -> int:
        return self._put("settings", (key, value), "key", "value")

    def get_setting(self, key: str) -> str | None:
        row = self.read("settings").where(F.col("key") == key).first()
        return row["value"] if row else None

    def add_favorite(self, path: str, now: int) -> int:
        name = path.replace("/", "\\").rsplit("\\", 1)[-1]
        return self._put("favorites", (self._next_id("favorites"), path, name, now), "file_path", "added_at")

    def remove_favorite(self, path: str) -> int:
        return self.write("favorites", self.read("favorites").where(F.col("file_path") != path))

    def favorites(self) -> DataFrame:
        return self.read("favorites").orderBy(F.desc("added_at"), F.desc("id"))

    def add_exclusion(self, pattern: str, is_regex: bool, now: int) -> int:
        rows = self._rows("exclusion_rules", (self._next_id("exclusion_rules"), pattern, is_regex, now))
        return self.write("exclusion_rules", self.read("exclusion_rules").unionByName(rows))

    def remove_exclusion(self, rule: int) -> int:
        return self.write("exclusion_rules", self.read("exclusion_rules").where(F.col("id") != rule))

    def exclusions(self) -> DataFrame:
        return self.read("exclusion_rules").orderBy(F.desc("created_at"), F.desc("id"))
