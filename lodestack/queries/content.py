"""q16-q33: content and full-text search, scalar functions, path predicates and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import paths, scalars
from lodestack.operators import content, fulltext, keyed
from lodestack.operators.search import complete_metadata, search
from lodestack.plans.query_parser import parse
from lodestack.queries.search import SECONDS
from lodestack.session import Scratch
from lodestack.sources.tables import table

WORD = "snapshot"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_index")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_cache")


def q16_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.first_matches(_docs(spark, sf_dir), WORD)


def q17_content_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.search_content(_files(spark, sf_dir), _docs(spark, sf_dir), WORD, limit=None)


def q17_content_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer as the search shows it: the first 200 by path and line."""
    return content.search_content(_files(spark, sf_dir), _docs(spark, sf_dir), "report")


def q18_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.preview(_docs(spark, sf_dir), WORD)


def q19_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = scalars.highlight(F.col("name"), "plan")
    return _files(spark, sf_dir).where(F.col("name_lower").contains("plan")).select("seq", F.posexplode(parts).alias("part", "_p")).select(
        "seq", F.col("part").cast("bigint").alias("part"), "_p.text", "_p.is_match"
    )


def q20_like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    emitted = fulltext.phrase_matches(docs, "path tree").select(F.col("path").alias("file_path"))
    return content.like_matches(docs, "path", emitted)


#: Indexes made in this application, by data directory.
_INDEXES: dict[tuple[str, str], fulltext.InvertedIndex] = {}
INDEX_FIELDS = {"folded": "folded", "content": "content", "name": "name"}


def _indexed(docs: DataFrame) -> DataFrame:
    """(key, tokens of each field) of documents (path, content)."""
    content_col = F.coalesce("content", F.lit(""))
    return docs.select(
        F.col("path").alias("key"), fulltext.folded_tokens(content_col).alias("folded"), scalars.search_tokens(content_col).alias("content"),
        scalars.search_tokens(scalars.file_name(F.col("path"))).alias("name"),
    )


def _index(spark: SparkSession, sf_dir: str) -> fulltext.InvertedIndex:
    """The index of doc_cache; built on first use, then only read."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:
        made = fulltext.InvertedIndex(spark, Scratch(spark, "index").root, tuple(INDEX_FIELDS))
        made.upsert(_indexed(_docs(spark, sf_dir)))
        _INDEXES[at] = made
    return _INDEXES[at]


def q21_fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two phrases, looked up in the index."""
    index = _index(spark, sf_dir)
    found = [index.phrase("folded", fulltext.fold_query(spark, phrase)) for phrase in ("Résultats à mélange", "path tree")]
    return found[0].unionByName(found[1]).select(F.col("key").alias("path"))


def q22_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for three words in content and name, from the index."""
    best = _index(spark, sf_dir).bm25("snapshot loader report", ("content", "name"))
    return best.select(F.col("key").alias("path"), F.round("score", 4).alias("score"))


def q22_bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an index: one scan for the counts, one for the scores."""
    fields = {"content": F.col("content"), "name": scalars.file_name(F.col("path"))}
    return fulltext.bm25(_docs(spark, sf_dir), "snapshot loader report", fields, "path").select("path", F.round("score", 4).alias("score"))


def q22_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase after texts of one type were replaced and those of another removed, in an index that is only added to."""
    docs = table(spark, sf_dir, "doc_cache")
    index = fulltext.InvertedIndex(spark, Scratch(spark, "index").root, tuple(INDEX_FIELDS))
    index.upsert(_indexed(docs))
    index.upsert(_indexed(docs.where("doc_type = 'docx'").withColumn("content", F.concat(F.lit("a path tree, "), F.coalesce("content", F.lit(""))))))
    index.delete(docs.where("doc_type = 'pdf'").select(F.col("path").alias("key")))
    return index.phrase("folded", ["path", "tree"]).select(F.col("key").alias("path"))


def q22_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fulltext.postings(_docs(spark, sf_dir))
    return index.groupBy("token").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("occurrences"))


def q23_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = content.first_matches(_docs(spark, sf_dir), WORD)
    at = F.instr(F.lower("line_text"), WORD) - 1
    return hits.select("file_path", scalars.truncate_snippet(F.col("line_text"), at, len(WORD)).alias("snippet"))


def q23_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("path", scalars.snippet(F.col("content"), WORD).alias("snippet"))


def q24_format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("seq", scalars.format_size(F.col("size"), F.col("is_directory")).alias("size_formatted"))


def q25_format_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("seq", scalars.format_time(F.col("mtime")).alias("mtime_formatted"))


def q26_percent_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20"))
    return _files(spark, sf_dir).select("seq", scalars.percent_decode(encoded).alias("decoded"))


def q27_xml_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat(F.lit("<w:t xml:space='preserve'>a &amp;lt; "), F.col("name"), F.lit(" &quot;x&quot;</w:t><w:t>&apos;</w:t>"))
    return _files(spark, sf_dir).select("seq", scalars.node_text(node, "w:t").alias("text"))


def q28_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit('<p class="x">'), F.col("content"), F.lit("</p> > <br"))
    return _docs(spark, sf_dir).select("path", scalars.strip_tags(page).alias("text"))


def q28_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("path", F.size(scalars.lines(F.col("content"))).cast("bigint").alias("lines"))


def q29_noisy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.col("full_path_lower")
    return _files(spark, sf_dir).select("seq", paths.is_noisy(lower).alias("noisy"), paths.is_skipped_by_indexer(lower).alias("skipped"))


def q30_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(paths.content_candidates()).select("seq", "full_path", "ext", "size")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of the first, the last but one and the last snapshot; the times are one row each."""
    items = table(spark, sf_dir, "snapshot_file_item")
    times = [r[0] for r in items.select("snapshot_ts").where("snapshot_ts is not null").distinct().orderBy("snapshot_ts").collect()] or [None]
    return tuple(items.where(F.col("snapshot_ts") == F.lit(t)) for t in (times[0], times[max(0, len(times) - 2)], times[-1]))


def q31_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the last snapshot that the one before doesn't have with the same time."""
    _, before, last = _snapshots(spark, sf_dir)
    return keyed.stale(last.select("full_path", "mtime"), before.select(F.col("full_path").alias("path"), "mtime"))


def q32_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in the first snapshot that the last still has."""
    first, _, last = _snapshots(spark, sf_dir)
    old = search(first, parse("ext:pdf|docx")).matched.select("seq", "full_path")
    return keyed.existing(old, last).select("seq", "full_path")


def q33_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the first snapshot, with zero sizes and times from the last (one row per path there)."""
    first, _, last = _snapshots(spark, sf_dir)
    live = last.groupBy("full_path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    return complete_metadata(search(first, parse("type:doc")).page(limit=500), live)


def q31_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select(
        "seq", scalars.extension(F.col("name"), F.col("is_directory")).alias("ext"), scalars.short_name(F.col("name")).alias("short"),
        scalars.file_name(F.col("full_path")).alias("file_name"),
    )


QUERIES = {f.__name__: f for f in (
    q16_first_match, q17_content_merged, q17_content_top, q18_preview, q19_highlight, q20_like_fallback, q21_fts_phrase, q22_bm25, q22_bm25_scan, q22_index_changes, q22_postings,
    q23_snippet, q23_extract, q24_format_size, q25_format_time, q26_percent_decode, q27_xml_unescape, q28_strip_tags, q28_lines, q29_noisy_paths,
    q30_candidates, q31_freshness, q31_folding, q32_ghosts, q33_complete,
)}

_LINES = r"""
    doc_lines AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (
        SELECT path, string_split(replace(regexp_replace(content, '\r?\n$', ''), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM doc_cache WHERE content <> ''))"""
_NAME = "list_last(string_split({}, chr(92)))"


def _first(word: str, extra: str = "") -> str:
    return f"""
        SELECT path AS file_path, {_NAME.format('path')} AS file_name, CAST(n AS BIGINT) AS line_number, trim(line, ' ') AS line_text,
               CAST(strlen(substr(lower(line), 1, strpos(lower(line), '{word}') - 1)) AS BIGINT) AS match_start,
               CAST(strlen(substr(lower(line), 1, strpos(lower(line), '{word}') - 1)) + {len(word)} AS BIGINT) AS match_end
        FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n) AS r FROM doc_lines WHERE contains(lower(line), '{word}'){extra}) WHERE r = 1"""


def _like(parts: tuple[str, ...], how: str) -> str:
    return " OR ".join(f"{how}(full_path_lower, '{p}')" for p in parts)


_NOISY = (
    r"regexp_matches(full_path_lower, '(consolehost_history\.txt|\.bash_history|\.zsh_history|\.node_repl_history|\.python_history|doc_cache\.db|index_cache\.bin)$')"
    r" OR regexp_matches(full_path_lower, '\\(psreadline|\.gemini|antigravity-cli|\.system_generated|appdata\\local\\temp|\.vscode|\.idea)\\')"
)
_NOISY = f"({_NOISY})"
_CANDIDATE = f"NOT is_directory AND lower(ext) IN ({', '.join(repr(e) for e in paths.BINARY_DOCUMENTS + paths.TEXT_DOCUMENTS)}) AND size <= 52428800 AND NOT {_NOISY}"


def _merged(word: str) -> str:
    at = f"strlen(substr(lower(name), 1, strpos(lower(name), '{word}') - 1))"
    return f"""
        WITH {_LINES}, names AS (
            SELECT full_path AS file_path, name AS file_name, CAST(0 AS BIGINT) AS line_number, trim(name, ' ') AS line_text,
                   CAST({at} AS BIGINT) AS match_start, CAST({at} + {len(word)} AS BIGINT) AS match_end
            FROM file_index WHERE {_CANDIDATE} AND contains(lower(name), '{word}'))
        SELECT * FROM names UNION ALL
        SELECT * FROM ({_first(word)}) WHERE lower(file_path) NOT IN (SELECT lower(file_path) FROM names)"""


_TOKENS = r"regexp_replace(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
_BM25_TERMS = ("loader", "report", "snapshot")


def _bm25() -> str:
    fields = {"content": "coalesce(content, '')", "name": _NAME.format("path")}
    counted = ", ".join(
        f"len({f}_t) AS length_{f}, " + ", ".join(f"len(list_filter({f}_t, lambda t: t = '{w}')) AS tf_{f}_{w}" for w in _BM25_TERMS) for f in fields
    )
    tokens = ", ".join(
        rf"list_filter(regexp_split_to_array(lower({e}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND strlen(t) < 40) AS {f}_t" for f, e in fields.items()
    )
    score = " + ".join(
        f"CASE WHEN tf_{f}_{w} > 0 THEN ln(1 + (n - df_{f}_{w} + 0.5) / (df_{f}_{w} + 0.5)) * tf_{f}_{w} * 2.2 / (tf_{f}_{w} + 1.2 * (0.25 + 0.75 * length_{f} / mean_{f})) ELSE 0 END"
        for f in fields for w in _BM25_TERMS
    )
    stats = ", ".join(f"avg(length_{f}) AS mean_{f}, " + ", ".join(f"count(*) FILTER (tf_{f}_{w} > 0) AS df_{f}_{w}" for w in _BM25_TERMS) for f in fields)
    return f"""
        WITH counted AS (SELECT path, {counted} FROM (SELECT path, {tokens} FROM doc_cache)),
        stats AS (SELECT count(*) AS n, {stats} FROM counted)
        SELECT path, round(score, 4) AS score FROM (SELECT path, {score} AS score FROM counted, stats) WHERE score > 0 ORDER BY round(score, 6) DESC, path LIMIT 50"""


_SIZE = """CASE WHEN is_directory THEN '<DIR>' WHEN size < 1024 THEN size || ' B' WHEN size < 1024 ** 2 THEN printf('%.1f KB', size / 1024.0)
    WHEN size < 1024 ** 3 THEN printf('%.1f MB', size / 1048576.0) WHEN size < 1024 ** 4 THEN printf('%.1f GB', size / 1073741824.0)
    ELSE printf('%.1f TB', size / 1099511627776.0) END"""

ORACLES = {
    "q16_first_match": f"WITH {_LINES} {_first(WORD)}",
    "q17_content_merged": _merged(WORD),
    "q17_content_top": f"SELECT * FROM ({_merged('report')}) ORDER BY file_path, line_number, file_name LIMIT 200",
    "q18_preview": f"""
        WITH {_LINES}, hits AS (SELECT path, min(n) AS a, max(n) AS b FROM doc_lines WHERE contains(lower(line), '{WORD}') GROUP BY path)
        SELECT path, CAST(n AS BIGINT) AS line_number, line AS text, contains(lower(line), '{WORD}') AS is_match
        FROM doc_lines JOIN hits USING (path) WHERE n BETWEEN a - 3 AND b + 3""",
    "q19_highlight": """
        WITH parts AS (SELECT seq, string_split(regexp_replace(name, '(?i)(plan)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM file_index WHERE contains(name_lower, 'plan')),
        flat AS (SELECT seq, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM parts)
        SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY i) - 1 AS part, text, i % 2 = 0 AS is_match FROM flat WHERE text <> ''""",
    "q20_like_fallback": f"""
        WITH {_LINES} SELECT * FROM ({_first('path')})
        WHERE file_path NOT IN (SELECT path FROM doc_cache WHERE contains(' ' || {_TOKENS.format('content')} || ' ', ' path tree '))""",
    "q21_fts_phrase": f"""
        SELECT path FROM doc_cache WHERE contains(' ' || {_TOKENS.format('content')} || ' ', ' resultats a melange ')
        UNION ALL SELECT path FROM doc_cache WHERE contains(' ' || {_TOKENS.format('content')} || ' ', ' path tree ')""",
    "q22_bm25": _bm25(),
    "q22_bm25_scan": _bm25(),
    "q22_index_changes": f"""
        SELECT path FROM doc_cache WHERE doc_type IS DISTINCT FROM 'pdf' AND (doc_type = 'docx' OR contains(' ' || {_TOKENS.format('content')} || ' ', ' path tree '))""",
    "q22_postings": r"""
        SELECT token, count(DISTINCT path) AS documents, count(*) AS occurrences
        FROM (SELECT path, unnest(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+')) AS token FROM doc_cache) WHERE token <> '' AND strlen(token) < 40 GROUP BY token""",
    "q23_snippet": f"""
        WITH {_LINES}, s AS (SELECT file_path, line_text AS t, strpos(lower(line_text), '{WORD}') - 1 AS m, length(line_text) AS len FROM ({_first(WORD)})),
        w AS (SELECT *, greatest(0, least(m - {(100 - len(WORD)) // 2}, len - 100)) AS a FROM s)
        SELECT file_path, CASE WHEN len <= 100 THEN trim(t, ' ') ELSE (CASE WHEN a > 0 THEN '...' ELSE '' END) || substr(t, CAST(a + 1 AS BIGINT), 100) || (CASE WHEN a + 100 < len THEN '...' ELSE '' END) END AS snippet FROM w""",
    "q23_extract": f"""
        WITH s AS (SELECT path, content, strpos(lower(content), '{WORD}') AS m FROM doc_cache)
        SELECT path, CASE WHEN m > 0 THEN substr(content, greatest(m - 50, 1), m - greatest(m - 50, 1) + {len(WORD)} + 100) ELSE substr(content, 1, 150) END AS snippet FROM s""",
    "q24_format_size": f"SELECT seq, {_SIZE} AS size_formatted FROM file_index",
    "q25_format_time": f"SELECT seq, CASE WHEN {SECONDS} <= 0 THEN '-' ELSE strftime(make_timestamp(CAST({SECONDS} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') END AS mtime_formatted FROM file_index",
    "q26_percent_decode": "SELECT seq, name AS decoded FROM file_index",
    "q27_xml_unescape": "SELECT seq, 'a < ' || replace(replace(replace(name, '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' \"x\" '' ' AS text FROM file_index",
    "q28_strip_tags": r"""
        SELECT path, replace(regexp_replace(regexp_replace('<p class="x">' || content || '</p> > <br', '<[^>]*>', ' ', 'g'), '<[^>]*$', ''), '>', ' ') AS text FROM doc_cache""",
    "q28_lines": f"WITH {_LINES} SELECT path, CAST(count(n) AS BIGINT) AS lines FROM doc_cache LEFT JOIN doc_lines USING (path) GROUP BY path",
    "q29_noisy_paths": f"SELECT seq, {_NOISY} AS noisy, ({_NOISY} OR {_like(paths.INDEXER_PARTS, 'contains')}) AS skipped FROM file_index",
    "q30_candidates": f"SELECT seq, full_path, ext, size FROM file_index WHERE {_CANDIDATE}",
    "q31_freshness": """
        SELECT full_path, mtime FROM snapshot_file_item a WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM snapshot_file_item) AND NOT EXISTS (
            SELECT 1 FROM snapshot_file_item b WHERE b.snapshot_ts = (SELECT max(snapshot_ts) FROM snapshot_file_item WHERE snapshot_ts < (SELECT max(snapshot_ts) FROM snapshot_file_item)) AND b.full_path = a.full_path AND b.mtime = a.mtime)""",
    "q31_folding": f"""
        SELECT seq, CASE WHEN is_directory THEN '' WHEN contains(name, '.') THEN lower(list_last(string_split(name, '.'))) ELSE '' END AS ext,
               CASE WHEN length(name) > 30 THEN substr(name, 1, 27) || '...' ELSE name END AS short, {_NAME.format('full_path')} AS file_name FROM file_index""",
    "q32_ghosts": """
        SELECT seq, full_path FROM snapshot_file_item WHERE snapshot_ts = (SELECT min(snapshot_ts) FROM snapshot_file_item) AND NOT is_directory AND ext IN ('pdf', 'docx')
          AND full_path IN (SELECT full_path FROM snapshot_file_item WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM snapshot_file_item))""",
    "q33_complete": f"""
        WITH page AS (SELECT seq, name, full_path, size, mtime, is_directory, ext FROM snapshot_file_item WHERE snapshot_ts = (SELECT min(snapshot_ts) FROM snapshot_file_item) AND NOT is_directory
            AND ext IN ('doc', 'docx', 'pdf', 'txt', 'md', 'xls', 'xlsx', 'csv', 'ppt', 'pptx', 'wps', 'rtf', 'odt', 'epub', 'log', 'tex') ORDER BY seq LIMIT 500),
        live AS (SELECT full_path, max(size) AS s, max(mtime) AS m FROM snapshot_file_item WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM snapshot_file_item) GROUP BY full_path)
        SELECT seq, name, page.full_path, CASE WHEN size = 0 OR mtime = 0 THEN coalesce(s, size) ELSE size END AS size,
               CASE WHEN size = 0 OR mtime = 0 THEN coalesce(m, mtime) ELSE mtime END AS mtime, is_directory, ext
        FROM page LEFT JOIN live ON page.full_path = live.full_path""",
}
