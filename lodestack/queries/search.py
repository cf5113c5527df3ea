"""q01-q15: metadata search over the file index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.pinyin import pinyin
from lodestack.operators.hierarchy import LOW_48, ROOT_PARENTS, resolve_hierarchy
from lodestack.operators.search import Matches, contains_filter, exclude, list_directory, listing_totals, rebase, search
from lodestack.plans.query_parser import MACROS, parse
from lodestack.sources.tables import table

NOW = 1_720_000_000
SECONDS = "CASE WHEN mtime >= 1000000000000000 THEN (mtime - 116444736000000000 - ((mtime - 116444736000000000) % 10000000 + 10000000) % 10000000) // 10000000 ELSE mtime END"
_ITEM = "seq, name, full_path, size, mtime, is_directory, ext"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_index")


def _query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _matches(spark, sf_dir, text).matched.select("seq", "name", "full_path", "size", "mtime", "is_directory", "ext")

    run.__doc__ = f"All matches of the query {text!r}."
    return run


#: The index has no sound or film: for these two searches pictures count as some.
_RECAST = {"video": ("png", "mp4"), "audio": ("jpg", "mp3")}


def _recast_query(macro: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        old, new = _RECAST[macro]
        files = _files(spark, sf_dir).withColumn("ext", F.when(F.col("ext") == old, new).otherwise(F.col("ext")))
        return search(files, parse(f"type:{macro}", NOW)).matched.select("seq", "name", "full_path", "size", "mtime", "is_directory", "ext")

    run.__doc__ = f"All matches of type:{macro}, with pictures as such files."
    return run


def _matches(spark: SparkSession, sf_dir: str, text: str) -> Matches:
    return search(_files(spark, sf_dir), parse(text, NOW))


def _term(word: str) -> str:
    return f"(contains(name_lower, '{word}') OR coalesce(contains(pinyin_first, '{word}'), false) OR coalesce(contains(pinyin_full, '{word}'), false))"


def _ext(*names: str) -> str:
    return f"(NOT is_directory AND ext IN ({', '.join(repr(n) for n in names)}))"


def q01_search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, "report ext:docx|pdf|xlsx size:>1kb").summary()


def q11_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(
        [(1, "E:\\Minutes", False, 0), (2, "F:\\", False, 0), (3, r"\.tmp$", True, 0), (4, "", False, 0)],
        "id bigint, pattern string, is_regex boolean, created_at bigint",
    )
    return exclude(_files(spark, sf_dir), rules).groupBy("volume").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def q12_pinyin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinyin of all names, from the table of this session."""
    first, full = pinyin(spark, F.col("name"))
    return _files(spark, sf_dir).select("seq", first.alias("pinyin_first"), full.alias("pinyin_full"))


def q13_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, "type:doc").page(offset=40, limit=25)


def _root_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("parent_frn").bitwiseAND(F.lit(LOW_48))
    return _files(spark, sf_dir).where((F.col("volume") == "E") & low.isin(*ROOT_PARENTS))


def q14_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_directory(_root_children(spark, sf_dir))


def q14_ls_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_totals(_root_children(spark, sf_dir))


def q07_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contains_filter(_files(spark, sf_dir), "Notes").select("seq", "full_path")


def q36_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths after everything on F: moved into a folder: the prefix rewrite of a rename."""
    return rebase(_files(spark, sf_dir), "F:", "F:\\moved").select("seq", "full_path", "full_path_lower")


def q15_path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_node").select("volume", F.col("frn").alias("id"), F.col("parent_frn").alias("parent"), "seq", "name")
    resolved = resolve_hierarchy(rows, ["volume"], "seq", name="name").where("status <> 'loop'")
    return resolved.select(
        "volume", F.col("id").alias("frn"), "status", F.concat("volume", F.lit(":\\"), "full_path").alias("full_path"), F.col("depth").alias("node_depth")
    )


def q05_volume_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.sources.files import drop_system, scan_counts, union_volumes

    nodes = table(spark, sf_dir, "raw_node")
    volumes = [r[0] for r in nodes.select("volume").where("volume is not null").distinct().collect()]  # those of a machine
    parts = [drop_system(nodes.where(F.col("volume") == v)) for v in volumes]
    return scan_counts(union_volumes(parts or [drop_system(nodes)]))


_SEARCHES = {
    "q02_ext": ("ext:docx|pdf", _ext("docx", "pdf")),
    "q03_size_range": ("size:10kb-1mb", "size BETWEEN 10240 AND 1048576"),
    "q03_size_at_least": ("size:>1.5MB budget", f"size >= 1572864 AND {_term('budget')}"),
    "q04_date_range": ("dm:>2018-01-01 dm:<2020-06-30", f"{SECONDS} >= 1514764800 AND {SECONDS} <= 1593475200"),
    "q04_date_rolling": ("dm:thisyear", f"{SECONDS} >= {NOW - 365 * 86400}"),
    "q05_type_folder": ("type:folder plan", f"is_directory AND {_term('plan')}"),
    "q05_type_file": ("kind:file size:<100", "NOT is_directory AND size <= 100"),
    **{f"q06_type_{m}": (f"type:{m}", _ext(*MACROS[m].split())) for m in MACROS if m not in ("video", "audio")},
    "q07_path_incl_excl": (
        r"path:e:\ -path:draft !path:plan notes",
        rf"contains(full_path_lower, 'e:\') AND NOT contains(full_path_lower, 'draft') AND NOT contains(full_path_lower, 'plan') AND {_term('notes')}",
    ),
    "q08_regex": (r"regex:^[a-z]+_[A-Z][a-z]+\s?\(\d+\)\.(?:txt|md)$", r"regexp_matches(name, '^[a-z]+_[A-Z][a-z]+\s?\(\d+\)\.(?:txt|md)$') OR regexp_matches(full_path, '^[a-z]+_[A-Z][a-z]+\s?\(\d+\)\.(?:txt|md)$')"),
    "q09_glob_name": ("*plan*20??.*", f"{_term('*plan*20??.*')} OR regexp_full_match(name_lower, '(?s).*plan.*20..\\..*')"),
    "q10_glob_path": (
        r"\plan*\*.md", rf"{_term(chr(92) + 'plan*' + chr(92) + '*.md')} OR regexp_full_match(full_path_lower, '(?s).*\\plan.*\\.*\.md.*') OR regexp_full_match(name_lower, '(?s)\\plan.*\\.*\.md')",
    ),
    "q12_pinyin_term": ("jy", _term("jy")),
    "q01_terms": ('"copy of" plan', f"{_term('copy of')} AND {_term('plan')}"),
}

QUERIES = {
    "q01_search_summary": q01_search_summary,
    **{name: _query(text) for name, (text, _) in _SEARCHES.items()},
    **{f"q06_type_{macro}": _recast_query(macro) for macro in _RECAST},
    "q05_volume_counts": q05_volume_counts,
    "q07_contains": q07_contains,
    "q36_rebase": q36_rebase,
    "q11_exclusions": q11_exclusions,
    "q12_pinyin": q12_pinyin,
    "q13_page_offset": q13_page_offset,
    "q14_ls": q14_ls,
    "q14_ls_totals": q14_ls_totals,
    "q15_path_tree": q15_path_tree,
}
_ROOT_CHILDREN = f"FROM file_index WHERE volume = 'E' AND (parent_frn & {LOW_48}) IN (0, 5, {LOW_48})"
ORACLES = {
    "q01_search_summary": f"""
        SELECT count(*) AS total_matches, (SELECT count(*) FROM file_index) AS total_files,
               CAST(coalesce(sum(CASE WHEN NOT is_directory THEN size END), 0) AS BIGINT) AS total_bytes
        FROM file_index WHERE {_ext('docx', 'pdf', 'xlsx')} AND size >= 1024 AND {_term('report')}""",
    **{name: f"SELECT {_ITEM} FROM file_index WHERE {where}" for name, (_, where) in _SEARCHES.items()},
    **{f"q06_type_{macro}": f"""
        SELECT * FROM (SELECT * REPLACE (CASE WHEN ext = '{old}' THEN '{new}' ELSE ext END AS ext) FROM (SELECT {_ITEM} FROM file_index)) WHERE {_ext(*MACROS[macro].split())}"""
       for macro, (old, new) in _RECAST.items()},
    "q05_volume_counts": """
        SELECT volume, count(*) AS entries FROM raw_node
        WHERE NOT (is_directory AND lower(name) IN ('$recycle.bin', 'system volume information', '$mft', '$mftmirr', '$logfile',
            '$volume', '$bitmap', '$boot', '$badclus', '$secure', '$upcase', '$extend')) AND volume IS NOT NULL GROUP BY volume""",
    "q11_exclusions": r"""
        SELECT volume, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM file_index
        WHERE NOT starts_with(full_path_lower, 'e:\minutes') AND NOT starts_with(full_path_lower, 'f:\')
          AND NOT regexp_matches(full_path_lower, '\.tmp$') GROUP BY volume""",
    "q07_contains": "SELECT seq, full_path FROM file_index WHERE contains(name_lower, 'notes') OR contains(full_path_lower, 'notes')",
    "q36_rebase": """
        SELECT seq, CASE WHEN starts_with(full_path, 'F:' || chr(92)) OR full_path = 'F:' THEN 'F:' || chr(92) || 'moved' || substr(full_path, 3) ELSE full_path END AS full_path,
               lower(CASE WHEN starts_with(full_path, 'F:' || chr(92)) OR full_path = 'F:' THEN 'F:' || chr(92) || 'moved' || substr(full_path, 3) ELSE full_path END) AS full_path_lower
        FROM file_index""",
    "q13_page_offset": f"SELECT {_ITEM} FROM file_index WHERE {_ext(*MACROS['doc'].split())} ORDER BY seq LIMIT 25 OFFSET 40",
    "q14_ls": f"""
        SELECT row_number() OVER (ORDER BY is_directory DESC, name_lower, seq) AS number, name, is_directory AS is_dir,
               CASE WHEN is_directory THEN 'DIR' WHEN ext = '' THEN '-' ELSE upper(ext) END AS type_str,
               CASE WHEN is_directory THEN 'folder' {' '.join(f"WHEN ext IN ({', '.join(map(repr, MACROS[m].split()))}) THEN '{m}'" for m in MACROS)} ELSE 'file' END AS icon,
               CASE WHEN is_directory THEN '<DIR>' WHEN size < 1024 THEN size || ' B'
                    WHEN size < 1024 ** 2 THEN printf('%.1f KB', size / 1024.0) WHEN size < 1024 ** 3 THEN printf('%.1f MB', size / 1048576.0)
                    WHEN size < 1024 ** 4 THEN printf('%.1f GB', size / 1073741824.0) ELSE printf('%.1f TB', size / 1099511627776.0) END AS size_formatted,
               CASE WHEN {SECONDS} <= 0 THEN '-' ELSE strftime(make_timestamp(CAST({SECONDS} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') END AS mtime_formatted
        {_ROOT_CHILDREN}""",
    "q14_ls_totals": f"""
        SELECT count(*) FILTER (is_directory) AS dirs, count(*) FILTER (NOT is_directory) AS files,
               CAST(coalesce(sum(size) FILTER (NOT is_directory), 0) AS BIGINT) AS bytes {_ROOT_CHILDREN}""",
    "q15_path_tree": f"""
        WITH RECURSIVE entry AS (
            SELECT volume, frn, arg_max(parent_frn, seq) AS parent, arg_max(name, seq) AS name FROM raw_node
            WHERE (frn & {LOW_48}) <> 5 GROUP BY volume, frn),
        tree AS (
            SELECT e.volume, e.frn, CASE WHEN (e.parent & {LOW_48}) IN (0, 5, {LOW_48}) THEN 'ok' ELSE 'orphan' END AS status,
                   e.volume || ':' || chr(92) || e.name AS full_path, CAST(0 AS BIGINT) AS node_depth
            FROM entry e LEFT JOIN entry p ON p.volume = e.volume AND p.frn = e.parent
            WHERE (e.parent & {LOW_48}) IN (0, 5, {LOW_48}) OR p.frn IS NULL
            UNION ALL
            SELECT e.volume, e.frn, t.status, t.full_path || chr(92) || e.name, t.node_depth + 1
            FROM tree t JOIN entry e ON e.volume = t.volume AND e.parent = t.frn
            WHERE (e.parent & {LOW_48}) NOT IN (0, 5, {LOW_48}))
        SELECT * FROM tree""",
}
