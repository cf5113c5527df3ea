"""p2, p3 and p5: change feeds, hierarchies and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.times import unix_seconds
from lodestack.operators.change_table import apply_feed
from lodestack.operators.hierarchy import descendants, resolve_hierarchy
from lodestack.operators.snapshots import snapshot_changes
from lodestack.queries.maintenance import STATE
from lodestack.queries.search import SECONDS
from lodestack.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = apply_feed(spark, table(spark, sf_dir, "usn_record_v2"))
    return files.select(
        "volume", F.col("frn").alias("file_reference_number"), F.col("parent").alias("parent_file_reference_number"),
        F.col("name").alias("file_name"), F.col("attributes").alias("file_attributes"),
    )


def _links(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, t).select(
            F.lit(t).alias("tab"), "volume", F.col("frn").alias("id"), F.col("parent_frn").alias("parent"), "seq", *extra
        )
        for t in ("raw_node", "file_index")
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_hierarchy(_links(spark, sf_dir), ["tab", "volume"], "seq", only_unrooted=True)
    return found.select(
        "tab", "volume", F.col("id").alias("frn"), "status", F.col("top").alias("top_frn"),
        F.col("depth").cast("bigint").alias("node_depth"),
    )


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path, depth and root of every entry; orphans hang below their volume."""
    resolved = resolve_hierarchy(_links(spark, sf_dir, "name"), ["tab", "volume"], "seq", name="name")
    path = F.concat(F.col("volume"), F.lit(":\\"), F.col("full_path"))
    return resolved.select(
        "tab", "volume", F.col("id").alias("frn"), "status", F.col("top").alias("top_frn"),
        F.col("depth").alias("node_depth"), path.alias("full_path"),
    )


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry below every entry above it, and the steps between them."""
    resolved = resolve_hierarchy(_links(spark, sf_dir), ["tab", "volume"], "seq", ancestors=True)
    return descendants(resolved, ["tab", "volume"]).select("tab", "volume", F.col("ancestor").alias("top_frn"), F.col("id").alias("frn"), "distance")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every entry with descendants: how many there are, and how deep they go."""
    return p3_pairs(spark, sf_dir).groupBy("tab", "volume", F.col("top_frn").alias("frn")).agg(
        F.count("*").alias("descendants"), F.max("distance").alias("height")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"size": F.col("size"), "mtime": unix_seconds(F.col("mtime"))}
    changes = snapshot_changes(
        table(spark, sf_dir, "snapshot_file_item"), "snapshot_ts", "full_path_lower", "seq", values
    )
    return changes


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_pairs": p3_pairs,
    "p3_descendants": p3_descendants,
    "p5_found": p5_found,
}

_LOW = (1 << 48) - 1
_ENTRY = f"""
    entry AS (SELECT tab, volume, frn, arg_max(parent_frn, seq) AS parent, arg_max(name, seq) AS name
              FROM (SELECT 'raw_node' AS tab, volume, frn, parent_frn, seq, name FROM raw_node
                    UNION ALL SELECT 'file_index', volume, frn, parent_frn, seq, name FROM file_index)
              WHERE (frn & {_LOW}) <> 5 GROUP BY tab, volume, frn),
    tree AS (
        SELECT tab, volume, frn, frn AS top_frn, CAST(0 AS BIGINT) AS node_depth, name AS path FROM entry WHERE (parent & {_LOW}) IN (0, 5, {_LOW})
        UNION ALL
        SELECT e.tab, e.volume, e.frn, t.top_frn, t.node_depth + 1, t.path || chr(92) || e.name
        FROM tree t JOIN entry e ON e.tab = t.tab AND e.volume = t.volume AND e.parent = t.frn WHERE (e.parent & {_LOW}) NOT IN (0, 5, {_LOW})),
    rest AS (SELECT e.* FROM entry e ANTI JOIN tree t ON t.tab = e.tab AND t.volume = e.volume AND t.frn = e.frn),
    up AS (
        SELECT tab, volume, frn, [frn] AS way, parent AS next, false AS ended FROM rest
        UNION ALL
        SELECT u.tab, u.volume, u.frn, list_append(u.way, u.next), r.parent, list_contains(list_append(u.way, u.next), r.parent)
        FROM up u JOIN rest r ON r.tab = u.tab AND r.volume = u.volume AND r.frn = u.next WHERE NOT u.ended AND NOT list_contains(u.way, u.next)),
    lost AS (
        SELECT u.tab, u.volume, u.frn, 'orphan' AS status, u.way[-1] AS top_frn, CAST(len(u.way) - 1 AS BIGINT) AS node_depth
        FROM up u ANTI JOIN rest r ON r.tab = u.tab AND r.volume = u.volume AND r.frn = u.next
        UNION ALL
        SELECT tab, volume, frn, 'loop', list_min(way[list_position(way, next):]), CAST(list_position(way, next) - 1 AS BIGINT)
        FROM up WHERE list_contains(way, next))"""
_PAIRS = f"""
    {_ENTRY}, pair AS (
        SELECT e.tab, e.volume, e.parent AS ancestor, e.frn, [e.frn, e.parent] AS way FROM entry e
        JOIN entry p ON p.tab = e.tab AND p.volume = e.volume AND p.frn = e.parent WHERE (e.parent & {_LOW}) NOT IN (0, 5, {_LOW}) AND e.parent <> e.frn
        UNION ALL
        SELECT a.tab, a.volume, p.parent, a.frn, list_append(a.way, p.parent) FROM pair a JOIN entry p ON p.tab = a.tab AND p.volume = a.volume AND p.frn = a.ancestor
        JOIN entry q ON q.tab = a.tab AND q.volume = a.volume AND q.frn = p.parent WHERE (p.parent & {_LOW}) NOT IN (0, 5, {_LOW}) AND NOT list_contains(a.way, p.parent))"""
ORACLES = {
    "p2_found": f"""
        WITH {STATE} SELECT volume, frn AS file_reference_number, parent AS parent_file_reference_number, name AS file_name, attributes AS file_attributes FROM state""",
    "p3_found": f"WITH RECURSIVE {_ENTRY} SELECT * FROM lost",
    "p3_paths": f"""
        WITH RECURSIVE {_ENTRY}, below AS (
            SELECT l.tab, l.volume, l.frn, e.name AS path FROM lost l JOIN entry e ON e.tab = l.tab AND e.volume = l.volume AND e.frn = l.frn WHERE l.status = 'orphan' AND l.node_depth = 0
            UNION ALL
            SELECT e.tab, e.volume, e.frn, b.path || chr(92) || e.name FROM below b JOIN rest e ON e.tab = b.tab AND e.volume = b.volume AND e.parent = b.frn)
        SELECT tab, volume, frn, 'ok' AS status, top_frn, node_depth, volume || ':' || chr(92) || path AS full_path FROM tree
        UNION ALL
        SELECT l.*, l.volume || ':' || chr(92) || b.path FROM lost l LEFT JOIN below b ON b.tab = l.tab AND b.volume = l.volume AND b.frn = l.frn""",
    "p3_pairs": f"WITH RECURSIVE {_PAIRS} SELECT tab, volume, ancestor AS top_frn, frn, CAST(len(way) - 1 AS BIGINT) AS distance FROM pair",
    "p3_descendants": f"""
        WITH RECURSIVE {_PAIRS} SELECT tab, volume, ancestor AS frn, count(*) AS descendants, CAST(max(len(way) - 1) AS BIGINT) AS height FROM pair GROUP BY tab, volume, ancestor""",
    "p5_found": f"""
        WITH item AS (SELECT snapshot_ts AS taken, full_path_lower AS k, arg_max(coalesce(size, -1), seq) AS size, arg_max({SECONDS}, seq) AS t
                      FROM snapshot_file_item GROUP BY 1, 2),
        step AS (SELECT taken AS earlier, lead(taken) OVER (ORDER BY taken) AS later FROM (SELECT DISTINCT snapshot_ts AS taken FROM snapshot_file_item)),
        old AS (SELECT later AS taken, k, size, t FROM item JOIN step ON item.taken = step.earlier WHERE later IS NOT NULL),
        new AS (SELECT item.* FROM item JOIN step ON item.taken = step.later)
        SELECT coalesce(new.taken, old.taken) AS snapshot_ts, coalesce(new.k, old.k) AS full_path_lower,
               CASE WHEN old.k IS NULL THEN 'added' WHEN new.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
        FROM new FULL JOIN old ON new.taken = old.taken AND new.k = old.k
        WHERE old.k IS NULL OR new.k IS NULL OR new.size <> old.size OR new.t <> old.t""",
}
