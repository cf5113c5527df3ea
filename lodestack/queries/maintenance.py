"""q34-q40: the change feed step by step, keyed tables, and the stream against the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import keyed
from lodestack.operators.change_table import apply_feed, classify, journal_changes
from lodestack.operators.hierarchy import resolve_hierarchy
from lodestack.session import Scratch
from lodestack.sources.tables import table
from lodestack.streaming.journal import GAP, JournalMonitor, gaps, read_journal


#: Whole seconds of an event's time, whichever time zone the session is in.
EVENT_SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "usn_record_v2")


def q34_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _records(spark, sf_dir).groupBy("volume", classify(F.col("reason")).alias("op"))
    return kinds.agg(F.count("*").alias("records"), F.count_distinct("usn").alias("usns"))


def q34_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each file, by usn."""
    changes = journal_changes(_records(spark, sf_dir))
    last = changes.groupBy("volume", "frn").agg(F.max(F.struct("usn", "op", "name")).alias("last"))
    return last.select("volume", "frn", "last.usn", "last.op", "last.name")


def q35_apply_one_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that exist at the end, from one batch; equal to any other cut into batches."""
    return apply_feed(spark, _records(spark, sf_dir), batches=1)


def q36_rename_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all existing files after all renames: rebuilt from the final parents and names, so renames of several
    folders above a file need no order."""
    files = apply_feed(spark, _records(spark, sf_dir))
    rows = files.select("volume", F.col("frn").alias("id"), "parent", F.col("frn").alias("seq"), "name")
    resolved = resolve_hierarchy(rows, ["volume"], "seq", name="name")
    return resolved.where("status <> 'loop'").select(
        "volume", F.col("id").alias("frn"), "status", F.concat("volume", F.lit(":\\"), "full_path").alias("full_path")
    )


def q37_gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes whose second half of arrivals would be a gap after committing nothing but usn 0 of each volume."""
    records = _records(spark, sf_dir)
    middle = records.agg(((F.min("read_no") + F.max("read_no")) / 2).cast("bigint")).first()[0] or 0
    committed = records.select("volume").distinct().select("volume", F.lit(-GAP).cast("bigint").alias("next_usn"))
    return gaps(records.where(F.col("read_no") > middle), committed)


def q38_history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat_ws("-", "event_type", "user_id").alias("query"), F.expr(EVENT_SECONDS).alias("searched_at")
    )
    return keyed.newest(history, ["searched_at", "id"], 20)


def _favorites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id")).alias("file_path"), F.col("event_type").alias("file_name"),
        F.expr(EVENT_SECONDS).alias("added_at"),
    )
    first = rows.groupBy("file_path").agg(F.min(F.struct("id", "file_name", "added_at")).alias("r")).select("r.id", "file_path", "r.file_name", "r.added_at")
    return first, rows.where(F.col("file_name").isin("purchase", "click"))


def q39_favorites_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, changes = _favorites(spark, sf_dir)
    return keyed.upsert(current, changes, ["file_path"], "id")


def q39_favorites_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites without those that were bought more often than the mean."""
    current, changes = _favorites(spark, sf_dir)
    bought = changes.where("file_name = 'purchase'").groupBy("file_path").count()
    mean = bought.agg(F.avg("count")).first()[0] or 0.0
    return keyed.delete_keys(current, bought.where(F.col("count") > mean), ["file_path"])


def q40_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal as a stream of small files, applied batch by batch until all is read."""
    scratch = Scratch(spark, "stream")
    source = scratch.path("journal")
    _records(spark, sf_dir).repartition(3, "read_no").write.parquet(source)
    monitor = JournalMonitor(spark)
    monitor.start(read_journal(spark, source, files_per_batch=1), scratch.path("checkpoint")).awaitTermination()
    return monitor.table.current()


QUERIES = {f.__name__: f for f in (
    q34_classify, q34_last_state, q35_apply_one_batch, q36_rename_cascade, q37_gap_detect, q38_history_topk, q39_favorites_upsert,
    q39_favorites_delete, q40_stream,
)}

_OP = "CASE WHEN reason & 1 <> 0 THEN 'create' WHEN reason & 2 <> 0 THEN 'delete' WHEN reason & 32 <> 0 THEN 'old_name' WHEN reason & 64 <> 0 THEN 'new_name' WHEN reason & 4 <> 0 THEN 'modify' END"
_MASK = (1 << 48) - 1
#: The files that exist at the end: created after the last delete, named by the last new name, attributes by the last change.
STATE = f"""
    change AS (SELECT DISTINCT volume, file_reference_number AS frn, usn, {_OP} AS op, parent_file_reference_number AS parent, file_name AS name, file_attributes AS attributes
               FROM usn_record_v2 WHERE file_name <> '' AND {_OP} IS NOT NULL),
    gone AS (SELECT volume, frn, max(usn) AS usn FROM change WHERE op = 'delete' GROUP BY volume, frn),
    born AS (SELECT c.volume, c.frn, min(c.usn) AS usn FROM change c LEFT JOIN gone g ON g.volume = c.volume AND g.frn = c.frn
             WHERE c.op = 'create' AND c.usn > coalesce(g.usn, -1) GROUP BY c.volume, c.frn),
    later AS (SELECT c.* FROM change c JOIN born b ON b.volume = c.volume AND b.frn = c.frn
              WHERE c.usn = b.usn OR (c.usn > b.usn AND c.op IN ('new_name', 'modify'))),
    state AS (SELECT volume, frn, arg_max(parent, usn) FILTER (op <> 'modify') AS parent, arg_max(name, usn) FILTER (op <> 'modify') AS name,
                     arg_max(attributes, usn) AS attributes FROM later GROUP BY volume, frn)"""
ORACLES = {
    "q34_classify": f"SELECT volume, {_OP} AS op, count(*) AS records, count(DISTINCT usn) AS usns FROM usn_record_v2 GROUP BY 1, 2",
    "q34_last_state": f"WITH {STATE} SELECT volume, frn, max(usn) AS usn, arg_max(op, usn) AS op, arg_max(name, usn) AS name FROM change GROUP BY volume, frn",
    "q35_apply_one_batch": f"WITH {STATE} SELECT * FROM state",
    "q40_stream": f"WITH {STATE} SELECT * FROM state",
    "q36_rename_cascade": f"""
        WITH RECURSIVE {STATE}, tree AS (
            SELECT e.volume, e.frn, CASE WHEN (e.parent & {_MASK}) IN (0, 5, {_MASK}) THEN 'ok' ELSE 'orphan' END AS status, e.volume || ':' || chr(92) || e.name AS full_path
            FROM state e LEFT JOIN state p ON p.volume = e.volume AND p.frn = e.parent WHERE (e.parent & {_MASK}) IN (0, 5, {_MASK}) OR p.frn IS NULL
            UNION ALL
            SELECT e.volume, e.frn, t.status, t.full_path || chr(92) || e.name FROM tree t JOIN state e ON e.volume = t.volume AND e.parent = t.frn
            WHERE (e.parent & {_MASK}) NOT IN (0, 5, {_MASK}))
        SELECT * FROM tree""",
    "q37_gap_detect": f"""
        SELECT volume, CAST({-GAP} AS BIGINT) AS expected, min(usn) AS actual FROM usn_record_v2
        WHERE read_no > (SELECT (min(read_no) + max(read_no)) // 2 FROM usn_record_v2) GROUP BY volume HAVING min(usn) > 0""",
    "q38_history_topk": "SELECT event_id AS id, event_type || '-' || user_id AS query, CAST(floor(epoch(ts)) AS BIGINT) AS searched_at FROM events ORDER BY 3 DESC, 1 DESC LIMIT 20",
    "q39_favorites_upsert": """
        SELECT coalesce(max(event_id) FILTER (event_type IN ('purchase', 'click')), min(event_id)) AS id, 'u' || user_id AS file_path,
               coalesce(arg_max(event_type, event_id) FILTER (event_type IN ('purchase', 'click')), arg_min(event_type, event_id)) AS file_name,
               CAST(floor(epoch(coalesce(arg_max(ts, event_id) FILTER (event_type IN ('purchase', 'click')), arg_min(ts, event_id)))) AS BIGINT) AS added_at
        FROM events GROUP BY user_id""",
    "q39_favorites_delete": """
        SELECT min(event_id) AS id, 'u' || user_id AS file_path, arg_min(event_type, event_id) AS file_name, CAST(floor(epoch(arg_min(ts, event_id))) AS BIGINT) AS added_at
        FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') <= (SELECT avg(n) FROM (SELECT count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id))""",
}
