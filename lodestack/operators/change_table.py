"""A table kept current from a change feed by delete vectors.

Rows never change in place. A batch of changes is reduced to one image per key; the images it supersedes are located
through the key-to-position index and get their bits set in per-file bitmaps (delete vectors), and the merged images
are appended. Reads skip the positions whose bit is set, and nothing else: every key has one live image.

An image holds what the records of a key amount to, in a form that merges in any order: the last delete, the creates
after it, the last new name and the last change of attributes, each with its usn. Merging takes maxima and a set
union, so repeated records change nothing and late ones land where they belong.

Images and index are laid out in buckets by a hash of the key. A batch reads the buckets its keys fall into, no others. The files
and bitmaps that make up the table are listed in a manifest that is renamed into place after all of a batch is written:
a table opened again, by another process or after a failure, is that of the last whole batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import Scratch, Versions, delete_folder

#: Reason bits in order of precedence.
REASON_BITS = (("create", 0x1), ("delete", 0x2), ("old_name", 0x20), ("new_name", 0x40), ("modify", 0x4))

KEY = ["volume", "frn"]
#: Journal bytes per segment: the records of a key are first reduced by segment, so a key with very many records is spread.
SEGMENT_BYTES = 1 << 22
#: Buckets of a table, by a hash of the key; for a large table, about as many as a batch has tasks.
BUCKETS = 16
#: Batches after which superseded images, their index entries and bitmaps are left behind.
COMPACT_EVERY = 16
_ROW = "struct<usn:bigint,parent:bigint,name:string,attributes:int>"
IMAGE = f"volume string, frn bigint, deleted bigint, creates array<{_ROW}>, renamed {_ROW}, modified struct<usn:bigint,attributes:int>, bucket int"
INDEX = "volume string, frn bigint, batch int, file string, pos bigint, bucket int"


#: Files of one write bear the same name in several buckets.
_FILE_SQL = "concat(bucket, '/', _metadata.file_name)"


def classify(reason: Column) -> Column:
    """The kind of change of a reason: the first of REASON_BITS that is set, else null."""
    kind = F.lit(None).cast("string")
    for name, bit in reversed(REASON_BITS):
        kind = F.when(reason.bitwiseAND(F.lit(bit)) != 0, F.lit(name)).otherwise(kind)
    return kind


def journal_changes(records: DataFrame) -> DataFrame:
    """Journal records as changes (arrival, volume, frn, usn, op, parent, name, attributes).

    Records without a name (null or empty), without a known reason bit, or with null usn, reason or file
    reference are skipped: nothing says what they change or when."""
    op = classify(F.col("reason"))
    return records.select(
        F.col("read_no").alias("arrival"), "volume", F.col("file_reference_number").alias("frn"), "usn",
        op.alias("op"), F.col("parent_file_reference_number").alias("parent"), F.col("file_name").alias("name"),
        F.col("file_attributes").alias("attributes"),
    ).where(
        F.col("op").isNotNull() & F.col("usn").isNotNull() & F.col("frn").isNotNull() & (F.length("name") > 0)
    )


def _tidy(deleted: Column, creates: Column) -> Column:
    """The creates that the last known delete leaves standing."""
    return F.array_sort(F.array_distinct(F.filter(creates, lambda c: deleted.isNull() | (c["usn"] > deleted))))


def _merged(images: DataFrame, *keys: str) -> DataFrame:
    """Images of equal keys as one."""
    grouped = images.groupBy(*keys).agg(
        F.max("deleted").alias("deleted"), F.flatten(F.collect_list("creates")).alias("creates"),
        F.max("renamed").alias("renamed"), F.max("modified").alias("modified"),
    )
    return grouped.withColumn("creates", _tidy(F.col("deleted"), F.col("creates")))


def key_images(changes: DataFrame, segment_bytes: int = SEGMENT_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """One image per key, with its bucket. Records are reduced by journal segment first, with partial aggregation before the
    shuffle, and the few images of a key's segments are then merged where its bucket is."""
    full = F.struct("usn", "parent", "name", "attributes")
    seg = F.floor(F.col("usn") / F.lit(segment_bytes)).cast("bigint").alias("segment")
    parts = changes.groupBy(*KEY, seg).agg(
        F.max(F.when(F.col("op") == "delete", F.col("usn"))).alias("deleted"),
        F.collect_set(F.when(F.col("op") == "create", full)).alias("creates"),
        F.max(F.when(F.col("op") == "new_name", full)).alias("renamed"),
        F.max(F.when(F.col("op").isin("new_name", "modify"), F.struct("usn", "attributes"))).alias("modified"),
    )
    parts = parts.withColumn("creates", _tidy(F.col("deleted"), F.col("creates")))
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
    return _merged(parts.withColumn("bucket", bucket).repartition("bucket"), "bucket", *KEY)


class ChangeTable:
    """Images in append-only files under one folder, with their index and delete vectors. `notes` are a caller's own
    values, kept in the manifest with the batch they belong to."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every
        self.versions = Versions(spark, f"{self.folder}/manifest")
        self.version, text = self.versions.newest()
        state = json.loads(text) if text else {"buckets": buckets, "batches": 0, "images": [], "index": [], "vectors": [], "notes": {}}
        self.state: dict = state

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    @property
    def notes(self) -> dict:
        return self.state["notes"]

    def _path(self, name: str) -> str:
        return f"{self.folder}/data/{self.state['batches']:06d}-{name}-{uuid.uuid4().hex[:8]}"

    def _read(self, kind: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "false")
        parts = [rows.parquet(p) for p in self.state[kind]]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def _positions(self, buckets: list[int] | None = None) -> DataFrame:
        """Images with the name and position of their row."""
        at = [F.expr(_FILE_SQL).alias("file"), F.col("_metadata.row_index").alias("pos")]
        parts = [self.spark.read.schema(IMAGE).parquet(p).select("*", *at) for p in self.state["images"]]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def apply(self, changes: DataFrame, segment_bytes: int = SEGMENT_BYTES, notes: dict | None = None) -> None:
        """Apply one batch, whatever order its records and batches come in."""
        scratch = Scratch(self.spark, "batch")
        fresh = images = key_images(changes, segment_bytes, self.buckets)
        state = dict(self.state, vectors=list(self.state["vectors"]))
        if state["images"]:
            fresh = scratch.cut(images, "images")
            touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # no more than there are buckets
            same = [F.col(f"i.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ["bucket", *KEY]]
            found = self._read("index", INDEX, touched).alias("i").join(fresh.select("bucket", *KEY).alias("n"), same, "left_semi")
            located = scratch.cut(found.groupBy("bucket", *KEY).agg(F.max(F.struct("batch", "file", "pos")).alias("at")).select("bucket", "at.file", "at.pos"), "located")
            state["vectors"].append(self._write(self._bitmaps(located), "vectors"))
            old = self._positions(touched).join(located, ["bucket", "file", "pos"], "left_semi").drop("file", "pos")
            images = _merged(fresh.unionByName(old), "bucket", *KEY)
        self._append(state, images, notes)
        scratch.delete()
        if len(self.state["images"]) >= self.compact_every:
            self.compact()

    def _write(self, rows: DataFrame, name: str, *by: str) -> str:
        path = self._path(name)
        (rows.write.partitionBy(*by) if by else rows.write).parquet(path)
        return path

    def _append(self, state: dict, images: DataFrame, notes: dict | None) -> None:
        """Write images and their index, and make the state with them the table's."""
        path = self._write(images.select(*KEY, "deleted", "creates", "renamed", "modified", "bucket"), "images", "bucket")
        written = self.spark.read.schema(IMAGE).parquet(path).select(
            *KEY, F.lit(state["batches"]).cast("int").alias("batch"), F.expr(_FILE_SQL).alias("file"), F.col("_metadata.row_index").alias("pos"), "bucket",
        )
        index = self._write(written, "index", "bucket")
        state = dict(state, batches=state["batches"] + 1, images=[*state["images"], path], index=[*state["index"], index], notes=self.notes if notes is None else notes)
        self.versions.publish(self.version + 1, json.dumps(state))
        self.version, self.state = self.version + 1, state

    def _bitmaps(self, located: DataFrame) -> DataFrame:
        """Delete vectors of positions: one bitmap per file and 32,768 positions."""
        number = F.col("pos") + 1
        return located.groupBy("file", F.bitmap_bucket_number(number).alias("part")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
        )

    def live_images(self) -> DataFrame:
        """The images whose position isn't set in their file's delete vectors: one for each key."""
        if not self.state["images"]:
            return self.spark.createDataFrame([], IMAGE).drop("bucket")
        images = self._positions()
        if not self.state["vectors"]:
            return images.drop("file", "pos", "bucket")
        parts = self.spark.read.schema("file string, part bigint, bits binary").parquet(*self.state["vectors"])
        vectors = parts.groupBy("file", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
        bit = F.bitmap_bit_position(F.col("pos") + 1)
        byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return (
            images.withColumn("part", F.bitmap_bucket_number(F.col("pos") + 1)).join(vectors, ["file", "part"], "left")
            .where(F.col("bits").isNull() | (F.getbit(byte, (bit % 8).cast("int")) == 0))
            .drop("file", "part", "pos", "bits", "bucket")
        )

    def current(self) -> DataFrame:
        """The files that exist: (volume, frn, parent, name, attributes).

        A file exists if it was created after its last delete; the first such create stands (a create of a known
        file does nothing). Parent and name come from the last new name after it, attributes from the last new
        name or modification after it."""
        standing = self.live_images().withColumn("created", F.array_min("creates")).where(F.col("created").isNotNull())
        named = F.when(F.col("renamed.usn") > F.col("created.usn"), F.col("renamed")).otherwise(F.col("created"))
        attributes = F.when(F.col("modified.usn") > F.col("created.usn"), F.col("modified.attributes")).otherwise(
            F.col("created.attributes")
        )
        return standing.withColumn("named", named).select(
            "volume", "frn", F.col("named.parent").alias("parent"), F.col("named.name").alias("name"),
            attributes.alias("attributes"),
        )

    def compact(self) -> None:
        """Write the live images anew, as one batch without vectors, and delete the files that no reader of this or the
        version before needs."""
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")
        before = [*self.state["images"], *self.state["index"], *self.state["vectors"]]
        stale = self.state.get("stale", [])
        state = dict(self.state, images=[], index=[], vectors=[], stale=before)
        self._append(state, self.live_images().withColumn("bucket", bucket).repartition("bucket"), None)
        for path in stale:
            delete_folder(self.spark, path)


def apply_feed(
    spark: SparkSession, records: DataFrame, batches: int = 3, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """The current rows after a whole journal, applied as `batches` batches in order of arrival (read_no).

    Defined cases: an empty feed gives an empty table; null volumes are one volume; a null arrival counts to the
    first batch; records of one usn that differ are resolved towards the greater values. Only the journal's own columns are read."""
    changes = journal_changes(records)
    low, high = changes.agg(F.min("arrival"), F.max("arrival")).first()
    table = ChangeTable(spark, Scratch(spark, "changes").root)
    if low is None:
        table.apply(changes, segment_bytes)
        return table.current()
    step = (high - low) // batches + 1
    for k in range(batches):
        part = (F.col("arrival") >= low + k * step) & (F.col("arrival") < low + (k + 1) * step)
        table.apply(changes.where(part | F.col("arrival").isNull() if k == 0 else part), segment_bytes)
    return table.current()
