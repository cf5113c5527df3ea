"""File listings as sources: enumerated entries, directory trees, snapshots, JSON lists."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.functions.paths import KNOWLEDGE_CAP, SKIPPED_FOLDERS, SYSTEM_NAMES, TEXT_DOCUMENTS
from lodestack.functions.pinyin import pinyin
from lodestack.functions.scalars import extension
from lodestack.session import Scratch, ship_package

#: Attributes of files, and the id of a volume's root.
HIDDEN, DIRECTORY, ARCHIVE, ROOT_FRN = 2, 16, 32, 5


def read_entries(spark: SparkSession, path: str, volume: str, fmt: str = "parquet") -> DataFrame:
    """The enumerated entries of one volume, without its system folders."""
    rows = spark.read.schema(schemas.FILE_ENTRY).format(fmt).load(path)
    return drop_system(rows).withColumn("volume", F.lit(volume))


def drop_system(entries: DataFrame) -> DataFrame:
    return entries.where(~(F.col("is_directory") & F.lower("name").isin(*SYSTEM_NAMES)))


def union_volumes(parts: list[DataFrame]) -> DataFrame:
    """All volumes in one table; at least one is needed."""
    if not parts:
        raise ValueError("no volume to read")
    return reduce(DataFrame.unionByName, parts)


def scan_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("volume").agg(F.count("*").alias("entries"))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime in Unix seconds, size) of all files below a folder, by listing only: contents aren't read.
    Spark's listing leaves out files and folders whose name starts with a dot or an underscore."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"))
    )


def _listed(folder: str) -> list[tuple]:
    """(path, name, is_directory, size, mtime, attributes, error) of what is right in a mounted folder, hidden names included."""
    out = []
    try:
        with os.scandir(folder) as found:
            for item in found:
                try:
                    is_dir, info = item.is_dir(follow_symlinks=False), item.stat(follow_symlinks=False)
                except OSError as error:
                    out.append((item.path, item.name, False, None, None, 0, str(error)))
                    continue
                hidden = HIDDEN if item.name.startswith(".") else 0
                out.append((item.path, item.name, is_dir, 0 if is_dir else info.st_size, int(info.st_mtime), hidden | (DIRECTORY if is_dir else ARCHIVE), None))
    except OSError as error:
        out.append((folder, None, None, None, None, None, str(error)))
    return out


_LISTED = "path string, name string, is_directory boolean, size bigint, mtime bigint, file_attributes int, error string"


def _list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in _LISTED.split(", ")]
    types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = _listed(folder)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def list_live(spark: SparkSession, folder: str) -> DataFrame:
    """What is right in a mounted folder now, folders first and by name: (path, name, is_directory, size, mtime). The folder is
    read where the task runs."""
    ship_package(spark)
    found = spark.createDataFrame([(folder,)], "path string").mapInArrow(_list_all, _LISTED)
    return found.where("error is null").select("path", "name", "is_directory", "size", "mtime").orderBy(F.desc("is_directory"), F.lower("name"), "name")


def enumerate_tree(spark: SparkSession, root: str, volume: str) -> DataFrame:
    """All entries below a mounted folder, folders and hidden names included, as enumerated ones: ids are hashes of paths,
    entries right below the folder have the root's id as parent. Level by level: the folders of a level are listed by as
    many tasks as it takes, and their folders are the next level. Every executor must have the folder mounted; what can't be
    listed is left out, and a folder that can't be opened at all raises."""
    scratch = Scratch(spark, "tree")
    ship_package(spark)
    root = root.rstrip("/") or "/"
    level = spark.createDataFrame([(root, ROOT_FRN)], "folder string, folder_frn bigint")
    levels, first = [], True
    while True:
        found = level.select("folder").repartition("folder").mapInArrow(_list_all, _LISTED)
        found = scratch.cut(found.withColumn("folder", F.when(F.col("name").isNull(), F.col("path")).otherwise(F.regexp_replace("path", r"/[^/]*$", ""))), "level")
        if first:
            failed = found.where("name is null").select("error").first()
            if failed:
                raise OSError(failed[0])
        first = False
        entries = found.where("name is not null and error is null").withColumn("folder", F.when(F.col("folder") == "", "/").otherwise(F.col("folder")))
        frn = F.xxhash64("path").bitwiseAND(F.lit((1 << 47) - 1)) + F.lit(1 << 47)
        entries = entries.join(level, "folder").select("path", frn.alias("frn"), F.col("folder_frn").alias("parent_frn"), "name", "size", "mtime", "file_attributes", "is_directory")
        levels.append(entries)
        level = entries.where("is_directory").select(F.col("path").alias("folder"), F.col("frn").alias("folder_frn"))
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels).drop("path").withColumn("volume", F.lit(volume))


def read_volumes(spark: SparkSession, readers: dict[str, list[Callable[[], DataFrame]]]) -> tuple[DataFrame | None, list[tuple[str, int, str]]]:
    """Entries of several volumes, each by the first of its readers that works, such as its enumeration and then a walk of its
    folders. A volume that none can read is left out and doesn't stop the others. Also returned: by volume, which reader it was (-1: none)
    and what went wrong before."""
    parts, report = [], []
    for volume, ways in readers.items():
        errors = []
        for k, way in enumerate(ways):
            try:
                rows = way()
                rows.isEmpty()  # opens the source
            except (PySparkException, OSError, ValueError) as error:
                errors.append(str(error).partition("\n")[0])
                continue
            parts.append(rows)
            report.append((volume, k, "; ".join(errors)))
            break
        else:
            report.append((volume, -1, "; ".join(errors)))
    return (union_volumes(parts) if parts else None), report


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The files right in a folder."""
    return spark.read.format("binaryFile").load(folder).select(
        "path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size")
    )


def folders_of(files: DataFrame) -> DataFrame:
    """The folders on the way to every file, from listed paths, each once."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select(F.explode(prefixes).alias("path")).where("path <> ''").distinct()


def knowledge_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of readable text files for the ranked index: not in hidden, system or build folders, of at most
    KNOWLEDGE_CAP bytes, valid UTF-8 and not blank. The filters on path and length come before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.substring("path", F.lit(len(root.rstrip("/")) + 1), F.length("path"))
    skipped = inside.rlike(r"/[.$][^/]*/") | F.lower(inside).rlike("/(?:" + "|".join(SKIPPED_FOLDERS) + ")/")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return (
        files.where((F.col("length") > 0) & (F.col("length") <= KNOWLEDGE_CAP) & ext.isin(*TEXT_DOCUMENTS) & ~skipped)
        .select("path", text.alias("content")).where(F.length(F.trim("content")) > 0)
    )


def index_files(resolved: DataFrame) -> DataFrame:
    """The file index of resolved files (seq, full_path, name, frn, parent_frn, is_directory, file_attributes, size, mtime,
    volume): all derived columns are computed here, once, for every way rows come in."""
    first, full = pinyin(resolved.sparkSession, F.col("name"))
    return resolved.select(
        "seq", "name", "full_path", F.lower("name").alias("name_lower"), F.lower("full_path").alias("full_path_lower"),
        first.alias("pinyin_first"), full.alias("pinyin_full"), extension(F.col("name"), F.col("is_directory")).alias("ext"),
        "size", "mtime", "is_directory", "file_attributes", "frn", "parent_frn", "volume",
    )


def save_snapshot(files: DataFrame, root: str, version: int, taken_at: int) -> str:
    """A full snapshot as one directory per version, by volume; readers see it only once it is whole."""
    target = f"{root}/version={version}"
    files.withColumn("snapshot_ts", F.lit(taken_at).cast("bigint")).write.mode("overwrite").partitionBy("volume").parquet(target)
    return target


def load_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(schemas.FILE_INDEX + ", snapshot_ts BIGINT").parquet(f"{root}/version={version}")


def read_folder_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings as one column, in the order of the list."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "folder"))


def write_folder_list(folders: DataFrame, path: str) -> None:
    """A user's list of folders as a JSON array of strings."""
    folders.orderBy("position").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("position", "folder"))), lambda s: s["folder"])).alias("value")).coalesce(1).write.mode("overwrite").text(path)
