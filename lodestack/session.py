"""Sessions and the shared scratch folder in which intermediate tables are written."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders made for sessions without spark.checkpoint.dir, by application id.
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "lodestack", **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; every keyword (dots as double underscores) is a setting."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        folder = tempfile.mkdtemp(prefix="lodestack-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_DIRS[app] = "file://" + folder
    return _LOCAL_DIRS[app]


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target  # noqa: SLF001


class Versions:
    """Numbered versions of a small text under one folder. A version is written aside and renamed into place, so a reader
    sees a whole one or none, and of two writers of one number the later fails."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def newest(self) -> tuple[int, str | None]:
        """The highest number and its text; (0, None) without any."""
        fs, folder = _hadoop(self.spark, self.folder)
        if not fs.exists(folder):
            return 0, None
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if not number:
            return 0, None
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number}")  # noqa: SLF001
        stream = fs.open(at)
        try:
            return number, bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, number: int, text: str) -> None:
        fs, target = _hadoop(self.spark, f"{self.folder}/{number}")
        aside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{number}-{uuid.uuid4().hex}")  # noqa: SLF001
        out = fs.create(aside, False)
        out.write(text.encode())
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise RuntimeError(f"version {number} in {self.folder} was written by another writer")


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)


def _forget(spark: SparkSession, root: str) -> None:
    try:
        delete_folder(spark, root)
    except Exception:  # noqa: BLE001 - the session has ended; what is left belongs to its folder
        pass


class Scratch:
    """Tables written under the shared folder to cut lineage: a lost executor costs no recomputation, and a
    table that is used more than once is computed once. `drop` frees tables that nothing reads any more; everything
    else is deleted when the program ends, since results may still be read lazily until then."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodestack/{label}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(_forget, spark, self.root)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the written table."""
        target = self.path(name)
        df.write.parquet(target)
        table = self.spark.read.schema(df.schema).parquet(target)
        table._lodestack_path = target  # noqa: SLF001 - lets drop() find the folder
        return table

    def delete(self) -> None:
        """Delete all of it; nothing may read its tables any more."""
        delete_folder(self.spark, self.root)

    def drop(self, *tables: DataFrame) -> None:
        """Delete the folders of tables made by cut()."""
        for table in tables:
            target = getattr(table, "_lodestack_path", None)
            if target:
                delete_folder(self.spark, target)


#: Applications whose Python workers have the package.
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run: once per application, as a zip in the
    shared folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent).as_posix())
    target = f"{shared_dir(spark)}/lodestack/{package.name}-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)  # noqa: SLF001
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)  # noqa: SLF001
    out.write(content.getvalue())
    out.close()
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
