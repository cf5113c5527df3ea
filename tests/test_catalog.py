import json

import pytest

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.catalog import Catalog
from lodestack.operators.change_table import apply_feed
from lodestack.sources import files as sources
from lodestack.sources.tables import table
from lodestack.session import Versions
from lodestack.streaming.journal import JournalMonitor, gaps, read_journal
from tests.conftest import DATA


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/cat")
    entries = spark.createDataFrame(
        [(10, 5, "Users", 0, 1, 16, True, "C"), (20, 10, "note.txt", 100, 1, 32, False, "C"), (10, 5, "Photos", 0, 1, 16, True, "Z"), (20, 10, "p.jpg", 200, 1, 32, False, "Z")],
        schemas.RAW_NODE,
    )
    catalog.ingest(entries)
    paths = {r["full_path"] for r in catalog.read("file_index").collect()}
    assert paths == {"C:\\Users", "C:\\Users\\note.txt", "Z:\\Photos", "Z:\\Photos\\p.jpg"}
    page, summary = catalog.search_page("note", now=50)
    assert [r["name"] for r in page.collect()] == ["note.txt"] and summary.first()["total_bytes"] == 100
    assert [r["query"] for r in catalog.recent_searches().collect()] == ["note"]
    catalog.save_search("second", 5, 50)
    assert [r["query"] for r in catalog.recent_searches().collect()] == ["second", "note"]
    catalog.clear_history()
    assert catalog.recent_searches().count() == 0
    catalog.set_setting("theme", "dark")
    catalog.set_setting("theme", "light")
    assert catalog.get_setting("theme") == "light" and catalog.get_setting("none") is None
    catalog.add_favorite("C:\\Users\\note.txt", 1)
    catalog.add_favorite("C:\\Users\\note.txt", 2)
    assert [r["file_name"] for r in catalog.favorites().collect()] == ["note.txt"]
    catalog.remove_favorite("C:\\Users\\note.txt")
    assert catalog.favorites().count() == 0
    catalog.add_exclusion("c:\\users", False, 1)
    assert catalog.search("").matched.count() == 2
    catalog.remove_exclusion(1)
    assert catalog.exclusions().count() == 0
    docs = spark.createDataFrame([("C:\\Users\\note.txt", 1, 5, "txt", b"the key line"), ("C:\\Windows\\x.txt", 1, 5, "txt", b"key")], "path string, mtime bigint, size bigint, ext string, content binary")
    catalog.index_documents(docs)
    assert [r["file_path"] for r in catalog.search_content("content:key").collect()] == ["C:\\Users\\note.txt"]
    assert catalog.search_content("nothing").count() == 0
    assert catalog.preview("C:\\Users\\note.txt", "key").count() == 1
    assert catalog.index_stats().first()["total_indexed"] == 1
    catalog.index_knowledge(spark.createDataFrame([("k/a.md", "spark engine"), ("k/b.md", "other")], "path string, content string"))
    catalog.index_knowledge(spark.createDataFrame([("k/a.md", "spark spark engine")], "path string, content string"))
    assert [r["file_name"] for r in catalog.search_knowledge("spark").collect()] == ["a.md"]
    catalog.add_folder("k", 1)
    catalog.remove_folder("k")
    assert catalog.folders().count() == 0 and catalog.read("knowledge").count() == 0
    assert [len(b) for b in Catalog.batches(spark.range(120))] == [50, 50, 20]
    version = sources.save_snapshot(catalog.read("file_index"), f"file://{tmp_path}/snap", 1, 99)
    assert version.endswith("version=1") and sources.load_snapshot(spark, f"file://{tmp_path}/snap", 1).count() == 4


def test_folder_sources(spark, tmp_path):
    for name, text in (("a/x.md", "hello"), ("a/.git/y.md", "no"), ("node_modules/z.js", "no"), ("b.txt", "  "), ("c.exe", "no"), ("d.txt", "words")):
        file = tmp_path / "walk" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    (tmp_path / "walk" / "bad.txt").write_bytes(b"\xff\xfe\xff")
    root = f"file:{tmp_path}/walk"
    assert sources.walk(spark, root).count() == 6  # hidden folders aren't listed
    assert sources.list_folder(spark, root).count() == 4
    assert {r["path"].rsplit("/", 1)[1] for r in sources.knowledge_files(spark, root).collect()} == {"x.md", "d.txt"}
    folders = {r["path"] for r in sources.folders_of(sources.walk(spark, root)).collect()}
    assert any(p.endswith("/walk/a") for p in folders)
    sources.write_folder_list(spark.createDataFrame([(0, "x"), (1, "y")], "position int, folder string"), f"file://{tmp_path}/list")
    assert [r["folder"] for r in sources.read_folder_list(spark, f"file://{tmp_path}/list").orderBy("position").collect()] == ["x", "y"]
    entries = spark.createDataFrame([(1, 5, "$Recycle.Bin", 0, 0, 16, True), (2, 5, "$Recycle.Bin", 0, 0, 32, False)], schemas.FILE_ENTRY)
    entries.write.parquet(f"file://{tmp_path}/entries")
    assert [r["frn"] for r in sources.read_entries(spark, f"file://{tmp_path}/entries", "C").collect()] == [2]


def test_stream_equals_batch(spark, tmp_path):
    records = table(spark, DATA, "usn_record_v2")
    records.repartition(3).write.parquet(f"file://{tmp_path}/journal")
    monitor = JournalMonitor(spark)
    monitor.start(read_journal(spark, f"file://{tmp_path}/journal", 1), f"file://{tmp_path}/cp").awaitTermination()
    assert monitor.status() and set(monitor.status().values()) == {"inactive"}
    streamed = monitor.table.current()
    batch = apply_feed(spark, records)
    assert streamed.count() > 0 and streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    monitor.stop()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    records = table(spark, DATA, "usn_record_v2")
    journal, checkpoint = f"file://{tmp_path}/journal", f"file://{tmp_path}/cp"
    middle = records.agg(F.expr("percentile(read_no, 0.5)")).first()[0]
    records.where(F.col("read_no") <= middle).coalesce(1).write.parquet(journal)
    first = JournalMonitor(spark)
    first.start(read_journal(spark, journal, 1), checkpoint).awaitTermination()
    records.where(F.col("read_no") > middle).coalesce(1).write.mode("append").parquet(journal)
    second = JournalMonitor(spark)  # knows nothing but the checkpoint
    second.start(read_journal(spark, journal, 1), checkpoint).awaitTermination()
    assert second.last_batch == first.last_batch + 1 and second.batch_size > 0 and set(second.next_usn) >= set(first.next_usn)
    got, want = second.table.current(), apply_feed(spark, records)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_restarts_after_failures(spark, tmp_path):
    table(spark, DATA, "usn_record_v2").limit(50).coalesce(1).write.parquet(f"file://{tmp_path}/journal")
    calls = []

    def sink(files):
        calls.append(1)
        if len(calls) < 2:
            raise ValueError("the sink is away")

    monitor = JournalMonitor(spark, sink=sink)
    monitor.keep_running(read_journal(spark, f"file://{tmp_path}/journal"), f"file://{tmp_path}/cp", wait=0.01, continuous=False)
    monitor.stop()
    assert monitor.last_batch == 0 and len(calls) == 2
    broken = JournalMonitor(spark, sink=lambda files: 1 / 0)
    broken.apply = lambda records, batch: 1 / 0
    with pytest.raises(StreamingQueryException):
        broken.keep_running(read_journal(spark, f"file://{tmp_path}/journal"), f"file://{tmp_path}/cp2", attempts=2, wait=0.01, continuous=False)


def test_tree_and_volumes(spark, tmp_path):
    for path, text in (("a/b/c.txt", "123"), ("a/.hidden", "1"), ("_under/x", ""), ("top.txt", "12")):
        (tmp_path / "disk" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "disk" / path).write_text(text)
    tree = sources.enumerate_tree(spark, str(tmp_path / "disk"), "X")
    rows = {r["name"]: r for r in tree.collect()}
    assert set(rows) == {"a", "b", "c.txt", ".hidden", "_under", "x", "top.txt"} and rows["top.txt"]["parent_frn"] == 5
    assert rows["c.txt"]["parent_frn"] == rows["b"]["frn"] and rows["b"]["parent_frn"] == rows["a"]["frn"] and rows["a"]["is_directory"] and rows["c.txt"]["size"] == 3
    assert rows[".hidden"]["file_attributes"] == 34 and rows["a"]["file_attributes"] == 16
    catalog = Catalog(spark, f"file://{tmp_path}/cat")
    catalog.ingest(tree)
    assert "X:\\a\\b\\c.txt" in {r["full_path"] for r in catalog.read("file_index").collect()}
    assert [r["name"] for r in sources.list_live(spark, str(tmp_path / "disk")).collect()] == ["_under", "a", "top.txt"]
    gone = lambda: sources.read_entries(spark, f"file://{tmp_path}/none", "Y")
    found, report = sources.read_volumes(spark, {"X": [gone, lambda: tree], "Y": [gone, lambda: sources.enumerate_tree(spark, str(tmp_path / "none"), "Y")], "Z": [lambda: tree]})
    assert found.count() == 14 and [(v, k) for v, k, _ in report] == [("X", 1), ("Y", -1), ("Z", 0)] and report[1][2]


def test_versions_are_whole(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/v")
    assert versions.newest() == (0, None)
    versions.publish(1, "a")
    versions.publish(2, "b")
    with pytest.raises(RuntimeError):
        versions.publish(2, "c")
    (tmp_path / "v" / ".3-left").write_text("half")  # a writer that died
    assert versions.newest() == (2, "b")


def test_gaps(spark):
    committed = spark.createDataFrame([("C", 100), ("D", 100)], "volume string, next_usn bigint")
    records = spark.createDataFrame([("C", 150), ("C", 5_000_000), ("D", 2_000_000), ("E", 9_000_000)], "volume string, usn bigint")
    assert {tuple(r) for r in gaps(records, committed).collect()} == {("D", 100, 2_000_000)}


def test_rescan_on_gap(spark):
    lost = []
    sizes = []
    monitor = JournalMonitor(spark, lambda volumes: lost.extend(r[0] for r in volumes.collect()), lambda files: sizes.append(files.count()), debounce=1000)
    monitor.written = __import__("time").monotonic()
    row = (1, None, "C", 80, 2, 0, 7, 5, 100, 0, 1, 0, 0, 0, 1, "a")
    first = spark.createDataFrame([row], schemas.USN_RECORD)
    monitor.apply(first, 0)
    monitor.apply(first, 0)  # delivered again
    monitor.apply(first.withColumn("usn", F.lit(3_000_000).cast("bigint")), 1)
    assert sizes == []
    monitor.stop()
    monitor.stop()
    assert sizes == [1]
    assert lost == ["C"] and monitor.next_usn == {"C": 3_000_080} and len(monitor.table.state["images"]) == 2


def test_command_line(spark, tmp_path, capsys):
    from lodestack.__main__ import answer, main, show

    main([str(tmp_path), "version"])
    catalog = Catalog(spark, f"file://{tmp_path}/cat")
    catalog.ingest(spark.createDataFrame([(20, 5, "note.txt", 100, 1, 32, False, "C")], schemas.RAW_NODE))
    rows, summary = answer(catalog, "note", 10, 0)
    assert summary.first()["total_matches"] == 1
    capsys.readouterr()
    show(rows, True, False)
    assert capsys.readouterr().out == "C:\\note.txt\n"
    show(rows, False, True)
    assert json.loads(capsys.readouterr().out)["name"] == "note.txt"
