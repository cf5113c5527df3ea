import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions.times import unix_seconds
from lodestack.operators import content, fulltext, keyed
from lodestack.operators.change_table import ChangeTable, apply_feed, journal_changes
from lodestack.operators.hierarchy import LOW_48, descendants, resolve_hierarchy
from lodestack.operators.search import Matches, complete_metadata, contains_filter, distinct_in_order, exclude, numbered, page_totals, rebase, search
from lodestack.operators.snapshots import snapshot_changes
from lodestack.plans.query_parser import parse
from lodestack.session import Scratch
from lodestack.sources.files import index_files

RECORD = (
    "read_no bigint, volume string, file_reference_number bigint, parent_file_reference_number bigint, usn bigint, reason bigint, "
    "file_attributes int, file_name string, kind string, segment int"
)


def replay(records):
    state, seen = {}, set()
    for r in sorted((r for r in records if r[4] is not None), key=lambda r: (r[1] or "", r[4])):
        _, volume, frn, parent, usn, reason, attributes, name, *_ = r
        if (volume, usn) in seen or not name or reason is None or frn is None:
            continue
        seen.add((volume, usn))
        key = (volume, frn)
        if reason & 1:
            state.setdefault(key, (parent, name, attributes))
        elif reason & 2:
            state.pop(key, None)
        elif reason & 0x20:
            pass
        elif reason & 0x40:
            if key in state:
                state[key] = (parent, name, attributes)
        elif reason & 4 and key in state:
            state[key] = (*state[key][:2], attributes)
    return {(*k, *v) for k, v in state.items()}


def random_feed(seed, n=400):
    r = random.Random(seed)
    rows = []
    for usn in range(1, n):
        frn = r.choice([1, 1, 1, 2, 3, 4, 5, 6])
        rows.append((0, r.choice(["K", None]), frn, r.randint(1, 9), usn * 100, r.choice([1, 1, 2, 4, 4, 32, 64, 65, 6, 0, 256, None]), r.randint(0, 9), r.choice(["a", "b", "", None, "c"]), "x", 1))
    rows += r.sample(rows, n // 5)  # delivered again
    r.shuffle(rows)
    return [(i, *row[1:]) for i, row in enumerate(rows)]


@pytest.mark.parametrize(("seed", "batches", "segment"), [(1, 1, 1 << 22), (2, 3, 1000), (3, 5, 300)])
def test_changes_in_any_order(spark, seed, batches, segment):
    rows = random_feed(seed)
    feed = spark.createDataFrame(rows, RECORD)
    got = apply_feed(spark, feed, batches, segment).select("volume", "frn", "parent", "name", "attributes").collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(r) for r in got} == replay(rows)


def test_change_table_vectors(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    rows = [(1, "K", 7, 5, 100, 1, 0, "old", "", 0), (2, "K", 8, 5, 110, 1, 0, "other", "", 0), (3, "K", 7, 9, 5_000_000_000, 64, 1, "new", "", 0)]
    for row in rows:
        table = ChangeTable(spark, folder)  # opened again each time
        table.apply(journal_changes(spark.createDataFrame([row], RECORD)), notes={"last": row[0]})
    assert ChangeTable(spark, folder).notes == {"last": 3}
    assert table._positions().count() == 3 and table.live_images().count() == 2  # the renamed file's first image is superseded
    files = {(7, "new", 9), (8, "other", 5)}
    assert {(r["frn"], r["name"], r["parent"]) for r in table.current().collect()} == files
    table.compact()
    assert table._positions().count() == 2 and {(r["frn"], r["name"], r["parent"]) for r in ChangeTable(spark, folder).current().collect()} == files
    behind = ChangeTable(spark, folder)
    table.apply(journal_changes(spark.createDataFrame(rows[:1], RECORD)))
    with pytest.raises(RuntimeError):  # another writer was first
        behind.apply(journal_changes(spark.createDataFrame(rows[:1], RECORD)))
    assert {(r["frn"], r["name"], r["parent"]) for r in ChangeTable(spark, folder).current().collect()} == files


def test_change_table_compacts(spark, tmp_path):
    rows = random_feed(7, 120)
    table = ChangeTable(spark, f"file://{tmp_path}/table", buckets=3, compact_every=3)
    for k in range(5):
        table.apply(journal_changes(spark.createDataFrame(rows[k::5], RECORD)))
    assert len(table.state["images"]) < 3 and {tuple(r) for r in table.current().select("volume", "frn", "parent", "name", "attributes").collect()} == replay(rows)


def test_changes_empty(spark):
    assert apply_feed(spark, spark.createDataFrame([], RECORD)).count() == 0


LINK = "volume string, id bigint, parent bigint, seq bigint, name string, status string, path string"


def link(volume, frn, parent, seq=0, name=None):
    return (volume, frn, parent, seq, name or f"n{frn}", "clash", "clash")


def walk(rows):
    best = {}
    for v, i, p, s, n, *_ in rows:
        if i is not None and i & LOW_48 != 5 and ((v, i) not in best or best[v, i][:2] < (s, p)):
            best[v, i] = (s, p, n)
    out = {}
    for key in best:
        way, at, status = [], key, None
        while status is None:
            if at in way:
                circle = [k[1] for k in way[way.index(at):]]
                status = ("loop", min(circle), way.index(at))
                break
            way.append(at)
            parent = best[at][1]
            if parent is not None and parent & LOW_48 in (0, 5, LOW_48):
                status = ("ok", at[1], len(way) - 1)
            elif (at[0], parent) not in best:
                status = ("orphan", at[1], len(way) - 1)
            else:
                at = (at[0], parent)
        path = "\\".join(best[k][2] for k in reversed(way)) if status[0] != "loop" else None
        out[key] = (*status, path)
    return out


ORDER = [c.split()[0] for c in LINK.split(", ")]


@pytest.mark.parametrize("levels", [0, 2, 6])
def test_hierarchy(spark, levels):
    rows = [link("C", 5, 5), link("C", 10, 5), link("C", 20, 10), link("Z", 10, 5, name="Photos"), link("Z", 20, 10), link("C", 30, 999), link("C", 31, 30)]
    rows += [link("C", 40, 40), link("C", 41, 40), link("C", 51, 52), link("C", 52, 53), link("C", 53, 51), link("C", 54, 53), link("C", 55, 54), link("C", 56, 55), link("C", 60, None)]
    rows += [link("C", 1000 + i, 1000 + i - 1 if i else 10) for i in range(300)]
    rows += [link("C", 2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [link("C", 3000 + i, 3000 + i - 1 if i else 2007) for i in range(40)]
    rows += [link("C", 20, 30, seq=-1), link(None, 70, (7 << 48) | 5), link(None, 71, 70), link("C", None, 10), link("C", (9 << 48) | 77, 10), link("C", 78, 77)]
    df = spark.createDataFrame(rows, LINK)
    want = walk(rows)
    got = resolve_hierarchy(df, ["volume"], "seq", name="name", frontier_levels=levels, ancestors=True)
    result = {(r["volume"], r["id"]): (r["status"], r["top"], r["depth"], r["full_path"]) for r in got.collect()}
    assert result == want and got.count() == len(want)
    bad = resolve_hierarchy(df, ["volume"], "seq", frontier_levels=levels, only_unrooted=True)
    assert {(r["volume"], r["id"]): (r["status"], r["top"], r["depth"]) for r in bad.collect()} == {k: v[:3] for k, v in want.items() if v[0] != "ok"}
    pairs = {(r["ancestor"], r["id"], r["distance"]) for r in descendants(got, ["volume"]).where("volume = 'C'").collect()}
    assert (10, 20, 1) in pairs and (10, 1299, 300) in pairs and (1000, 1299, 299) in pairs and (30, 31, 1) in pairs
    parents = {}
    for volume, i, parent, *_ in sorted((r for r in rows if r[0] == "C" and r[1] is not None), key=lambda r: dict(zip(ORDER, r))["seq"]):
        parents[i] = parent
    known = {i for v, i in want if v == "C"}
    every = set()
    for i in known:
        at, way = i, [i]
        while parents[at] in known and parents[at] not in way and not (parents[at] & LOW_48) in (0, 5, LOW_48):
            at = parents[at]
            way.append(at)
            every.add((at, i, len(way) - 1))
    assert pairs == every


def test_hierarchy_empty(spark):
    assert resolve_hierarchy(spark.createDataFrame([], LINK), ["volume"], "seq", name="name").count() == 0


def test_snapshots(spark):
    ticks = 1700000000 * 10**7 + 116444736000000000
    rows = [
        (1, "same", 1, 5, 1700000000, "x"), (2, "same", 2, 5, ticks + 5, "x"), (1, "gone", 3, 5, 1, "x"), (2, "fresh", 4, 5, 1, "x"),
        (1, "size", 5, None, 1, "x"), (2, "size", 6, 0, 1, "x"), (1, "twice", 7, 1, 1, "x"), (1, "twice", 8, 2, 1, "x"), (2, "twice", 9, 2, 1, "x"),
        (1, "nulls", 10, None, None, "x"), (2, "nulls", 11, None, None, "x"), (3, "same", 12, 6, 1700000000, "x"), (2, None, 13, 1, 1, "x"), (None, "same", 14, 1, 1, "x"),
        (1, "", 15, 1, 1, "x"), (2, "", 16, 1, 1, "x"), (3, "", 17, 1, 1, "x"),
    ]
    df = spark.createDataFrame(rows, "snapshot_ts bigint, k string, seq bigint, size bigint, mtime bigint, change_kind string")
    got = snapshot_changes(df, "snapshot_ts", "k", "seq", {"size": F.col("size"), "mtime": unix_seconds(F.col("mtime"))})
    assert {tuple(r) for r in got.collect()} == {
        (2, "gone", "removed"), (2, "fresh", "added"), (2, "size", "changed"), (3, "same", "changed"), (3, "fresh", "removed"), (3, "size", "removed"),
        (3, "twice", "removed"), (3, "nulls", "removed"),
    }
    assert snapshot_changes(df.where("snapshot_ts = 1"), "snapshot_ts", "k", "seq", {"size": F.col("size")}).count() == 0
    assert snapshot_changes(df.limit(0), "snapshot_ts", "k", "seq", {"size": F.col("size")}).count() == 0


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        (1, "explorer.exe", "C:\\Windows\\explorer.exe", 1, 0, False, 0, 5000000, 1700000000, "C"),
        (2, "分享项目方案.docx", "C:\\Projects\\proj\\分享项目方案.docx", 2, 10, False, 0, 1048576, 1710000000, "C"),
        (3, "微信.exe", "C:\\Program Files\\Tencent\\WeChat\\微信.exe", 3, 11, False, 0, 20480000, 1715000000, "C"),
        (4, "proj", "C:\\Projects\\proj", 10, 0, True, 16, 0, 1710000000, "C"),
    ]
    schema = "seq bigint, name string, full_path string, frn bigint, parent_frn bigint, is_directory boolean, file_attributes int, size bigint, mtime bigint, volume string"
    return index_files(spark.createDataFrame(rows, schema)).cache()


@pytest.mark.parametrize(("query", "seqs"), [
    ("explorer", [1]), ("fx", [2]), ("wx", [3]), ("ext:docx", [2]), ("type:folder", [4]), ("", [1, 2, 3, 4]), ("*.exe", [1, 3]), ("size:>5mb", [3]),
    (r"projects\proj", [2, 4]), (r"\proj*.docx", [2]), ("regex:^[a-z]+\\.exe$", [1]), ("dm:>2024-03-01 -path:tencent", [2, 4]), ("file: exe", [1, 3]), ("nothing", []),
])
def test_search(files, query, seqs):
    found = search(files, parse(query))
    assert [r["seq"] for r in found.page().collect()] == seqs
    summary = found.summary().first()
    assert (summary["total_matches"], summary["total_files"]) == (len(seqs), 4)


def test_pages_and_exclusions(spark, files):
    found = Matches(files, files)
    assert [r["seq"] for r in found.page(1, 2).collect()] == [2, 3] and found.page(9, 2).count() == 0
    rules = spark.createDataFrame([("C:\\Windows", False), (None, None), ("", False), (r"\.docx$", True)], "pattern string, is_regex boolean")
    assert {r["seq"] for r in exclude(files, rules).collect()} == {3, 4}
    many = spark.createDataFrame([(f"c:\\none{i}", False) for i in range(250)] + [("c:\\program", False)], "pattern string, is_regex boolean")
    assert {r["seq"] for r in exclude(files, many).collect()} == {1, 2, 4}
    live = spark.createDataFrame([("C:\\Projects\\proj\\分享项目方案.docx", 7, 8)], "full_path string, size bigint, mtime bigint")
    stale = files.withColumn("size", F.lit(0).cast("bigint")).select("seq", "name", "full_path", "size", "mtime", "is_directory", "ext")
    assert {r["seq"]: r["size"] for r in complete_metadata(stale, live).collect()} == {1: 0, 2: 7, 3: 0, 4: 0}


def test_numbers_and_moves(spark, files):
    rows = spark.range(5000).withColumn("k", (F.col("id") * 7919) % 997).repartition(7)
    got = [(r["number"], r["k"], r["id"]) for r in numbered(rows, [F.col("k"), F.col("id")]).orderBy("number").collect()]
    assert [g[0] for g in got] == list(range(1, 5001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert numbered(rows.limit(0), [F.col("k")]).count() == 0
    assert {r["full_path"] for r in rebase(files, "C:\\Projects\\proj", "D:\\x").collect()} >= {"D:\\x", "D:\\x\\分享项目方案.docx", "C:\\Windows\\explorer.exe"}
    assert [r["seq"] for r in contains_filter(files, "TENCENT").collect()] == [3] and contains_filter(files, "").count() == 4


def test_totals_and_order(spark, files):
    assert tuple(page_totals(files).first()) == (4, 5000000 + 1048576 + 20480000) and tuple(page_totals(files.limit(0)).first()) == (0, 0)
    rows = spark.createDataFrame([("b", 3), ("a", 2), ("b", 1), (None, 4), (None, 5)], "k string, n int")
    assert [tuple(r) for r in distinct_in_order(rows, "k", "n").collect()] == [("b", 1), ("a", 2), (None, 4)]


def test_inverted_index(spark, tmp_path):
    def tokens(*rows):
        return spark.createDataFrame([(k, t.split(" ") if t else None, "clash") for k, t in rows], "key string, text array<string>, batch string")

    folder = f"file://{tmp_path}/index"
    index = fulltext.InvertedIndex(spark, folder, ("text",), buckets=3, compact_every=100)
    assert index.bm25("a", ("text",)).count() == 0 and index.phrase("text", ["a"]).count() == 0
    index.upsert(tokens(("1", "a b a b c"), ("2", "b a"), ("3", None), (None, "a"), ("4", "x a b")))
    index.upsert(tokens(("4", "a c"), ("5", "a b a")))
    index.delete(tokens(("2", None), ("none", None)))
    for _ in range(2):
        index = fulltext.InvertedIndex(spark, folder, ("text",))  # opened again
        keys = lambda *phrase: {r[0] for r in index.phrase("text", list(phrase)).collect()}
        assert keys("a", "b") == {"1", "5"} and keys("a", "b", "a") == {"1", "5"} and keys("b", "c") == {"1"} and keys("b", "b") == set() and keys() == set()
        assert index.state["documents"] == 4 and index.state["tokens"] == [10]
        docs = spark.createDataFrame([("1", "a b a b c"), ("3", ""), ("4", "a c"), ("5", "a b a")], "key string, text string")
        want = [(r["key"], round(r["score"], 9)) for r in fulltext.bm25(docs, "c A", {"text": F.col("text")}, "key").collect()]
        assert [(r["key"], round(r["score"], 9)) for r in index.bm25("c A", ("text",)).collect()] == want and len(want) == 3
        index.compact()
        assert not index.state["dead"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("C:\\a.txt", "first\r\n  Second KEY line\nkey again\n" + "\n".join("pqrstuvw")), ("C:\\b.txt", "nothing"), ("C:\\c.txt", ""), ("C:\\d.txt", None),
        ("C:\\e.txt", "Café-bar opens; cafe bar closes"), ("C:\\key.txt", "ÄÖkey"),
    ]
    return spark.createDataFrame(rows, "path string, content string")


def test_content(spark, docs, files):
    got = {r["file_path"]: tuple(r)[1:] for r in content.first_matches(docs, "Key").collect()}
    assert got == {"C:\\a.txt": ("a.txt", 2, "Second KEY line", 9, 12), "C:\\key.txt": ("key.txt", 1, "ÄÖkey", 4, 7)}
    lines = [(r["line_number"], r["is_match"]) for r in content.preview(docs, "key", 1).where("path = 'C:\\\\a.txt'").collect()]
    assert lines == [(1, False), (2, True), (3, True), (4, False)]
    assert content.search_content(files, docs, "方案").collect()[0]["line_number"] == 0
    assert content.search_content(files, docs.limit(0), "zzz").count() == 0


def test_fulltext(docs):
    assert [r[0] for r in fulltext.phrase_matches(docs, "cafe bar").collect()] == ["C:\\e.txt"]
    assert fulltext.phrase_matches(docs, "afe bar").count() == 0
    fields = {"content": F.col("content")}
    ranked = fulltext.bm25(docs, "key again", fields, "path").collect()
    assert [r["path"] for r in ranked] == ["C:\\a.txt"] and ranked[0]["score"] > 0
    assert fulltext.bm25(docs, "...", fields, "path").count() == 0 and fulltext.bm25(docs.limit(0), "key", fields, "path").count() == 0


def test_keyed(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id bigint, k string, at bigint")
    changes = spark.createDataFrame([(3, "b", 2), (4, "b", 3), (5, "c", 1), (6, "c", 1)], "id bigint, k string, at bigint")
    assert {tuple(r) for r in keyed.upsert(current, changes, ["k"], "at").collect()} == {(1, "a", 1), (4, "b", 3), (6, "c", 1)}
    assert keyed.upsert(current.limit(0), changes.limit(0), ["k"], "at").count() == 0
    assert [r["id"] for r in keyed.newest(current, ["at", "id"], 1).collect()] == [2]
