import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestack.functions import extract, paths, scalars
from lodestack.functions.globs import glob_match
from lodestack.functions.pinyin import pinyin
from lodestack.functions.times import unix_seconds


def value(spark, text, fn, kind="string"):
    return spark.createDataFrame([(text,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(("text", "out"), [
    ("%E6%98%9F%E6%B2%B3.pdf", "星河.pdf"), ("a+b%20c", "a+b c"), ("100%", "100%"), ("%FF", "%FF"), ("plain", "plain"), (None, None), ("%EF%BF%BD", "�"), ("5%zz%41", "5%zzA"),
])
def test_percent_decode(spark, text, out):
    assert value(spark, text, scalars.percent_decode) == out


@pytest.mark.parametrize(("text", "out"), [("a<b>c</b>d", "a c d"), ("x > y", "x   y"), ("a<unclosed", "a"), ("", ""), (None, None)])
def test_strip_tags(spark, text, out):
    assert value(spark, text, scalars.strip_tags) == out
    if text is not None:
        assert extract.strip_tags(text) == out


def test_node_text(spark):
    xml = '<w:t>one</w:t><w:t xml:space="preserve"> &amp;lt; two</w:t>'
    assert value(spark, xml, lambda c: scalars.node_text(c, "w:t")) == "one  < two "
    assert extract.node_text(xml, "w:t") == "one  < two "


@pytest.mark.parametrize(("text", "out"), [("a\r\nb\n", ["a", "b"]), ("", []), (None, []), ("a\n\nb", ["a", "", "b"]), ("\n", [""])])
def test_lines(spark, text, out):
    assert value(spark, text, scalars.lines) == out


def test_sizes_and_times(spark):
    rows = spark.createDataFrame([(0, False), (1023, False), (1536, False), (5 << 40, False), (2000 << 40, False), (9, True)], "size bigint, d boolean")
    assert [r[0] for r in rows.select(scalars.format_size(F.col("size"), F.col("d"))).collect()] == ["0 B", "1023 B", "1.5 KB", "5.0 TB", "2000.0 TB", "<DIR>"]
    assert value(spark, 0, scalars.format_time, "bigint") == "-"
    assert value(spark, 1710000000, scalars.format_time, "bigint") == "2024-03-09 16:00:00"
    assert value(spark, 1710000000 * 10**7 + 116444736000000000 + 9999999, unix_seconds, "bigint") == 1710000000
    assert value(spark, None, unix_seconds, "bigint") is None


def test_extension(spark):
    rows = spark.createDataFrame([(".gitignore", False), ("Makefile", False), ("a.TXT", False), ("d.x", True), ("end.", False)], "n string, d boolean")
    assert [r[0] for r in rows.select(scalars.extension(F.col("n"), F.col("d"))).collect()] == ["gitignore", "", "txt", "", ""]


def test_snippets(spark):
    line = "x" * 120 + "match" + "y" * 120
    out = value(spark, line, lambda c: scalars.truncate_snippet(c, F.instr(c, "match") - 1, 5))
    assert out.startswith("...") and out.endswith("...") and "match" in out and len(out) == 106
    assert value(spark, "  short ", lambda c: scalars.truncate_snippet(c, F.lit(0), 5)) == "short"
    assert value(spark, "a" * 300, lambda c: scalars.snippet(c, "zz")) == "a" * 150
    assert value(spark, "a" * 60 + "KEY" + "b" * 200, lambda c: scalars.snippet(c, "key")) == "a" * 50 + "KEY" + "b" * 100


def test_highlight(spark):
    parts = value(spark, "Plan a plan.", lambda c: scalars.highlight(c, "plan"))
    assert [(p["text"], p["is_match"]) for p in parts] == [("Plan", True), (" a ", False), ("plan", True), (".", False)]
    assert [p["text"] for p in value(spark, "a.b", lambda c: scalars.highlight(c, "."))] == ["a", ".", "b"]


def test_pinyin(spark):
    rows = spark.createDataFrame([("分享.txt",), ("Readme.md",), (None,), ("微信",)], "n string")
    first, full = pinyin(spark, F.col("n"))
    assert [tuple(r) for r in rows.select(first, full).collect()] == [("fx.txt", "fenxiang.txt"), (None, None), (None, None), ("wx", "weixin")]


def test_bytewise_globs(spark):
    assert value(spark, "分.rs", lambda c: glob_match(c, "?.rs"))
    assert not value(spark, "分.rs", lambda c: glob_match(c, "?.rs", bytewise=True))
    assert value(spark, "分.rs", lambda c: glob_match(c, "???.rs", bytewise=True))


def test_path_predicates(spark):
    def noisy(path):
        return value(spark, path, paths.is_noisy)

    assert noisy(r"c:\u\appdata\roaming\psreadline\consolehost_history.txt") and noisy(r"c:\u\.system_generated\a.log")
    assert not noisy(r"d:\work\report.docx")
    assert value(spark, r"d:\p\node_modules\x.js", paths.is_skipped_by_indexer)
    for ext, supported in (("txt", True), ("PDF", True), ("exe", False), ("zip", False), ("", False)):
        assert value(spark, ext, paths.is_supported) == supported


def packed(**files: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in files.items():
            archive.writestr(name.replace("__", "/").replace("_X", "."), text)
    return out.getvalue()


def test_extraction(spark):
    docx = packed(**{"word__document_Xxml": "<w:t>Body</w:t>", "word__header1_Xxml": "<w:t>Head</w:t>"})
    xlsx = packed(**{"xl__sharedStrings_Xxml": "<t>Shared</t>", "xl__worksheets__sheet1_Xxml": "<v>42</v>"})
    odt = packed(**{"content_Xxml": "<p>Open text</p>"})
    rows = [
        ("a.txt", 1, 5, "txt", b"plain \xff"), ("b.docx", 1, len(docx), "docx", docx), ("c.xlsx", 1, 9, "XLSX", xlsx), ("d.odt", 1, 9, "ods", odt),
        ("e.docx", 1, 9, "docx", b"not a zip"), ("f.exe", 1, 9, "exe", b"x"), ("g.txt", 1, 0, "txt", b""), ("h.txt", 1, 3, "txt", b"   "),
        ("i.pdf", 1, 3, "pdf", b"raw"), ("j.txt", 1, None, "txt", None),
    ]
    files = spark.createDataFrame(rows, "path string, mtime bigint, size bigint, ext string, content binary")
    got = {r["path"]: (r["doc_type"], r["content"]) for r in extract.extract(files).collect()}
    assert got == {"a.txt": ("text", "plain �"), "b.docx": ("docx", "Body Head "), "c.xlsx": ("xlsx", "Shared 42 "), "d.odt": ("odt", " Open text ")}
    with_pdf = extract.extract(files, pdf_reader=lambda content: content.decode())
    assert ("i.pdf", "raw") in {(r["path"], r["content"]) for r in with_pdf.collect()}


def test_times(spark):
    seconds = 1_700_000_000
    values = [seconds, seconds * 1000 + 999, seconds * 10**7 + 116_444_736_000_000_000 + 9_999_999, 0, None, -5]
    got = spark.createDataFrame([(v,) for v in values], "t bigint").select(unix_seconds(F.col("t"))).collect()
    assert [r[0] for r in got] == [seconds, seconds, seconds, 0, None, -5]


def test_noisy_folders(spark):
    given = ["c:\\u\\.gemini\\x.txt", "c:\\antigravity-cli\\x", "c:\\.vscode\\x", "c:\\vscode\\x", "c:\\u\\.bash_history", "c:\\appdata\\local\\temp\\x", "c:\\note.txt"]
    got = spark.createDataFrame([(p,) for p in given], "p string").select(paths.is_noisy(F.col("p"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, True, True, False]
