import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.functions.globs import glob_regex
from lodestack.plans.query_parser import Bounds, MACROS, parse, parse_date, parse_day, parse_size, tokenize

NOW = 1_720_000_000


def test_tokens():
    assert tokenize('a "b c" d') == ["a", "b c", "d"]
    assert tokenize('a "b c') == ["a", "b c"]
    assert tokenize("  \t ") == []


@pytest.mark.parametrize(("text", "bounds"), [
    (">10kb", Bounds(low=10240)), ("<1.5m", Bounds(high=1572864)), ("1kb-2kb", Bounds(1024, 2048)), ("7", Bounds(low=7)),
    (">=10mb", None), ("x", None), ("", None), ("5pb", None),
])
def test_sizes(text, bounds):
    assert parse_size(text) == bounds


def test_dates():
    assert parse_date("today", NOW) == Bounds(low=NOW - 86400)
    assert parse_date("yesterday", NOW) == Bounds(NOW - 2 * 86400, NOW - 86400)
    assert parse_date("<2024-01-01", NOW) == Bounds(high=1704067200)
    assert parse_date("2024-01-01", NOW) == Bounds(low=1704067200)
    assert parse_day("2024-01-01", approximate=True) == 19755 * 86400
    assert parse_day("1970-01-01", approximate=True) == 31 * 86400
    assert parse_date(">=2024-01-01", NOW) is None


def test_clauses():
    q = parse("Report ext:.PDF|docx;md type:folder -path:Tmp !path:x path:docs content:\"two words\" c:three regex:^a.*b$ /x+/ size:>1kb", NOW)
    assert q.text_terms == ("report",)
    assert q.ext_filters == ("pdf", "docx", "md")
    assert q.folders_only is True
    assert q.path_excludes == ("tmp", "x") and q.path_includes == ("docs",)
    assert q.content_terms == ("two words", "three") and q.content_phrase == "two words three"
    assert q.regex_patterns == ("^a.*b$", "x+")
    assert q.size_filters == (Bounds(low=1024),)
    assert q.has_content_search and not q.is_empty


def test_macros_and_category():
    assert set(parse("type:ai").ext_filters) == set(MACROS["ai"].split()) and len(MACROS["ai"].split()) == 21
    assert [len(MACROS[m].split()) for m in ("doc", "image", "video", "audio", "code", "app", "archive")] == [16, 12, 10, 9, 27, 8, 9]
    assert parse("pic:").ext_filters == tuple(MACROS["image"].split())
    assert parse("x", category="doc").ext_filters == tuple(MACROS["doc"].split())


def test_defects_and_warnings():
    assert parse("-path:").path_excludes == ()
    assert parse(r"c:\temp").content_terms == () and parse(r"c:\temp").text_terms == (r"c:\temp",)
    bad = parse("size:>=1mb dm:never regex:(?=x)")
    assert bad.is_empty and len(bad.warnings) == 3
    assert parse("ＥＸＴ：").text_terms  # full-width letters aren't prefixes
    assert parse("ext：pdf").ext_filters == ("pdf",)


def reference_glob(pattern: str, text: str) -> bool:
    if not pattern:
        return not text
    if pattern[0] == "*":
        return reference_glob(pattern[1:], text) or (bool(text) and reference_glob(pattern, text[1:]))
    return bool(text) and pattern[0] in ("?", text[0]) and reference_glob(pattern[1:], text[1:])


@pytest.mark.parametrize(("pattern", "text", "hit"), [("*.rs", "main_test.rs", True), ("main*test.?s", "main_test.rs", True), ("*.rs", "main_test.txt", False)])
def test_glob_cases(pattern, text, hit):
    assert bool(re.match(glob_regex(pattern), text)) == hit


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?.", max_size=6), st.text("ab.\n", max_size=8))
def test_glob_property(pattern, text):
    assert bool(re.fullmatch(glob_regex(pattern)[1:-1], text)) == reference_glob(pattern, text)
