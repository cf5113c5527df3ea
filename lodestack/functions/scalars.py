"""Scalar functions over names, paths, sizes, times and texts, all as built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.times import unix_seconds
from lodestack.plans.query_parser import MACROS

# XML entities in the order they are replaced.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def extension(name: Column, is_directory: Column) -> Column:
    """Lower-case text after the last dot of a file's name; empty for directories and without a dot."""
    return F.when(is_directory, "").when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "\\", -1)


def format_size(size: Column, is_directory: Column) -> Column:
    """<DIR>, `n B`, or one decimal (ties to even) in the largest unit up to TB."""
    value = size.cast("double")
    out = F.format_string("%.1f TB", F.bround(value / 1024.0**4, 1))
    for power in (3, 2, 1):
        out = F.when(value < 1024.0 ** (power + 1), F.format_string(f"%.1f {SIZE_UNITS[power]}", F.bround(value / 1024.0**power, 1))).otherwise(out)
    return F.when(is_directory, "<DIR>").when(value < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def format_time(mtime: Column) -> Column:
    """UTC `yyyy-MM-dd HH:mm:ss` of an mtime in either unit; `-` for 0 and less."""
    seconds = unix_seconds(mtime)
    moment = F.timestamp_add("SECOND", seconds, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.when(seconds <= 0, "-").otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))


def type_label(ext: Column, is_directory: Column) -> Column:
    return F.when(is_directory, "DIR").when(ext == "", "-").otherwise(F.upper(ext))


def icon(ext: Column, is_directory: Column) -> Column:
    """The icon class of a file: the type macro its extension belongs to (the first one), folder or file."""
    out = F.lit("file")
    for macro in reversed(MACROS):
        out = F.when(ext.isin(*MACROS[macro].split()), macro).otherwise(out)
    return F.when(is_directory, "folder").otherwise(out)


def short_name(name: Column, limit: int = 30) -> Column:
    """Names over `limit` characters cut to limit - 3 and three dots."""
    return F.when(F.length(name) > limit, F.concat(F.substring(name, 1, limit - 3), F.lit("..."))).otherwise(name)


def percent_decode(text: Column) -> Column:
    """%HH sequences as bytes of UTF-8, `+` as itself; the text itself where the result isn't valid UTF-8. A % that
    begins no sequence stays."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(kept)
    invalid = decoded.contains("�") & ~text.contains("�") & ~F.upper(text).contains("%EF%BF%BD")
    return F.when(~text.contains("%"), text).when(decoded.isNull() | invalid, text).otherwise(decoded)


def strip_tags(markup: Column) -> Column:
    """Text outside tags, one space for each closing bracket; an unclosed bracket takes the rest."""
    out = F.regexp_replace(markup, r"<[^>]*>", " ")
    return F.replace(F.regexp_replace(out, r"<[^>]*\z", ""), F.lit(">"), F.lit(" "))


def unescape(markup: Column) -> Column:
    for entity, char in ENTITIES:
        markup = F.replace(markup, F.lit(entity), F.lit(char))
    return markup


def node_text(xml: Column, tag: str) -> Column:
    """The unescaped text of all nodes whose tag starts with `tag`, each followed by a space."""
    nodes = F.regexp_extract_all(xml, F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.array_join(F.transform(nodes, lambda n: F.concat(unescape(n), F.lit(" "))), "")


def lines(text: Column) -> Column:
    """Lines without their ends (\\n or \\r\\n); a trailing end makes no further line, empty text has none."""
    return F.when(F.length(text) > 0, F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)).otherwise(
        F.array().cast("array<string>")
    )


def truncate_snippet(line: Column, match_at: Column, match_length: int, width: int = 100) -> Column:
    """Lines up to `width` characters trimmed; longer ones as the window of that width around the match (its
    first character counted from 0), with dots where text is left out."""
    half = max(0, (width - match_length) // 2)
    start = F.greatest(F.lit(0), F.least(match_at - half, F.length(line) - width))
    window = F.concat(
        F.when(start > 0, "...").otherwise(""), F.substring(line, start + 1, F.lit(width)),
        F.when(start + width < F.length(line), "...").otherwise(""),
    )
    return F.when(F.length(line) <= width, F.trim(line)).otherwise(window)


def snippet(text: Column, keyword: str, before: int = 50, after: int = 100, without: int = 150) -> Column:
    """From `before` characters before the first match to `after` behind it; the first `without` if there is none."""
    at = F.instr(F.lower(text), keyword.lower())
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + len(keyword) + after)).otherwise(F.substring(text, 1, without))


def highlight(text: Column, keyword: str) -> Column:
    """array<struct<text, is_match>>: the text in parts, matches of the keyword in any case apart."""
    quoted = "(?i)(" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in keyword) + ")"
    parts = F.split(F.regexp_replace(text, quoted, "\x01$1\x01"), "\x01", -1)
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("is_match")))
    return F.filter(numbered, lambda p: F.length(p["text"]) > 0)


def _folded() -> tuple[str, str]:
    """Letters with diacritics and what is left without them, by Unicode decomposition."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    source, target = _folded()
    return F.translate(F.lower(text), source, target)


def search_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, those of 40 bytes and more dropped."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) > 0) & (F.octet_length(t) < 40))
