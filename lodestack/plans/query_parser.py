"""The search mini-language: a query string to an immutable ParsedQuery.

Clauses are separated by white space outside double quotes; quote characters disappear, an unclosed quote takes the
rest of the line. All clauses must hold; extensions and type macros are alternatives among themselves. Clauses whose
literal can't be read are dropped and reported in `warnings`.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, replace

# Extensions of the type macros.
MACROS = {
    "ai": "gguf safetensors pt pth onnx bin ckpt tflite engine trt nvfp4 fp8 awq gptq ggml mlmodel weights h5 pb torchscript modelfile",
    "doc": "doc docx pdf txt md xls xlsx csv ppt pptx wps rtf odt epub log tex",
    "image": "png jpg jpeg gif webp svg ico bmp tiff psd raw heic",
    "video": "mp4 mkv avi mov wmv flv webm m4v rmvb ts",
    "audio": "mp3 flac wav aac ogg m4a wma ape mid",
    "code": "rs ts js py c cpp h hpp go java html css svelte vue json toml yaml xml sql sh bat ps1 php rb swift kt lua",
    "app": "exe msi bat cmd ps1 lnk vbs jar",
    "archive": "zip rar 7z tar gz bz2 xz iso cab",
}
# The spellings of each macro, after `type:` / `kind:` and as a word of their own.
MACRO_WORDS = {
    "ai": ("type:ai type:model kind:ai kind:model", "ai: model:"),
    "doc": ("type:doc type:document type:docs kind:doc kind:document", "doc: docs:"),
    "image": ("type:image type:pic type:picture type:photo kind:image kind:pic", "pic: image: img:"),
    "video": ("type:video type:movie kind:video", "video: movie:"),
    "audio": ("type:audio type:music kind:audio", "audio: music:"),
    "code": ("type:code type:source kind:code", "code: src:"),
    "app": ("type:app type:exe type:program kind:app kind:exe", "exe: app:"),
    "archive": ("type:archive type:zip type:compressed kind:archive kind:zip", "zip: archive:"),
}
FOLDER_WORDS = frozenset("type:folder type:dir folder: dir: kind:folder kind:dir".split())
FILE_WORDS = frozenset("type:file file: kind:file".split())
UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4}
ROLLING_DAYS = {"today": 1, "thisweek": 7, "7d": 7, "thismonth": 30, "30d": 30, "thisyear": 365, "365d": 365}
FULL_WIDTH = str.maketrans({"：": ":", "“": '"', "”": '"', "‘": "'", "’": "'"})
DAY = 86_400
_MACRO_OF = {word: name for name, groups in MACRO_WORDS.items() for group in groups for word in group.split()}


@dataclass(frozen=True)
class Bounds:
    """Closed bounds; null is open."""

    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class ParsedQuery:
    text_terms: tuple[str, ...] = ()
    regex_patterns: tuple[str, ...] = ()
    ext_filters: tuple[str, ...] = ()
    size_filters: tuple[Bounds, ...] = ()
    date_filters: tuple[Bounds, ...] = ()
    folders_only: bool | None = None
    path_includes: tuple[str, ...] = ()
    path_excludes: tuple[str, ...] = ()
    content_terms: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()

    @property
    def is_empty(self) -> bool:
        return replace(self, warnings=()) == ParsedQuery()

    @property
    def has_content_search(self) -> bool:
        return bool(self.content_terms)

    @property
    def content_phrase(self) -> str:
        return " ".join(self.content_terms)


def tokenize(query: str) -> list[str]:
    tokens, current, quoted = [], "", False
    for char in query:
        if char == '"':
            quoted = not quoted
        elif char in " \t\r\n" and not quoted:
            tokens.append(current)
            current = ""
        else:
            current += char
    return [t for t in [*tokens, current] if t]


def parse_size(literal: str) -> Bounds | None:
    """`>n`, `<n`, `a-b` or `n` (as `>n`), with 1024-based units; all bounds are inclusive."""

    def number(text: str) -> int | None:
        found = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([a-z]*)\s*", text.lower())
        if not found or found[2] not in UNITS:
            return None
        return int(float(found[1]) * 1024 ** UNITS[found[2]])

    if literal[:1] in "<>" and literal:
        value = number(literal[1:])
        return None if value is None else (Bounds(low=value) if literal[0] == ">" else Bounds(high=value))
    if "-" in literal:
        low, high = map(number, literal.split("-", 1))
        return None if low is None or high is None else Bounds(low, high)
    value = number(literal)
    return None if value is None else Bounds(low=value)


def parse_day(literal: str, approximate: bool = False) -> int | None:
    """Unix seconds of the start of an ISO day. approximate: months of 30 days, as the compatible mode wants."""
    found = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", literal.strip())
    if not found:
        return None
    year, month, day = map(int, found.groups())
    if not (1970 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= 31):
        return None
    if approximate:
        return ((year - 1970) * 365 + (year - 1968) // 4 + month * 30 + day) * DAY
    return calendar.timegm((year, month, day, 0, 0, 0))


def parse_date(literal: str, now: int, approximate: bool = False) -> Bounds | None:
    word = literal.lower()
    if word == "yesterday":
        return Bounds(now - 2 * DAY, now - DAY)
    if word in ROLLING_DAYS:
        return Bounds(low=now - ROLLING_DAYS[word] * DAY)
    before = literal.startswith("<")
    day = parse_day(literal[1:] if literal[:1] in "<>" else literal, approximate)
    return None if day is None else (Bounds(high=day) if before else Bounds(low=day))


def valid_regex(pattern: str) -> bool:
    """Whether the pattern is in the dialect of linear-time engines: no look-around, no back-references."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<|\(\?>|[*+?}]\+", pattern):
        return False
    try:
        re.compile(re.sub(r"\\p\{\w+\}|\\P\{\w+\}", "x", pattern))
    except re.error:
        return False
    return True


def parse(query: str, now: int = 0, category: str | None = None, approximate_dates: bool = False) -> ParsedQuery:
    """Parse a query. now: the time rolling dates count from. category: a type macro to add unless already there."""
    query = query.translate(FULL_WIDTH)
    if category and f"type:{category}" not in query.lower():
        query = f"type:{category} {query}"
    out: dict[str, list] = {name: [] for name in ("text", "regex", "ext", "size", "date", "include", "exclude", "content", "warn")}
    folders_only = None
    for token in tokenize(query):
        lower = token.lower()
        prefix, _, value = token.partition(":")
        prefix = prefix.lower()
        drive_path = prefix == "c" and value[:1] in ("\\", "/")
        if prefix in ("content", "c") and ":" in token and not drive_path:
            if value.strip('" '):
                out["content"].append(value.strip('" '))
        elif lower.startswith("ext:"):
            out["ext"] += [e.lstrip(".") for e in re.split(r"[|;]", lower[4:]) if e.lstrip(".")]
        elif lower.startswith("size:"):
            bounds = parse_size(lower[5:])
            out["size" if bounds else "warn"].append(bounds or token)
        elif lower.startswith(("dm:", "modified:")):
            bounds = parse_date(value, now, approximate_dates)
            out["date" if bounds else "warn"].append(bounds or token)
        elif lower in FOLDER_WORDS:
            folders_only = True
        elif lower in FILE_WORDS:
            folders_only = False
        elif lower in _MACRO_OF:
            out["ext"] += MACROS[_MACRO_OF[lower]].split()
        elif lower.startswith(("-path:", "!path:")):
            if lower[6:]:
                out["exclude"].append(lower[6:])
        elif lower.startswith("path:"):
            out["include"].append(lower[5:])
        elif token.startswith(("regex:", "r:")) or (len(token) > 2 and token[0] == token[-1] == "/"):
            pattern = token[1:-1] if token[0] == "/" else value
            out["regex" if valid_regex(pattern) else "warn"].append(pattern if valid_regex(pattern) else token)
        else:
            out["text"].append(lower)
    return ParsedQuery(
        tuple(out["text"]), tuple(out["regex"]), tuple(dict.fromkeys(out["ext"])), tuple(out["size"]), tuple(out["date"]),
        folders_only, tuple(out["include"]), tuple(out["exclude"]), tuple(out["content"]), tuple(out["warn"]),
    )
