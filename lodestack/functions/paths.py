"""Path predicates of the content search and the background indexer."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Document types, and files and folders that content search leaves out.
BINARY_DOCUMENTS = "docx xlsx pptx pdf epub odt ods odp".split()
TEXT_DOCUMENTS = (
    "txt md rs py js ts json csv xml yaml yml toml ini cfg log sh bat ps1 html css svelte c cpp h hpp go java vue jsx tsx sql r "
    "rb php swift kt lua dockerfile makefile cmake"
).split()
SYSTEM_NAMES = (
    "$recycle.bin", "system volume information", "$mft", "$mftmirr", "$logfile", "$volume", "$bitmap", "$boot", "$badclus",
    "$secure", "$upcase", "$extend",
)
NOISY_ENDS = (
    "consolehost_history.txt", ".bash_history", ".zsh_history", ".node_repl_history", ".python_history", "doc_cache.db",
    "index_cache.bin",
)
NOISY_PARTS = ("\\psreadline\\", "\\.gemini\\", "\\antigravity-cli\\", "\\.system_generated\\", "\\appdata\\local\\temp\\", "\\.vscode\\", "\\.idea\\")
INDEXER_PARTS = ("\\node_modules\\", "\\.git\\", "\\appdata\\", "\\windows\\", "\\$recycle.bin\\", "\\temp\\")
SKIPPED_FOLDERS = ("node_modules", "target")
#: The largest file whose content is searched, and the largest that the ranked index takes.
CONTENT_CAP, KNOWLEDGE_CAP = 50 * 1024 * 1024, 10 * 1024 * 1024


def is_supported(ext: Column) -> Column:
    return F.lower(ext).isin(*BINARY_DOCUMENTS, *TEXT_DOCUMENTS)


def is_binary_document(ext: Column) -> Column:
    return F.lower(ext).isin(*BINARY_DOCUMENTS)


def is_noisy(path_lower: Column, extra_parts: tuple[str, ...] = ()) -> Column:
    """History files, tool folders and this engine's own data; extra_parts adds an application's own folders."""
    return reduce(or_, [path_lower.endswith(e) for e in NOISY_ENDS] + [path_lower.contains(p) for p in (*NOISY_PARTS, *extra_parts)])


def is_skipped_by_indexer(path_lower: Column) -> Column:
    return is_noisy(path_lower, INDEXER_PARTS)


def content_candidates() -> Column:
    """Files whose content is searched: a supported type, not noisy, with at most CONTENT_CAP bytes."""
    return ~F.col("is_directory") & is_supported(F.col("ext")) & (F.col("size") <= CONTENT_CAP) & ~is_noisy(F.col("full_path_lower"))
