"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

FILE_ENTRY = "frn BIGINT, parent_frn BIGINT, name STRING, size BIGINT, mtime BIGINT, file_attributes INT, is_directory BOOLEAN"
RAW_NODE = FILE_ENTRY + ", volume STRING"
FILE_INDEX = (
    "seq BIGINT, name STRING, full_path STRING, name_lower STRING, full_path_lower STRING, pinyin_first STRING, pinyin_full STRING, "
    "ext STRING, size BIGINT, mtime BIGINT, is_directory BOOLEAN, file_attributes INT, frn BIGINT, parent_frn BIGINT, volume STRING"
)
USN_RECORD = (
    "read_no BIGINT, read_at TIMESTAMP, volume STRING, record_length INT, major_version SMALLINT, minor_version SMALLINT, "
    "file_reference_number BIGINT, parent_file_reference_number BIGINT, usn BIGINT, time_stamp BIGINT, reason BIGINT, "
    "source_info INT, security_id INT, file_attributes INT, file_name_length INT, file_name STRING"
)
DOC_CACHE = "path STRING, mtime BIGINT, size BIGINT, doc_type STRING, content STRING"
SEARCH_HISTORY = "id BIGINT, query STRING, result_count BIGINT, searched_at BIGINT"
SETTINGS = "key STRING, value STRING"
FAVORITES = "id BIGINT, file_path STRING, file_name STRING, added_at BIGINT"
EXCLUSION_RULES = "id BIGINT, pattern STRING, is_regex BOOLEAN, created_at BIGINT"
SEARCH_REQUEST = "query STRING, limit INT"
SEARCH_ITEM = "name STRING, full_path STRING, size BIGINT, mtime BIGINT, is_directory BOOLEAN, ext STRING"
DIRECTORY_BIT = 0x10
